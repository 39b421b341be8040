"""Benchmark decontamination: a BM25 index of test items with block maxima, queried with every training passage.

The items are the indexed documents and a passage, a window of words, is the query. A posting's impact is its BM25
weight over the score that its item must reach, so every item has threshold 1. Of each item the commonest terms whose
impacts stay within SPARE in sum are optional: with all of them a passage still needs 1 - SPARE from the item's other
terms. Only those, the essential postings, have lists, in order of item and with the largest impact of each block.

A passage is answered by block-max WAND: cursors in order of their items, the pivot where the lists' largest impacts
add up to the need, a look at the block maxima at the pivot, then either the pivot's exact score with all terms, or a
skip past the block. Before that the same block maxima are summed for all passages of a batch at once; a passage in
none of whose blocks they reach the need would be skipped through to the end, and no cursor is opened for it. Nothing
at or above the threshold is lost. Items found are verified word by word against the document: five-word shingles of
the whole item, and the positions of question and answer that those cover.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.staging import discard

from .common import place_of, slices, staged, type_of, words_of
from .presplit import Pieces

K1, B = 1.2, 0.75
#: Words of a passage; passages begin every STRIDE words, so one holds any item of up to STRIDE words whole.
PASSAGE, STRIDE = 128, 64
#: Share of an item's own score that a passage must reach, of the part of the item that fits in a stride.
LEAST_SCORE = 0.4
SHINGLE, LEAST_SHINGLES, LEAST_QUESTION, LEAST_ANSWER = 5, 0.8, 0.8, 0.5
BLOCK = 2
#: Bounds of (window, block) that are summed at a time.
CELLS = 1 << 22
#: What an item's optional terms may sum up to, of its threshold, and what the others must reach; sums differ by their
#: order, so a trifle less is enough.
SPARE = 0.5
NEED = 1 - SPARE - 1e-9
#: Words of one index part, about 40 bytes each; a larger benchmark is indexed in several parts, one after another.
PART_WORDS = 2_000_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Some of what _EDGE takes away, tried first.
_COMMON = ".,;:!?\"'()[]*"
_SENTENCE_END = re.compile(r"(?<=[.!?…。！？])\s+|\n+")


def normal(word: str) -> str:
    """The word in lower case without what is not a letter or digit at its ends; may be empty."""
    if word.isalnum() or (word := word.strip(_COMMON)).isalnum():
        return word.lower()
    return _EDGE.sub("", word.lower())


def normal_words(text: str | None) -> list[str]:
    return [w for raw in re.findall(r"[^\x20\x09-\x0D]+", text or "") if (w := normal(raw))]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words before the last sentence or line, and words of it. One sentence only is both, so it must be found whole."""
    parts = [p for p in map(normal_words, _SENTENCE_END.split((text or "").strip())) if p]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])


@dataclass
class Index:
    """Arrays of one index part. Terms and items are numbered."""

    item_ids: list
    terms: dict[str, int]
    word_at: np.ndarray  # item -> its words in order, as terms
    word_term: np.ndarray
    n_question: np.ndarray
    #: term -> the items of its essential postings, in order, and its largest impact.
    post_at: np.ndarray
    post_item: np.ndarray
    term_max: np.ndarray
    #: By essential postings: term -> its entries, one for each block, with the largest impact there.
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    #: item -> its distinct terms.
    item_at: np.ndarray
    item_term: np.ndarray
    item_impact: np.ndarray

    @classmethod
    def build(cls, items: list[tuple], n_items: int, mean_words: float, frequency: dict[str, int]) -> Index:
        """``items``: (id, question words, answer words); the rest is over the whole benchmark."""
        terms: dict[str, int] = {}
        words = [[terms.setdefault(w, len(terms)) for w in [*q, *a]] for _, q, a in items]
        idf = np.log1p([(n_items - frequency[t] + 0.5) / (frequency[t] + 0.5) for t in terms])
        common = np.array([frequency[t] for t in terms], np.int64)
        term, item, impact, needed = [], [], [], []
        for i, row in enumerate(words):
            own, times = np.unique(np.array(row, np.int64), return_counts=True)
            weight = idf[own] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(row) / mean_words))
            weight /= weight.sum() * LEAST_SCORE * min(1.0, STRIDE / len(row))
            order = np.argsort(-common[own], kind="stable")
            optional = np.zeros(len(own), bool)
            optional[order] = np.cumsum(weight[order]) <= SPARE
            for found, part in zip((term, item, impact, needed), (own, np.full(len(own), i), weight, ~optional)):
                found.append(part)
        term, item, impact, needed = map(np.concatenate, (term, item, impact, needed))
        key = term[needed] * len(items) + item[needed]
        order = np.argsort(key)
        post_term, post_item = np.divmod(key[order], len(items))
        largest = impact[needed][order]
        entry = post_term * len(items) + post_item // BLOCK
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        ends, term_max = np.arange(len(terms) + 1), np.zeros(len(terms))
        np.maximum.at(term_max, post_term, largest)
        return cls(
            [i for i, *_ in items], terms, np.cumsum([0, *map(len, words)]), np.fromiter((t for row in words for t in row), np.int32), np.array([len(q) for _, q, _ in items]),
            np.searchsorted(post_term, ends), post_item.astype(np.int32), term_max,
            np.searchsorted(entry[first] // len(items), ends), entry[first] % len(items), np.maximum.reduceat(largest, first),
            np.searchsorted(item, np.arange(len(items) + 1)), term.astype(np.int32), impact,
        )

    def words(self, item: int) -> list[int]:
        return self.word_term[self.word_at[item] : self.word_at[item + 1]].tolist()

    def live(self, window: np.ndarray, term: np.ndarray, n_windows: int) -> np.ndarray:
        """The windows of which some block may hold an item at the threshold, by block maxima."""
        blocks = -(-len(self.item_ids) // BLOCK)
        listed = np.flatnonzero(np.diff(self.block_at)[term] > 0)
        near, step, out = window[listed], max(1, CELLS // blocks), [np.zeros(0, np.int64)]
        for base in range(0, n_windows, step):
            own = listed if n_windows <= step else listed[(near >= base) & (near < base + step)]
            entry, source = _ranges(self.block_at[term[own]], self.block_at[term[own] + 1])
            cell = (window[own] - base)[source] * blocks + self.block[entry]
            # a word that repeats counts again, which only loosens the bound
            bound = np.bincount(cell, weights=self.block_max[entry])
            out.append(np.unique(np.flatnonzero(bound >= NEED) // blocks) + base)
        return np.concatenate(out)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all scores of 1 or more of a passage with these distinct terms."""
        own, found = set(terms), []
        heads = [Cursor(self, t) for t in terms if self.post_at[t] < self.post_at[t + 1]]
        while True:
            heads = sorted((h for h in heads if h.item is not None), key=_ITEM)
            total = 0.0
            for n, head in enumerate(heads, 1):
                total += head.most
                if total >= NEED:
                    break
            else:
                return found
            pivot = head.item
            while n < len(heads) and heads[n].item == pivot:
                n += 1
            ahead, block = heads[:n], pivot // BLOCK
            if sum(h.most_in(block) for h in ahead) < NEED:
                # no item of the block that only these lists hold can do: on to the next block, or the next list
                past = min((block + 1) * BLOCK, heads[n].item if n < len(heads) else len(self.item_ids))
                for h in ahead:
                    h.seek(past)
            elif ahead[0].item == pivot:
                a, b = self.item_at[pivot], self.item_at[pivot + 1]
                score = sum(w for t, w in zip(self.item_term[a:b].tolist(), self.item_impact[a:b].tolist()) if t in own)
                if score >= 1 - 1e-9:
                    found.append((pivot, score))
                for h in ahead:
                    h.seek(pivot + 1)
            else:
                for h in ahead:
                    h.seek(pivot)

    def search(self, window: np.ndarray, term: np.ndarray, n_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all scores of 1 or more; ``window``, ``term``: which terms a window has, repeats allowed."""
        stay = np.zeros(n_windows, bool)
        stay[self.live(window, term, n_windows)] = True
        own = np.unique(window[has := stay[window]] * np.int64(len(self.terms)) + term[has])
        of, terms = np.divmod(own, len(self.terms))
        live = self.live(of, terms, n_windows)  # without repeats fewer are left
        found = []
        for w, a, b in zip(live.tolist(), np.searchsorted(of, live).tolist(), np.searchsorted(of, live, "right").tolist()):
            found += [(w, item, score) for item, score in self.wand(terms[a:b].tolist())]
        columns = list(zip(*found)) or [(), (), ()]
        return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], float)

    def verify(self, item: int, document: set[tuple]) -> tuple[float, float, float]:
        """Shares of the item's shingles in ``document`` (its tuples of terms), and of the question's and answer's words
        that those cover."""
        row, nq = self.words(item), self.n_question[item]
        width = min(SHINGLE, len(row))
        hits = [tuple(row[k : k + width]) in document for k in range(len(row) - width + 1)]
        covered = [any(hits[max(0, p - width + 1) : p + 1]) for p in range(len(row))]
        question, answer = covered[:nq], covered[nq:]
        return sum(hits) / len(hits), sum(question) / len(question) if question else 1.0, sum(answer) / len(answer) if answer else 1.0


class Cursor:
    """A place in the list of a term's essential postings."""

    __slots__ = ("item", "most", "_at", "_items", "_blocks", "_maxima")

    def __init__(self, index: Index, term: int):
        self._items, self._at = index.post_item[index.post_at[term] : index.post_at[term + 1]].tolist(), 0
        entries = slice(index.block_at[term], index.block_at[term + 1])
        self._blocks, self._maxima = index.block[entries].tolist(), index.block_max[entries].tolist()
        self.item, self.most = self._items[0], float(index.term_max[term])

    def most_in(self, block: int) -> float:
        k = bisect_left(self._blocks, block)
        return self._maxima[k] if k < len(self._blocks) and self._blocks[k] == block else 0.0

    def seek(self, item: int) -> None:
        """On to the first posting of ``item`` or a later one; what lies between is not looked at."""
        self._at = bisect_left(self._items, item, self._at)
        self.item = self._items[self._at] if self._at < len(self._items) else None


_ITEM = attrgetter("item")


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and for each the range it is from."""
    size = end - start
    source = np.repeat(np.arange(len(size)), size)
    return np.arange(len(source)) + np.repeat(start - (np.cumsum(size) - size), size), source


def _windows(row: np.ndarray, place: np.ndarray, term: np.ndarray, counts: np.ndarray):
    """Which window has which term, the row of each window, and the number of windows. A word is in one or two."""
    per_row = np.maximum(1, -(-counts // STRIDE))
    window = (np.cumsum(per_row) - per_row)[row] + place // STRIDE
    before = place >= STRIDE
    row_of = np.repeat(np.arange(len(counts)), per_row)
    return np.concatenate([window, window[before] - 1]), np.concatenate([term, term[before]]), row_of, len(row_of)


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        number = index.terms.get
        self._number = Pieces(lambda word: number(w, -1) if (w := normal(word)) else -2)

    def matches(self, texts: pa.Array) -> list[tuple]:
        """(row, item id, score share, shingles, question, answer) of all verified items of all texts."""
        index, found = self.index, []
        codes, at, words = words_of(texts)
        numbers = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))[codes]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        real = numbers != -2
        numbers, row = numbers[real], row[real]
        counts = np.bincount(row, minlength=len(at) - 1)
        start = np.cumsum(counts) - counts
        place = np.arange(len(row)) - start[row]
        known = numbers >= 0
        window, term, row_of, n = _windows(row[known], place[known], numbers[known], counts)
        window, item, score = index.search(window, term, n)
        if not len(window):
            return found
        pair, place = np.unique(row_of[window] * np.int64(len(index.item_ids)) + item, return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, place, score)
        last, grams = -1, set()
        for key, share in zip(pair.tolist(), best.tolist()):
            r, i = divmod(key, len(index.item_ids))
            if r != last:
                own = numbers[start[r] : start[r] + counts[r]].tolist()
                last, grams, own_words = r, set(zip(*(own[k:] for k in range(SHINGLE)))), own
            width = min(SHINGLE, len(index.words(i)))
            shingles, question, answer = index.verify(i, grams if width == SHINGLE else set(zip(*(own_words[k:] for k in range(width)))))
            if shingles >= LEAST_SHINGLES and question >= LEAST_QUESTION and answer >= LEAST_ANSWER:
                found.append((r, index.item_ids[i], share, shingles, question, answer))
        return found


def _split_items(batches):
    for batch in batches:
        pairs = [question_and_answer(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1))], ["id", "question", "answer"])


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_words: int = PART_WORDS) -> tuple[int, Iterator[Index]]:
    """The number of index parts and the parts themselves, of about ``part_words`` words each, dealt by a hash of the
    id; statistics cover all items.

    A benchmark is small beside a corpus; one part holds tens of thousands of items, and that bound, some 100 MB, is
    what the driver holds and sends to the executors at a time: a part is collected when it is asked for. An item
    without words is not indexed.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {type_of(benchmark, id_col)}, question array<string>, answer array<string>"
    items = staged(rows.mapInArrow(_split_items, schema).where("size(question) + size(answer) > 0"), "items")
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.size("question") + F.size("answer")), F.lit(0))).first()
    parts = max(1, -(-total // part_words)) if n else 0
    part = F.pmod(F.xxhash64("id", "question", "answer"), F.lit(max(1, parts)))
    words = items.select(part.alias("part"), F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word"))
    frequency = staged(words.groupBy("word").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")), "frequency")

    def built():
        for p in range(parts):
            own = sorted(((r.id, r.question, r.answer) for r in items.where(part == p).collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1], r[2]))
            counts = {r.word: r.n for r in frequency.where(F.array_contains("parts", F.lit(p).cast("long"))).select("word", "n").collect()}
            if own:
                yield Index.build(own, n, total / n, counts)

    return parts, built()


def _report(index, item_type: pa.DataType):
    def run(batches):
        searcher = Searcher(index.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = searcher.matches(part.column("text"))
                columns = list(zip(*found)) or [()] * 6
                ids = part.column("id").take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], item_type), *(pa.array(c, pa.float64()) for c in columns[2:])], _NAMES)

    return run


_NAMES = ["doc_id", "item_id", "score", "shingle_share", "question_share", "answer_share"]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, score, shingle_share, question_share, answer_share), one for each row of ``docs`` and item
    that it gives away; no shuffle of documents.

    score is the best passage's BM25 over the item's threshold. Null and empty texts give nothing away, an item without
    words is in nothing; a very long text is searched whole. Ids are of any type, may be null or repeat: each row and
    each item answers for itself. Empty tables give an empty result. A benchmark of several index parts takes one
    written pass a part, so one index is in memory at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {type_of(docs, id_col)}, item_id {type_of(benchmark, item_id_col)}, score double, shingle_share double, question_share double, answer_share double"
    item_type = to_arrow_type(benchmark.select(item_id_col).schema[0].dataType)
    out = spark.createDataFrame([], schema)
    parts, built = indexes(benchmark, item_id_col, item_text_col, part_words)
    for index in built:
        held = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(_report(held, item_type), schema)
        if parts == 1:
            return found
        out = out.unionByName(staged(found, "leaks"))
        held.destroy()
    return out


def _clean(index, at: int):
    def run(batches):
        searcher = Searcher(index.value)
        for batch in batches:
            for part in slices(batch, at):
                bad = np.zeros(part.num_rows, bool)
                bad[[m[0] for m in searcher.matches(part.column(at))]] = True
                yield part.filter(pc.invert(pa.array(bad)))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs`` that give no item away, with all their columns; no shuffle of documents.

    Null and empty texts give nothing away and stay, repeated rows are judged alike, a very long text is searched
    whole. An empty benchmark leaves all rows, an empty table gives an empty result. A benchmark of several index parts
    takes one written pass a part, so one index is in memory at a time.
    """
    out, at = docs, place_of(docs, text_col)
    parts, built = indexes(benchmark, item_id_col, item_text_col, part_words)
    for index in built:
        held, before = docs.sparkSession.sparkContext.broadcast(index), out
        out = out.mapInArrow(_clean(held, at), docs.schema)
        if parts > 1:
            out = staged(out, "clean")
            held.destroy()
            if before is not docs:
                discard(before)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
