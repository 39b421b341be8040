"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import place_of, slices, type_of

UNKNOWN = "und"
WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
#: Bounds of the training sample: documents of each language, characters taken from each at a hashed place, and languages.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGS = 250, 1024, 512
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 11
#: Windows that are convolved together.
STEP = 256
HELD_OUT_FOLD, FOLDS = 2, 4
LEAST_SCORE = 0.3


@dataclass
class Network:
    """Bytes (0: padding) to embeddings, filters of several widths, the maximum of each over the window, softmax."""

    langs: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> Network:
        k, n = max(WIDTHS) * EMBEDDING, len(WIDTHS) * FILTERS
        embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        filters = rng.normal(0, 1 / np.sqrt(k), (k, n)).astype(np.float32)
        weights = rng.normal(0, 1 / np.sqrt(n), (n, len(langs))).astype(np.float32)
        net = cls(langs, embedding, filters, np.zeros(n, np.float32), weights, np.zeros(len(langs), np.float32))
        net.embedding[0] = 0
        net.filters *= cls.reach()
        return net

    @staticmethod
    def reach() -> np.ndarray:
        """1 where a filter's width reaches an input of the widest window, else 0: one product serves all widths."""
        at = np.arange(max(WIDTHS) * EMBEDDING)[:, None] // EMBEDDING
        return (at < np.repeat(WIDTHS, FILTERS)).astype(np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * embedding) inputs of the filters."""
        x, widest = self.embedding[windows], max(WIDTHS)
        n = windows.shape[1] - widest + 1
        out = np.empty((len(windows), n, widest, EMBEDDING), np.float32)
        for k in range(widest):
            out[:, :, k] = x[:, k : k + n]
        return out.reshape(len(windows), n, -1)

    def pooled(self, columns: np.ndarray) -> np.ndarray:
        return columns.reshape(-1, columns.shape[2]) @ self.filters

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for a in range(0, len(windows), STEP):
            columns = self.columns(windows[a : a + STEP])
            found = self.pooled(columns).reshape(columns.shape[0], columns.shape[1], -1).max(axis=1)
            out[a : a + STEP] = _softmax(np.maximum(found + self.filter_bias, 0) @ self.weights + self.bias)
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for each of ``parameters``."""
        columns = self.columns(windows)
        b, rows = len(windows), np.arange(len(windows))[:, None]
        found = self.pooled(columns).reshape(b, columns.shape[1], -1)
        at = found.argmax(axis=1)
        top = np.take_along_axis(found, at[:, None], axis=1)[:, 0] + self.filter_bias
        hidden = np.maximum(top, 0)
        error = _softmax(hidden @ self.weights + self.bias)
        error[rows[:, 0], labels] -= 1
        error /= b
        back = (error @ self.weights.T) * (top > 0)
        seen = columns[rows, at]
        d_filters = np.einsum("bf,bfk->kf", back, seen) * self.reach()
        d_seen = (back[:, :, None] * self.filters.T[None]).reshape(b, back.shape[1], max(WIDTHS), EMBEDDING)
        d_embedding = np.zeros_like(self.embedding)
        for k in range(max(WIDTHS)):
            np.add.at(d_embedding, windows[rows, at + k], d_seen[:, :, k])
        d_embedding[0] = 0
        return [d_embedding, d_filters, back.sum(0), hidden.T @ error, error.sum(0)]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.filter_bias, self.weights, self.bias]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes that cover the texts, the row of each and the text bytes in it. An empty text has none.

    Beside the windows, which take the texts' bytes rounded up, no array grows with the bytes.
    """
    raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    each = -(-sizes // WINDOW)
    first = np.cumsum(each) - each
    out = np.zeros((int(each.sum()), WINDOW), np.uint8)
    flat = out.reshape(-1)
    for start, text in zip((first * WINDOW).tolist(), raw):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8)
    row = np.repeat(np.arange(len(raw)), each)
    nth = np.arange(len(row)) - first[row]
    return out, row, np.minimum(WINDOW, sizes[row] - nth * WINDOW)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for the distinct labels, by Adam. Each window is also shown cut short, so short texts are learnt too."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    windows, row, size = windows_of(texts)
    y = np.array([langs.index(label) for label in labels])[row]
    full = size >= 16
    windows, y, size = windows[full], y[full], size[full]
    short = windows * (np.arange(WINDOW) < rng.integers(16, np.maximum(17, size))[:, None])
    windows, y = np.concatenate([windows, short.astype(np.uint8)]), np.concatenate([y, y])
    net = Network.fresh(langs, rng)
    means, squares, step = [np.zeros_like(p) for p in net.parameters], [np.zeros_like(p) for p in net.parameters], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            take = order[a : a + BATCH]
            for p, g, m, s in zip(net.parameters, net.gradients(windows[take], y[take]), means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return net


def _fold(id_col: str):
    """crc32 of the id as text, modulo FOLDS; a null id is an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most_langs: int = MOST_LANGS) -> Network | None:
    """Trains on a sample of the labelled rows outside the held-out fold; None where there is no such row.

    Bounds: ``sample_docs`` rows of each language on average and twice that at most, drawn by a hash of id and text
    against the language's count of unlike rows, and ``sample_chars`` characters of each at a hashed place. Equal rows
    count once, and the bound is kept by the tasks: no more reaches the driver, whatever ids repeat or are null. Of more
    than ``most_langs`` languages those with most rows are learned, of equals the first by name.
    """
    known = docs.where((_fold(id_col) != HELD_OUT_FOLD) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    same = F.xxhash64(F.col(id_col), F.col(text_col))
    counts = known.groupBy(F.col(lang_col).alias("known_lang")).agg(F.approx_count_distinct(same).alias("count"))
    counts = counts.orderBy(F.desc("count"), "known_lang").limit(most_langs).collect()
    if not counts:
        return None
    place = F.pmod(F.xxhash64(same, F.lit("place")), F.greatest(F.lit(1), F.length(text_col) - sample_chars + 1))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["known_lang"], sample_docs / r["count"])])
    drawn = F.pmod(F.xxhash64(same, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.select(same.alias("h"), F.col(lang_col).alias("l"), F.substr(F.col(text_col), (place + 1).cast("int"), F.lit(sample_chars)).alias("t"), (drawn < share[F.col(lang_col)]).alias("in"))
    once = F.row_number().over(W.partitionBy("l", "h").orderBy("t"))
    nth = F.row_number().over(W.partitionBy("l").orderBy("h", "t"))
    few = rows.where("in").withColumn("once", once).where("once = 1").withColumn("nth", nth).where(F.col("nth") <= 2 * sample_docs)
    used = [(r.t, r.l) for r in sorted(few.select("h", "l", "t").collect())]
    return train(*map(list, zip(*used))) if used else None


def _predictions(net: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    texts = column.to_pylist()
    lettered = np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    if net is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    windows, row, size = windows_of(texts)
    weighted = net.probabilities(windows).astype(np.float64) * size[:, None]
    total = np.stack([np.bincount(row, weights=weighted[:, k], minlength=len(texts)) for k in range(len(net.langs))], axis=1)
    mean = total / np.maximum(np.bincount(row, weights=size, minlength=len(texts)), 1)[:, None]
    best = mean.argmax(axis=1)
    score = np.where(lettered, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
    return [net.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())], score


def _predict(net: Network | None):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs, score = _predictions(net, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``, from the text alone; no shuffle.

    doc_id has the id's own type; a text of any length is judged whole.

    All windows of a text count, each by its bytes; the score is the mean probability of the best language. A text that
    is null or has no letter is ``und`` with score 0, and so is any text where there was nothing to learn from. Ids may
    be null or repeat. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), (_fold(id_col) == HELD_OUT_FOLD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(net), f"doc_id {type_of(docs, id_col)}, held_out boolean, lang_pred string, score double")


def _filter(net: Network | None, at: int, least: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                if net is None:
                    yield part.filter(pa.array([t is not None and any(map(str.isalpha, t)) for t in part.column(at).to_pylist()], pa.bool_()))
                    continue
                langs, score = _predictions(net, part.column(at))
                yield part.filter(pa.array((score >= least) & (np.array(langs) != UNKNOWN)))

    return run


def keep_identified(docs: DataFrame, net: Network | None, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is found with ``least_score`` or more, with all their columns; no shuffle.

    A null or empty text, or one without a letter, has no language and goes. Repeated rows are judged alike, texts of
    any length whole. An empty table gives an empty result. Without a network there is nothing to judge by, and all
    rows that have a letter stay.
    """
    return docs.mapInArrow(_filter(net, place_of(docs, text_col), least_score), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
