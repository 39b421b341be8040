import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, score string"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items):
    """All rows and items: BM25 of every passage against every item, then plain verification."""
    split = [(i, *dc.question_and_answer(t)) for i, t in items]
    split = [(i, q, a) for i, q, a in split if q or a]
    n, mean = len(split), sum(len(q) + len(a) for _, q, a in split) / max(1, len(split))
    df = Counter(w for _, q, a in split for w in {*q, *a})
    out = []
    for d, text in docs:
        words = dc.normal_words(text)
        passages = [set(words[k : k + dc.PASSAGE]) for k in range(0, max(1, len(words)), dc.STRIDE)]
        for i, q, a in split:
            row = q + a
            weight = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (dc.K1 + 1) / (f + dc.K1 * (1 - dc.B + dc.B * len(row) / mean)) for w, f in Counter(row).items()}
            least = sum(weight.values()) * dc.LEAST_SCORE * min(1, dc.STRIDE / len(row))
            best = max(sum(weight[w] for w in p if w in weight) for p in passages) / least
            if best < 1:
                continue
            width = min(5, len(row))
            grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            hits = [tuple(row[k : k + width]) in grams for k in range(len(row) - width + 1)]
            covered = [any(hits[max(0, p - width + 1) : p + 1]) for p in range(len(row))]
            share = lambda x: sum(x) / len(x) if x else 1.0
            if share(hits) >= 0.8 and share(covered[: len(q)]) >= 0.8 and share(covered[len(q) :]) >= 0.5:
                out.append((d, i, round(best, 6), round(share(hits), 6)))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    rows = dc.leaks(frame, spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS), **options).collect()
    return sorted(((r.doc_id, r.item_id, round(r.score, 6), round(r.shingle_share, 6)) for r in rows), key=str)


def cases():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["an", "the", "tion", "er", "in", "st"]) for _ in range(draw.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{prose(n)}. {prose(m)}.") for k, (n, m) in enumerate([(12, 4), (30, 9), (50, 6), (150, 20), (9, 9), (20, 1), (3, 1), (300, 40)])]
    items += [(50, None), (51, ""), (52, "..."), (53, items[1][1]), (None, "a null id is an id too. and it has an answer"), (54, "two words"), (55, "One line only without any end")]
    docs = [(k, prose(draw.randint(0, 700))) for k in range(12)]
    for k, (_, text) in enumerate(items):
        docs.append((100 + k, f"{prose(90)}\n{text or ''}\n{prose(200)}"))
        docs.append((200 + k, (text or "").upper().replace(" ", " ,\t")))
        words = (text or "x").split()
        words[len(words) // 3] = "otherword"
        docs.append((300 + k, f"{prose(63)} {' '.join(words)} {prose(5)}"))
        docs.append((400 + k, f"{prose(63)} {' '.join(words[: len(words) // 2])} {prose(5)}"))
    docs += [(500, None), (501, ""), (None, items[0][1]), (None, items[0][1]), (502, prose(50_000) + " " + items[2][1]), (503, " ".join(t or "" for _, t in items))]
    return docs, items


def test_against_every_passage_and_item(spark):
    docs, items = cases()
    expected = brute(docs, items)
    assert {(100 + k, k) for k in range(8)} <= {(d, i) for d, i, *_ in expected}
    assert found(spark, docs, items) == expected


def test_parts_find_the_same(spark):
    docs, items = cases()
    assert found(spark, docs, items, part_words=100) == brute(docs, items)


def index_of(items):
    split = [(i or 0, *dc.question_and_answer(t)) for i, t in items]
    split = [x for x in split if x[1] or x[2]]
    df = Counter(w for _, q, a in split for w in {*q, *a})
    return dc.Index.build(split, len(split), np.mean([len(q) + len(a) for _, q, a in split]), df)


def test_traversal_finds_what_scoring_all_finds_and_skips_postings(spark, monkeypatch):
    """Every passage of real documents, without the batch's bound before it: block-max WAND against all scores."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, seen = index_of(items), Counter()
    plain = dc.Cursor.seek

    def seek(self, item):
        before = self._at
        plain(self, item)
        seen["passed"] += self._at - before
        seen["looked at"] += 1

    monkeypatch.setattr(dc.Cursor, "seek", seek)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs += [f"{t} {d}" for (_, t), d in zip(items, docs)]
    hits = 0
    for text in docs:
        words = dc.normal_words(text)
        for k in range(0, max(1, len(words)), dc.STRIDE):
            own = {index.terms[w] for w in words[k : k + dc.PASSAGE] if w in index.terms}
            inside = np.isin(index.item_term, list(own))
            scores = np.bincount(np.repeat(np.arange(len(index.item_ids)), np.diff(index.item_at)), weights=index.item_impact * inside, minlength=len(index.item_ids))
            found = dict(index.wand(sorted(own)))
            seen["listed"] += sum(int(index.post_at[t + 1] - index.post_at[t]) for t in own)
            assert found.keys() == set(np.flatnonzero(scores >= 1 - 1e-9).tolist())
            assert all(abs(scores[i] - v) < 1e-9 for i, v in found.items())
            hits += len(found)
    assert hits >= 100
    # some lists end before the need is reached and some seeks jump, so fewer postings are looked at than are listed
    assert seen["looked at"] < seen["listed"] and seen["passed"] > seen["looked at"] * 0.9


def test_many_parts_run_one_after_another(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    assert dc.indexes(bench, part_words=100)[0] >= 5
    whole, parts = dc.drop_leaks(frame, bench), dc.drop_leaks(frame, bench, part_words=100)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(whole).count("MapInArrow") == 1 and plan(parts).count("MapInArrow") == 0  # each part's rows were written
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert plan(dc.leaks(frame, bench, part_words=100)).count("MapInArrow") == 0


def test_other_ids_and_spellings(spark):
    docs = spark.createDataFrame([("a", "one line that is the whole item here", 1), ("b", None, 2), (None, "clean", 3)], "doc_id string, text string, ITEM_ID int")
    items = spark.createDataFrame([("x", "One line that is the whole item here"), (None, "nothing like it anywhere at all")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in dc.leaks(docs, items, text_col="TEXT").collect()] == [("a", "x")]
    assert [tuple(r) for r in dc.drop_leaks(docs, items, text_col="Text").collect()] == [("b", None, 2), (None, "clean", 3)]


def test_real_tables(spark):
    read = lambda t, key: [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(key, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    expected = brute(docs, items)
    assert found(spark, docs, items) == expected
    exact = {d for d, t in docs for _, i in items if i in t}
    assert exact == {d for d, *_ in expected} and exact
    clean = dc.drop_leaks(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS))
    assert clean.columns == ["doc_id", "text", "item_id", "score"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in exact)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_docs, some_items = spark.createDataFrame([(1, "a b c d e f g", "", "")], DOCS), spark.createDataFrame([(1, "a b c d e f g", "")], ITEMS)
    assert dc.leaks(docs, items).count() == dc.leaks(docs, some_items).count() == dc.leaks(some_docs, items).count() == 0
    assert dc.leaks(some_docs, some_items).count() == 1 and dc.drop_leaks(some_docs, items).count() == 1 and dc.drop_leaks(docs, some_items).count() == 0


def test_small_cells_change_nothing(monkeypatch):
    docs, items = cases()
    index = index_of(items)
    texts = pa.array([t for _, t in docs], pa.string())
    whole = dc.Searcher(index).matches(texts)
    monkeypatch.setattr(dc, "CELLS", 20)
    assert dc.Searcher(index).matches(texts) == whole and whole
