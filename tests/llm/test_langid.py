import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"


def plain_forward(net, window):
    """Probabilities of one window: each filter of each width at each place by itself, in double precision."""
    x = [net.embedding[b].astype(np.float64) for b in window]
    places = len(window) - max(langid.WIDTHS) + 1
    hidden = []
    for f in range(len(langid.WIDTHS) * langid.FILTERS):
        width = langid.WIDTHS[f // langid.FILTERS]
        rows = net.filters[:, f].astype(np.float64).reshape(-1, langid.EMBEDDING)
        at = [sum(float(rows[k] @ x[p + k]) for k in range(width)) for p in range(places)]
        hidden.append(max(0.0, max(at) + net.filter_bias[f]))
    logits = np.array(hidden) @ net.weights + net.bias
    return np.exp(logits) / np.exp(logits).sum()


def test_probabilities_against_a_plain_forward_pass():
    net = langid.train(["the end of the day " * 20, "la fin de la nuit " * 20, "das ende der nacht " * 20] * 8, ["en", "fr", "de"] * 8, epochs=2)
    windows, _, _ = langid.windows_of(["the day", "la nuit est longue " * 14, "€ ende", "x" * 256])
    assert net.probabilities(windows) == pytest.approx(np.array([plain_forward(net, w) for w in windows]), abs=1e-5)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b", "c"], rng)
    for name in ("embedding", "filters", "filter_bias", "weights", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, labels = rng.integers(1, 9, (3, 24)).astype(np.uint8), np.array([0, 1, 2])

    def loss():
        return -np.mean([np.log(plain_forward(net, w)[label]) for w, label in zip(windows, labels)])

    for parameter, gradient in zip(net.parameters, net.gradients(windows, labels)):
        flat, step = parameter.reshape(-1), 1e-6
        places = np.arange(langid.EMBEDDING, 9 * langid.EMBEDDING) if parameter is net.embedding else np.arange(flat.size)
        for k in rng.choice(places, min(len(places), 10), replace=False):
            if parameter is net.filters and not net.reach().reshape(-1)[k]:
                continue
            flat[k] += step
            up = loss()
            flat[k] -= 2 * step
            down = loss()
            flat[k] += step
            assert gradient.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_windows_cover_texts():
    texts = [b"", b"a", b"b" * 256, b"c" * 257, b"", b"xyz" * 1000]
    windows, row, size = langid.windows_of(texts)
    for k, t in enumerate(texts):
        assert b"".join(w[:n].tobytes() for w, n in zip(windows[row == k], size[row == k])) == t
    assert not windows[np.arange(langid.WINDOW) >= size[:, None]].any()


def test_held_out_accuracy_and_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in langid.query(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert found.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    held = [k for k, r in found.items() if r.held_out]
    assert len(held) > 200 and np.mean([found[k].lang_pred == truth[k] for k in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_edges(spark):
    prose = {"en": "the cat is on the mat and that was the end of it ", "fr": "le chat est sur la table et il ne veut pas en partir "}
    rows = [(i, prose[lang] * (1 + i % 3), lang, "x", "y") for i in range(60) for lang in ("en", "fr")]
    rows += [(900, None, "en", "", ""), (901, "", "fr", "", ""), (902, "12 34 -- ²½ !", "en", "", ""), (None, prose["en"] * 2000, None, "", ""), (None, "日本語です", None, None, None), (903, prose["fr"] * 5000, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.fit(docs, sample_docs=40)
    assert net.langs == ["en", "fr"]
    found = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs, net).collect()}
    for k in (900, 901, 902):
        assert found[k, "und"].score == 0
    assert (None, "en") in found and (903, "fr") in found
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()}
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.keep_identified(docs, None).count() == docs.count() - 3  # nothing to judge by: those with a letter


def test_other_ids_and_spellings(spark):
    rows = [("a", "the cat is on the mat " * 9, "en", 1), ("b", "le chat est sur la table " * 9, "fr", 2), (None, None, "fr", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, LANG_PRED int")
    net = langid.train([rows[0][1], rows[1][1]] * 20, ["en", "fr"] * 20)
    assert [(r.doc_id, r.lang_pred) for r in langid.identify(docs, net, text_col="TEXT").collect()] == [("a", "en"), ("b", "fr"), (None, "und")]
    assert [tuple(r) for r in langid.keep_identified(docs, net, text_col="Text").collect()] == rows[:2]


def test_most_langs_bounds_what_is_learned(spark):
    rows = [(i, f"some text {i} of many", f"l{i % 7}", "", "") for i in range(100)] + [(i, f"more text {i}", "l3", "", "") for i in range(100, 140)]
    assert "l3" in langid.fit(spark.createDataFrame(rows, SCHEMA), most_langs=3).langs
    assert len(langid.fit(spark.createDataFrame(rows, SCHEMA), most_langs=3).langs) <= 3


def test_prediction_uses_text_only():
    net = langid.train(["the end of the day " * 9, "la fin de la nuit " * 9] * 20, ["en", "fr"] * 20)
    whole = langid._predictions(net, pa.array(["the end of the day and of the world " * 30, "la nuit et la fin de la mer " * 30]))
    assert whole[0] == ["en", "fr"]
    again = langid._predictions(net, pa.array(["la nuit et la fin de la mer " * 30]))
    assert again[1][0] == pytest.approx(whole[1][1])


def test_sample_draws_rows_of_one_id_apart_and_within_bounds(spark, monkeypatch):
    drawn = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: drawn.update(texts=texts, labels=labels))
    for same in range(12):  # ids outside the held-out fold, one for all rows
        if zlib.crc32(str(same).encode()) % 4 == 2:
            continue
        rows = [(same, f"text {k} of many in the one language", "en", "", "") for k in range(1500)] + [(same, "copied text", "fr", "", "")] * 600
        langid.fit(spark.createDataFrame(rows, SCHEMA), sample_docs=50)
        assert 20 <= drawn["labels"].count("en") <= 100
        assert drawn["labels"].count("fr") == 1
        if same > 3:
            break
