import hashlib

import numpy as np
import pyarrow as pa
from test_bytebpe import LIBRARY
from test_decontaminate import brute as brute_leaks
from test_quality import brute as brute_quality
from test_quality import brute_fertility
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from lodestone.llm import langid
from lodestone.llm.quality import BANDS, SCRIPTS, script_of

DIR = "/root/testdata/sf0.001"


def good(text):
    n_words, chars, _, _, repeated = brute_quality(text)
    if n_words < 10 or 100 * repeated > 20 * n_words:
        return False
    n, share, entropy = brute_fertility(text)
    scripts = [s for s in map(script_of, text.split()) if s]
    band = BANDS[SCRIPTS[max(sorted(set(scripts)), key=scripts.count)] if scripts else "none"]
    return band.least_chars_per_token <= chars / n <= band.most_chars_per_token and share <= band.most_fallback and (n < band.least_tokens or entropy >= band.least_entropy)


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    expected = {}
    kept = {i: t for i, t in kept.items() if good(t)}
    expected["quality_rules"] = set(kept)
    net = langid.fit(docs.where(docs.doc_id.isin(list(kept))))
    kept = {i: t for i, t in kept.items() if langid._predictions(net, pa.array([t]))[1][0] >= langid.LEAST_SCORE}
    expected["language_id"] = set(kept)
    ids = sorted(kept)
    firsts = brute_components([(i, brute_fingerprint(kept[i])) for i in ids])
    kept = {i: kept[i] for i, c in zip(ids, firsts) if i == c}
    expected["simhash_near_dedup"] = set(kept)
    bad = {d for d, *_ in brute_leaks(list(kept.items()), items)}
    kept = {i: t for i, t in kept.items() if i not in bad}
    expected["decontamination"] = set(kept)
    assert len(docs.collect()) > len(expected["quality_rules"]) > len(expected["simhash_near_dedup"]) > len(kept) > 50
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR)
        assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == expected[name], name
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(result) == set(kept)
    for i, r in result.items():
        ids = LIBRARY.encode_ordinary(kept[i])
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest()


def test_nulls_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    spark.read.parquet(f"{DIR}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "A plain sentence with enough different words to pass every rule that we have here today"
    odd = spark.createDataFrame([(None, None, None, None, None), (None, long, None, None, None), (1, long, "en", None, None), (1, long, "en", None, None), (2, "", "en", "s", 0)], docs.schema)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
