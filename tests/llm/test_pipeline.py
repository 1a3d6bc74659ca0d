"""The pipeline's stages against brute force, and the queries' columns."""

import hashlib

import corpus_pipeline
from quillspark.llm import langid, quality, queries, stages
from test_duplicates import brute_components, brute_fingerprint, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, sample, odd_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = sample
    good = stages.keep_good(spark, docs, SF)
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in score.items() if s >= 0.5}
    known = stages.keep_known_language(spark, good, SF)
    found = langid.predict(good, langid.train(good)).collect()
    assert {r["doc_id"] for r in known.collect()} == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.3}
    rows = sorted((r["doc_id"], r["text"]) for r in known.collect())
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    single = stages.keep_one_of_each_group(spark, known, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == [d for i, (d, _) in enumerate(rows) if root[i] == i]
    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    want = brute_repeats(rows)
    short = stages.remove_repeats(spark, single, SF).collect()
    assert len(short) == len(rows)
    for r in short:  # characters stay whole, so at most three bytes on either side of a run are left
        n, removed, runs, sha = want[r["doc_id"], dict(rows)[r["doc_id"]]]
        left = len(r["text"].encode())
        assert n - removed <= left <= n - removed + 6 * runs and r["n_chars"] == len(r["text"])
        assert left > n - removed or hashlib.sha256(r["text"].encode()).hexdigest() == sha
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns, name
        assert stage(spark, no_docs, SF).collect() == [], name


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_a_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
