"""An index changed by runs equals one built anew over what is left."""

import random

import pytest
from quillspark.operators import live_index, search
from quillspark.operators.embedding import embed
from quillspark.operators.index import build_index
from quillspark.session import new_work_dir

CHUNK = "chunk_id string, document_id string, source_type string, content string"
WORDS = [f"term{i}" for i in range(30)]


def made(rng, docs, tag=""):
    return [(f"{d}-{i}{tag}", d, "docs", "common " + " ".join(rng.choices(WORDS, k=rng.randint(1, 12))) + f" only{d}{tag}")
            for d in docs for i in range(rng.randint(1, 4))]


def same_as_rebuilt(spark, index, rows):
    rows = spark.createDataFrame(rows, CHUNK)
    fresh = build_index(rows, new_work_dir(spark, "fresh"), dim=8)
    asked = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=4)) + " common") for i in range(6)], "query_id int, query string")
    for name in ("chunks", "chunk_terms", "vectors", "term_stats", "corpus_stats"):
        got, want = getattr(index, name), getattr(fresh, name)
        assert sorted(map(str, got.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect())), name
    for find in (lambda i: search.keyword_topk(asked, i, 5), lambda i: search.vector_topk(embed(asked, "query", "embedding", dim=8), i.vectors, 5)):
        assert sorted(map(tuple, find(index).collect())) == sorted(map(tuple, find(fresh).collect()))


def test_sync_change_delete(spark):
    rng = random.Random(1)
    rows = made(rng, [f"d{i}" for i in range(12)])
    index = live_index.create(spark.createDataFrame(rows, CHUNK), new_work_dir(spark, "live"), dim=8)
    same_as_rebuilt(spark, index, rows)
    # two documents change, one is new, one of the changed ones is named as gone too, one goes, one is unknown
    new = made(rng, ["d1", "d2", "new"], "x")
    gone = spark.createDataFrame([("d2",), ("d5",), ("d5",), ("nobody",)], "document_id string")
    assert index.apply(spark.createDataFrame(new, CHUNK), gone) == 1
    rows = [r for r in rows if r[1] not in ("d1", "d2", "d5")] + new
    same_as_rebuilt(spark, index, rows)
    # a document comes back, another changes again
    new = made(rng, ["d5", "d1"], "y")
    index.apply(spark.createDataFrame(new, CHUNK))
    rows = [r for r in rows if r[1] != "d1"] + new
    assert index.delete(spark.createDataFrame([("new",), ("d7",)], "document_id string")) == 3
    rows = [r for r in rows if r[1] not in ("new", "d7")]
    same_as_rebuilt(spark, index, rows)
    same_as_rebuilt(spark, index.compact(new_work_dir(spark, "compact")), rows)


def test_a_run_that_died_is_not_seen(spark):
    rng = random.Random(2)
    rows = made(rng, ["a", "b"])
    index = live_index.create(spark.createDataFrame(rows, CHUNK), new_work_dir(spark, "live"), dim=8)
    half = made(rng, ["b", "c"], "z")
    # all but the last table of run 1 was written
    spark.createDataFrame(half, CHUNK).write.parquet(f"{index.path}/chunks/run=1")
    spark.createDataFrame([("b",)], "document_id string").write.parquet(f"{index.path}/touched/run=1")
    assert sorted(r["chunk_id"] for r in index.chunks.collect()) == sorted(r[0] for r in rows)
    new = made(rng, ["a"], "n")
    index.apply(spark.createDataFrame(new, CHUNK))
    same_as_rebuilt(spark, index, [r for r in rows if r[1] != "a"] + new)


def test_everything_deleted_and_other_model(spark):
    rows = made(random.Random(3), ["a"])
    index = live_index.create(spark.createDataFrame(rows, CHUNK), new_work_dir(spark, "live"), dim=8)
    with pytest.raises(ValueError):
        index.apply(spark.createDataFrame(rows, CHUNK), embedder=lambda texts: [[0.0] * 8 for _ in texts])
    index.delete(spark.createDataFrame([("a",)], "document_id string"))
    assert index.chunks.count() == index.term_stats.count() == 0 and tuple(index.corpus_stats.first()) == (0, None)
    asked = spark.createDataFrame([(1, "common")], "query_id int, query string")
    assert search.keyword_topk(asked, index, 3).collect() == []


def test_changes_are_small(spark):
    """A run's statistics hold the touched documents' terms only."""
    rng = random.Random(4)
    index = live_index.create(spark.createDataFrame(made(rng, [f"d{i}" for i in range(200)]), CHUNK), new_work_dir(spark, "live"), dim=8)
    index.apply(spark.createDataFrame([("d3-0n", "d3", "docs", "common brandnew")], CHUNK))
    changes = spark.read.parquet(f"{index.path}/term_changes/run=1")
    assert changes.count() < 40 and changes.where("term = 'brandnew'").first()["df"] == 1 and changes.where("term = 'onlyd3'").first()["df"] < 0
    assert spark.read.parquet(f"{index.path}/chunk_terms/run=1").count() == 1


def test_terms_take_their_document_along(spark):
    from quillspark.operators.index import chunk_term_rows

    rows = [("a-0", "a", "docs", "one two"), ("a-0", "b", "docs", "three"), ("c-0", "c", "docs", "one"), (None, "d", "docs", "gone")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, source_type string, content string")
    assert "Join" not in chunk_term_rows(chunks, keep=("document_id",))._jdf.queryExecution().toString()
    index = live_index.create(chunks, new_work_dir(spark, "owners"), dim=4)
    stored = sorted((r["chunk_id"], r["document_id"], r["dl"]) for r in index.live("chunk_terms").collect())
    assert stored == [("a-0", "a", 1), ("a-0", "a", 2), ("a-0", "b", 1), ("a-0", "b", 2), ("c-0", "c", 1)]
