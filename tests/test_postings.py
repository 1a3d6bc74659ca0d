"""Pruned keyword search against the full scan, and the postings it leaves out."""

import random
from collections import Counter

import pytest
from quillspark.operators import postings, search
from quillspark.operators.index import build_index
from quillspark.session import new_work_dir
from test_search import WORDS, brute_bm25, got


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", f"d{i // 9}", i % 9, "docs" if i % 3 else "other",
             "common usual " + " ".join(rng.choices(WORDS, k=rng.randint(1, 9))) + (" seldom" * (1 + i % 4) if i % 25 == 0 else ""), "t") for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, source_type string, content string, document_title string")
    index = build_index(chunks, new_work_dir(spark, "postings-index"), dim=4)
    postings.build_postings(index, depth=16)
    return rows, index


@pytest.mark.parametrize(("k", "allowed"), [(5, None), (1, None), (30, None), (5, {"other"}), (5, set())])
def test_rows_of_the_scan(spark, corpus, k, allowed):
    rows, index = corpus
    rng = random.Random(k)
    raw = [(i, " ".join(rng.choices(WORDS, k=3)) + (" seldom common usual" if i % 2 else " common usual")) for i in range(8)]
    raw += [(8, "common"), (9, "usual common usual"), (10, "absent"), (11, " ")]
    df = spark.createDataFrame(raw, "query_id bigint, query string")
    options = {"default_source": None} if allowed is None else {"allowed": sorted(allowed)}
    hits = got(postings.keyword_topk_pruned(df, index, k, **options))
    assert hits == {i: found for i, q in raw if (found := brute_bm25(rows, q, k, allowed))}
    assert hits == got(search.keyword_topk(df, index, k, **options))


def test_frequent_terms_are_left_out(spark, corpus):
    rows, index = corpus
    df = spark.createDataFrame([(1, "seldom common usual")], "query_id bigint, query string")
    weights = search.query_weights(search.query_terms(df), index).select("query_id", "term", "weight")
    limits = spark.createDataFrame([(1, 5)], "query_id bigint, _k int")
    found = {r["term"]: r["essential"] for r in postings.term_bounds(weights, limits, index, None, None).collect()}
    assert found == {"seldom": True, "common": False, "usual": False}
    read = postings.postings(index).where("term = 'seldom'").count()
    assert read == 16 and postings.postings(index).where("term IN ('common', 'usual')").count() == 800


def test_own_depths(spark, corpus):
    rows, index = corpus
    df = spark.createDataFrame([(1, "seldom common", 2), (2, "seldom common", 100), (3, "term1 common", 3)], "query_id int, query string, top_k int")
    hits = got(postings.keyword_topk_pruned(df, index, default_source=None))
    assert hits == {1: brute_bm25(rows, "seldom common", 2), 2: brute_bm25(rows, "seldom common", 100), 3: brute_bm25(rows, "term1 common", 3)}


def test_blocks_are_cut_inside_tasks(spark, corpus, monkeypatch):
    """Every block is bounded, chunks of one id meet in one block, and nothing is stored twice or lost."""
    rows, _ = corpus
    rows = [*rows, ("same", "d", 0, "docs", "usual term1 term2", "t"), ("long", "d", 1, "docs", " ".join(f"w{i}" for i in range(60)), "t"), ("none", "d", 2, "docs", " ", "t")]
    rows += [(f"twice{i % 4}", "d", i, "docs", "seldom twice common" + " again" * i, "t") for i in range(8)] + [("same", "d", 9, "docs", "usual term1", "t")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, source_type string, content string, document_title string")
    index = build_index(chunks.repartition(3), new_work_dir(spark, "cut-index"), dim=4)
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 50)
    postings.build_postings(index)
    stored = postings.postings(index).collect()
    sizes, ids = Counter(p["block"] for p in stored), {r["block"]: r["ids"] for r in spark.read.parquet(f"{index.path}/postings").where("term IS NULL").collect()}
    place = {b: Counter(found) for b, found in ids.items()}
    repeated = {"same", "twice0", "twice1", "twice2", "twice3"}
    assert all(n <= 50 or ids[b] == ["long"] for b, n in sizes.items() if not repeated & set(ids[b]))
    assert sum(place.values(), Counter()) == Counter(r[0] for r in rows)
    assert all(sum(i in found for found in place.values()) == 1 for i in repeated)
    got_postings = Counter((ids[p["block"]][p["at"]], p["source_type"], p["term"], p["tf"]) for p in stored)
    whole = index.chunk_terms.selectExpr("chunk_id", "source_type", "inline(terms)").collect()
    assert got_postings == Counter(tuple(r) for r in whole)
    asked = spark.createDataFrame([(1, "w7 w9 again"), (2, "term1 term2")], "query_id bigint, query string")
    unlike = [r for r in rows if r[0] not in repeated]
    index = build_index(spark.createDataFrame(unlike, chunks.schema).repartition(3), new_work_dir(spark, "cut-unlike"), dim=4)
    postings.build_postings(index, depth=16)
    assert got(postings.keyword_topk_pruned(asked, index, 20, default_source=None)) == {
        1: brute_bm25(unlike, "w7 w9 again", 20), 2: brute_bm25(unlike, "term1 term2", 20)}
