import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.arrays import offsets
from quillspark.operators import context, search
from quillspark.operators.embedding import check_vectors, embed
from quillspark.operators.index import build_index, counted_terms
from quillspark.session import new_work_dir

WORDS = [f"term{i}" for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for d in range(30):
        for c in range(rng.randint(1, 12)):
            # Every third chunk is the same text, and one word is in all of them.
            text = "the same copied words" if (d + c) % 3 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(3, 30)))
            rows.append((f"d{d}-{c}", f"d{d}", c, "docs" if d % 2 else "other", f"common {text}", f"Title {d}"))
    chunks = spark.createDataFrame(
        rows, "chunk_id string, document_id string, chunk_index int, source_type string, content string, document_title string")
    return rows, build_index(chunks, new_work_dir(spark, "test-index"), dim=16)


def queries(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=6)) + (" common same" if i % 2 else "")) for i in range(12)]
    return spark.createDataFrame(rows, "query_id bigint, query string"), rows


def brute_bm25(rows, query, k, allowed=None):
    docs = {r[0]: r[4].lower().split() for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    kind = {r[0]: r[3] for r in rows}
    scored = []
    for cid, words in docs.items():
        if allowed is not None and kind[cid] not in allowed:
            continue
        tf = Counter(words)
        s = sum(
            math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / avg))
            for t in query.split() if t in tf)
        if s > 0:
            scored.append((-round(s, 9), cid))
    return [(cid, pytest.approx(-s)) for s, cid in sorted(scored)[:k]]


def got(ranked):
    out = {}
    for r in ranked.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_keyword_ranking_against_brute_force(spark, corpus, shuffled):
    rows, index = corpus
    df, raw = queries(spark)
    hits = got(search.keyword_topk(df, index, 7, default_source=None, force_shuffle=shuffled))
    assert hits == {i: brute_bm25(rows, q, 7) for i, q in raw}


def test_source_filter_fails_closed(spark, corpus):
    rows, index = corpus
    df, raw = queries(spark)
    assert got(search.keyword_topk(df, index, 5)) == {i: brute_bm25(rows, q, 5, {"docs"}) for i, q in raw}
    assert got(search.keyword_topk(df, index, 5, allowed=["other"])) == {i: brute_bm25(rows, q, 5, {"other"}) for i, q in raw}
    assert search.keyword_topk(df, index, 5, allowed=[]).count() == 0


def test_own_depth_per_query_and_blank_queries(spark, corpus):
    _, index = corpus
    df = spark.createDataFrame([(1, "common", 2), (2, "common", 4), (3, "  ", 5), (4, "absent", 5)], "query_id int, query string, top_k int")
    hits = got(search.keyword_topk(df, index, default_source=None))
    assert {q: len(h) for q, h in hits.items()} == {1: 2, 2: 4}
    with pytest.raises(ValueError):
        search.keyword_topk(df, index, 0)


@pytest.mark.parametrize("limit", [8192, 4])
def test_cosine_ranking_against_brute_force(spark, corpus, monkeypatch, limit):
    _, index = corpus
    monkeypatch.setattr(search, "MAX_SHARED_VECTORS", limit)  # 4 forces blocks of queries
    df, _ = queries(spark)
    vectors = embed(df, "query", "embedding", dim=16)
    hits = got(search.vector_topk(vectors, index.vectors, 6, default_source=None))
    stored = {r["chunk_id"]: np.array(r["embedding"], dtype=float) for r in index.vectors.collect()}
    for r in vectors.collect():
        v = np.array(r["embedding"], dtype=float)
        scores = sorted((-round(float(v @ s) / (np.linalg.norm(v) * np.linalg.norm(s)), 9), c) for c, s in stored.items() if s.any())
        assert hits[r["query_id"]] == [(c, pytest.approx(-s, abs=1e-8)) for s, c in scores[:6]]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    limits = spark.createDataFrame([(1, 2)], "query_id int, _k int")
    assert got(search.rrf_fuse([a, b], limits)) == {1: [("y", pytest.approx(1 / 61 + 1 / 62)), ("x", pytest.approx(1 / 61))]}


def test_hybrid_uses_both_arms(spark, corpus):
    _, index = corpus
    df, _ = queries(spark)
    hits = got(search.hybrid_topk(embed(df, "query", "embedding", dim=16), index, 5, default_source=None))
    assert len(hits) == 12 and all(len(h) == 5 and all(0 < s <= 2 / 61 for _, s in h) for h in hits.values())


def test_cap_per_document(spark):
    rows = [(1, 1, "a1", "a"), (1, 2, "a2", "a"), (1, 3, "n1", None), (1, 4, "b1", "b"), (1, 5, "n2", ""), (1, 6, "n3", ""), (2, 1, "a1", "a")]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, document_id string")
    keep = lambda m: [r["chunk_id"] for r in search.cap_per_document(df, m).orderBy("query_id", "rank").collect()]
    assert keep(1) == ["a1", "n1", "b1", "n2", "n3", "a1"] and len(keep(0)) == 7


def test_citation_defaults(spark):
    df = spark.createDataFrame([(1, 1, "c", 0.5)], "query_id int, rank int, chunk_id string, score double")
    row = search.citation_rows(df).drop("query_id", "rank").first().asDict()
    assert row == {"chunk_id": "c", "content": "", "document_id": "", "document_title": "", "document_url": None,
                   "document_content_path": None, "source_type": "", "section_path": [], "anchor": None, "chunk_index": 0}


@pytest.mark.parametrize("raw,query,k,error", [
    ('{"query": " a b ", "top_k": null}', "a b", 10, None), ('{"query": "q", "top_k": 9999}', "q", 30, None),
    ('{"query": "q", "top_k": 0}', "q", 1, None), ('{"query": "q", "top_k": -5}', "q", 1, None),
    ('{"query": "q", "top_k": "7"}', "q", 7, None), ('{"query": "q", "top_k": "seven"}', "q", 10, None),
    ('{"query": "q", "top_k": 7.9}', "q", 7, None), ("  ", None, 10, "missing required parameter: query"),
    (None, None, 10, "missing required parameter: query"), ("{bad", None, None, "invalid JSON arguments"),
    ("[1]", None, None, "invalid JSON arguments"), ('{"query": "q"}]', None, None, "invalid JSON arguments"),
    ('{"query": "q"}, {"query": "r"}', None, None, "invalid JSON arguments"), ('"s"', None, None, "invalid JSON arguments"),
])
def test_query_args(spark, raw, query, k, error):
    row = search.parse_query_args(spark.createDataFrame([(raw,)], "arguments string")).first()
    assert (row["query"], row["top_k"], row["error"]) == (query, k, error)


def hits_df(spark, rows):
    return spark.createDataFrame(
        [(q, r, f"{d}-{i}", f"t{i}", d, f"T {d}", None, None, "docs", ["S"], f"a{i}", i) for q, r, d, i in rows],
        "query_id int, rank int, chunk_id string, content string, document_id string, document_title string, document_url string, "
        "document_content_path string, source_type string, section_path array<string>, anchor string, chunk_index int")


def stored_chunks(spark, n=10):
    return hits_df(spark, [(0, 0, d, i) for d in ("a", "b") for i in range(n)]).drop("query_id", "rank")


def test_neighbours(spark):
    near = context.neighbours(hits_df(spark, [(1, 1, "a", 2)]), stored_chunks(spark, 5))
    assert sorted(r["chunk_index"] for r in near.collect()) == [1, 2, 3]


def test_spans(spark):
    hits = hits_df(spark, [(1, 1, "b", 6), (1, 2, "a", 0), (1, 3, "b", 1), (1, 4, "b", 4), (1, 5, "zz", 3)])
    rows = context.expand_and_merge(hits, stored_chunks(spark)).orderBy("position").collect()
    # In b the windows 0-2, 3-5 and 5-7 touch, so they are one span cited by its first hit.
    assert [(r["document_id"], r["chunk_id"], r["anchor"], r["content"].split("\n\n")) for r in rows] == [
        ("b", "b-1", "a1", [f"t{i}" for i in range(8)]), ("a", "a-0", "a0", ["t0", "t1"]), ("zz", "zz-3", "a3", ["t3"])]
    whole = context.expand_and_merge(hits, stored_chunks(spark), window=0)
    assert whole.count() == 5


def test_search_text(spark):
    hits = hits_df(spark, [(1, 1, "a", 4)])
    spans = context.expand_and_merge(hits, stored_chunks(spark))
    qs = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {r["query_id"]: r["text"] for r in context.search_text(qs, spans).collect()}
    assert rows == {1: "[c:a-4] T a › S\nt3\n\nt4\n\nt5", 2: context.NO_RESULTS}


def test_render_documents(spark):
    docs = spark.createDataFrame([("a", "Doc A"), ("b", "Doc B"), ("e", "Empty")], "document_id string, title string")
    rows = [("a", f"a-{i}", i, " " if i == 2 else f"text {i}", ["P", str(i // 3)]) for i in range(8)] + [("b", "b-0", 0, "x", [])]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, content string, section_path array<string>")
    asked = spark.createDataFrame([("a",), (" b ",), ("e",), ("q",), ("out",), ("",)], "document_id string")
    library = spark.createDataFrame([("a",), ("b",), ("e",), ("q",)], "document_id string")
    out = {r["document_id"]: r for r in context.render_documents(asked, docs, chunks, 1000, library).collect()}
    assert out["a"]["text"] == (
        "# Doc A\n\n\n[c:a-0] P › 0\n\ntext 0\n\n[c:a-1] text 1\n\n[c:a-3] P › 1\n\ntext 3\n\n[c:a-4] text 4\n\n"
        "[c:a-5] text 5\n\n[c:a-6] P › 2\n\ntext 6\n\n[c:a-7] text 7")
    assert out["b"]["text"] == "# Doc B\n\n\n[c:b-0] x"
    assert out["e"]["error"] == "no chunks available for document: e"
    assert out["q"]["error"] == "document not found: q" and "not in the current library" in out["out"]["error"]
    assert out[""]["error"] == "missing required parameter: document_id"
    cut = {r["document_id"]: r for r in context.render_documents(asked, docs, chunks, 60, library).collect()}["a"]
    assert cut["kept_chunks"] == 2 and cut["dropped_chunks"] == 5
    assert cut["text"].endswith("[c:a-1] text 1\n\n\n[document truncated — 5 more chunks omitted to stay within the 60-character cap for tool responses]")


def test_user_embedder(spark):
    df = spark.createDataFrame([("abc",), ("z",)], "content string")
    rows = embed(df, dim=2, embedder=lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [r["embedding"] for r in rows] == [[3.0, 1.0], [1.0, 1.0]]
    for bad in (lambda texts: [[1.0]] * len(texts), lambda texts: []):
        with pytest.raises(Exception, match="embedder answered"):
            embed(df, dim=2, embedder=bad).collect()
    with pytest.raises(Exception, match="cannot embed a blank text"):
        embed(spark.createDataFrame([(" ",)], "content string"), dim=2, embedder=lambda t: [[0.0, 0.0]] * len(t)).collect()
    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert check_vectors(good, dim=2).count() == 1
    with pytest.raises(Exception, match="embedding is not 3 long"):
        check_vectors(good, dim=3).collect()


def test_counted_terms(spark):
    df = spark.createDataFrame([("b a B c a a",), ("",)], "t string")
    rows = df.select(counted_terms("t").alias("c")).collect()
    assert [tuple(x) for x in rows[0]["c"]] == [("a", 3), ("b", 2), ("c", 1)] and rows[1]["c"] == []


def test_offsets_of_long_arrays(spark):
    sizes = [i % 7 for i in range(1500)]
    got_ = spark.createDataFrame([(sizes,), ([],)], "a array<int>").select(offsets(F.col("a")).alias("o")).collect()
    assert got_[0]["o"] == [sum(sizes[:i]) for i in range(1500)] and got_[1]["o"] == []


def test_searches_take_the_pattern_of_the_index(spark):
    chunks = spark.createDataFrame(
        [("d-0", "d", "docs", "alpha-beta gamma", 0), ("d-1", "d", "docs", "alpha beta", 1)],
        "chunk_id string, document_id string, source_type string, content string, chunk_index int")
    index = build_index(chunks, new_work_dir(spark, "pattern-index"), dim=8, term_re=r"[^ ]+")
    queries = spark.createDataFrame([(1, "Alpha-Beta")], "query_id int, query string")
    assert [r["chunk_id"] for r in search.keyword_topk(queries, index, 5).collect()] == ["d-0"]
    assert index.settings.asDict() == {"term_re": r"[^ ]+", "dim": 8, "embedder": "hashed"}
    with pytest.raises(ValueError, match="embedded by hashed"):
        index.check_embedder(lambda texts: [[0.0] * 8] * len(texts))


def test_k_beyond_the_default_limits(spark):
    vectors = spark.createDataFrame([(f"c{i:03d}", "docs", [1.0, i / 200]) for i in range(200)], "chunk_id string, source_type string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 150), (2, [1.0, 0.0], None)], "query_id int, embedding array<float>, top_k int")
    found = search.vector_topk(queries, vectors, 100)
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert counts == {1: 150, 2: 100}
    with pytest.raises(ValueError):
        search.vector_topk(queries, vectors, 0)


def test_shuffled_way_makes_no_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 60, raising=False)
    monkeypatch.setattr(search, "MAX_BLOCK_QUERIES", 3, raising=False)
    rows = [(f"c{i}", f"d{i}", 0, "docs", f"every {WORDS[i % len(WORDS)]} chunk" + " holds" * (i % 3), "t") for i in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, source_type string, content string, document_title string")
    index = build_index(chunks, new_work_dir(spark, "cells-index"), dim=4)
    qs = spark.createDataFrame([(i, f"every {WORDS[i % len(WORDS)]} chunk holds holds") for i in range(10)], "query_id int, query string")
    hits = search.keyword_topk(qs, index, 7, force_shuffle=True)
    # terms stay in their chunk's row: no exploded postings, no join by term
    plan = hits._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(terms" not in plan
    assert got(hits) == {r["query_id"]: brute_bm25(rows, r["query"], 7) for r in qs.collect()} == got(search.keyword_topk(qs, index, 7))
