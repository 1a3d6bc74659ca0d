"""Ranked search against a plain scan, and what it leaves unread."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, depth=50):
    """docs: (doc_id, text) with repeats; queries: (item_id, text)."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c in counted:
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        found.sort()
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(found[:depth], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_sample(spark, sample):
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    want = brute(docs, [(r["item_id"], r["text"]) for r in queries.collect()])
    assert got(ranked.search(sample, queries)) == want
    index = ranked.build(sample.repartition(4), shard_bytes=60_000)
    assert index.shards.count() > 8
    assert got(ranked.search(sample, queries, index=index, per_pass=3)) == want


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    queries = [(1, "the WORK is licensed: public 3 é"), (2, None), (3, "..."), (4, "word1 word2 and 77 repeated row one id"), (5, "中文 😀 straße Éa ÉA xxxxx nowhere"), (5, "tail")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in queries], "item_id int, text string, rank int, score int")
    assert got(ranked.search(odd_docs, asked)) == brute([(r[0], r[1]) for r in odd_rows], queries)
    for depth in (1, 3):
        index = ranked.build(odd_docs, shard_bytes=1000)
        assert got(ranked.search(odd_docs, asked, depth, index)) == brute([(r[0], r[1]) for r in odd_rows], queries, depth)
    assert ranked.search(no_docs, asked).collect() == [] and ranked.search(odd_docs, asked.limit(0)).collect() == []
    assert ranked.search(odd_docs, asked).dtypes[:1] == [("item_id", "int")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1é .中\n-Z", max_size=30), max_size=8), st.integers(1, 12))
def test_terms_in_pieces(texts, size):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranked, "PIECE_BYTES", size)
        patch.setattr(ranked._pieces, "__defaults__", (size,))
        names, code, owner, count = ranked.term_counts(pa.array([t.encode() for t in texts], pa.large_binary()))
    found = {(int(o), names[int(c)].as_py().decode()): int(n) for c, o, n in zip(code, owner, count)}
    assert found == {(i, t): n for i, text in enumerate(texts) for t, n in Counter(terms(text)).items()} and len(found) == len(code)


def corpus_of(rows):
    shard = ranked.Shard(ranked.make_shard(pa.array(range(len(rows))), pa.array([t.encode() for t in rows], pa.large_binary())))
    return shard, ranked.Corpus(len(rows), int(shard.lengths.sum()))


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    rows = [" ".join(["often"] * int(rng.integers(0, 600)) + ["rare"] * (i % 997 == 5) + ["all", f"own{i}"]) for i in range(3000)] + ["all " + "x " * 70_000]
    shard, _ = corpus_of(rows)
    for t, name in enumerate(shard.terms.to_pylist()):
        if name.startswith(b"own"):
            continue
        docs, tf = shard.blocks(t, np.arange(int(shard.n_blocks[t])))
        want = [(i, c) for i, r in enumerate(rows) if (c := r.split().count(name.decode()))]
        assert list(zip(docs.tolist(), tf.tolist())) == want
        middle = np.array([int(shard.n_blocks[t]) // 2])
        docs, tf = shard.blocks(t, middle)
        assert list(zip(docs.tolist(), tf.tolist())) == want[int(middle[0]) * ranked.BLOCK:][:ranked.BLOCK]


def test_blocks_left_unread():
    """A rare term decides, so few blocks of the frequent ones are decompressed; the scores are those of a full reading."""
    rows = [f"common usual{' usual' * (i % 7)} w{i}" + " key" * (i % 400 == 0) for i in range(30_000)]
    shard, corpus = corpus_of(rows)
    number = {t: i for i, t in enumerate(shard.terms.to_pylist())}
    asked = [(number[t], corpus.weight(int(shard.df[number[t]]))) for t in (b"common", b"usual", b"key")]
    asked = [(t, w) for t, w in asked if w > 0] + [(number[b"common"], 3)]
    heap = ranked.Heap(10)
    ranked.Searcher(shard, corpus).search(asked, heap)
    blocks = sum(int(shard.n_blocks[t]) for t, _ in asked)
    assert 0 < shard.decoded < blocks / 2
    full = np.zeros(len(rows), np.int64)
    searcher = ranked.Searcher(shard, corpus)
    for t, w in asked:
        docs, part = searcher.whole(t)
        full[docs] += w * part
    best = np.lexsort((np.arange(len(rows)), -full))[:10]
    assert heap.ids.tolist() == best.tolist() and heap.scores.tolist() == full[best].tolist()


def test_norms_beyond_64_bits():
    corpus = ranked.Corpus(10**15, 10**17)
    assert corpus.norm(np.array([1, 10**9, 7])).tolist() == [50 + 50 * n * 10**15 // 10**17 for n in (1, 10**9, 7)]


def test_files_and_batches_hold_few_shards(spark):
    """A task's shards are read in row groups and Arrow batches of bounded size, however many a task has written."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 10**9, 40_000))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = ranked.build(docs, shard_bytes=1 << 20)
    files = ds.dataset(index.path.removeprefix("file:"), format="parquet").files
    groups = [pq.ParquetFile(f).metadata for f in files]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in groups) >= 12 and sum(sizes) > 12 << 20
    assert max(sizes) <= 8 << 20

    def held(batches):
        for batch in batches:
            least = min(batch.slice(i, 1).nbytes for i in range(batch.num_rows))
            yield pa.record_batch([pa.array([batch.nbytes - least])], ["beside"])

    assert max(r["beside"] for r in index.shards.mapInArrow(held, "beside long").collect()) <= ranked.BATCH_BYTES
    queries = [(i, t[:100]) for i, t in rows[:3]]
    asked = spark.createDataFrame(queries, "item_id int, text string")
    assert got(ranked.search(docs, asked, index=index)) == brute(rows, queries)
