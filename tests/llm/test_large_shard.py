"""A shard of many times the sorter's memory takes no more of it, and gives what a shard in memory gives."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import induced, suffix_dedup


def rows(n):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(40)]
    return [(k, 7, 0, (rng.choice(passages) + " " + " ".join(rng.choice(words) for _ in range(20))).encode()) for k in range(n)]


def batches(table):
    names = ["k", "th", "start", "text"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for lo in range(0, len(table), 100):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*table[lo:lo + 100]), types)], names)


def limited(monkeypatch, memory):
    monkeypatch.setattr(induced, "BLOCK", memory // 4)
    monkeypatch.setattr(suffix_dedup, "BLOCK", memory // 4)
    sorter = induced.InducedSorter
    monkeypatch.setattr(suffix_dedup, "InducedSorter", lambda path, folder: sorter(path, folder, memory))


def test_memory_of_a_large_shard(monkeypatch):
    table = rows(6000)
    want = [r for b in suffix_dedup._shard_repeats(batches(table)) for r in b.to_pylist()]
    limited(monkeypatch, 1 << 13)
    tracemalloc.start()
    got, peak = [], 0
    for b in suffix_dedup._shard_repeats(batches(table)):
        got.append(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r for b in got for r in b.to_pylist()] == want and len(want) > 5000
    assert peak < 5 << 20, peak  # the seeds alone would be 3 MB in each array of eight bytes


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_runs_across_blocks(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(50):
        marked = np.array([rng.random() < 0.6 for _ in range(rng.randint(1, 30))])
        padded = [False, *marked.tolist(), False]
        want = [(i, next(j for j in range(i, 31) if not padded[j + 1])) for i in range(len(marked)) if padded[i + 1] and not padded[i]]
        assert [x for a, b in suffix_dedup._runs(marked) for x in zip(a.tolist(), b.tolist())] == want


def test_a_long_text_is_read_in_blocks(monkeypatch):
    monkeypatch.setitem(suffix_dedup.SLICE, "size", 5000)
    rng = random.Random(5)
    table = [(k, 7, "".join(rng.choice("abcdefghij") for _ in range(n))) for k, n in [(1, 23_456), (2, 99), (3, 300), (4, 5099), (5, 0)]]
    batch = pa.record_batch([pa.array(c) for c in zip(*table)], ["k", "th", "text"])
    found = [r for b in suffix_dedup._found([batch]) for r in b.to_pylist()]
    assert not any(r["repeat"] for r in found)
    for k, _, text in table:
        at = 0
        for start, n in sorted((r["start"], r["n"]) for r in found if r["k"] == k):
            assert start == at
            at += n
        assert at == max(0, len(text) - 99)


def test_a_passage_across_the_border_of_blocks(spark):
    rng, size = random.Random(6), suffix_dedup.SLICE["size"]
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage = noise(400)
    rows = [(1, noise(size - 200) + passage + noise(50_000) + passage + noise(10)), (2, noise(30) + passage), (3, noise(500))]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(size + 50_200, size + 50_600)], 2: [(30, 430)], 3: []}
