"""Near copies of the pipeline's stage against all pairs' exact shingle similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest

from quillspark.llm import near_copies

DOCS = "doc_id long, text string"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    both = len(a & b)
    return both * 5 >= (len(a) + len(b) - both) * 4


def brute_kept(rows):
    """Smallest id of each component of the similar rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return words


def test_edited_copies_go(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(264)]
        copy = edited(rng, words, rng.choice([1, 2, 4, 5]))
        while not alike(shingles(" ".join(words)), shingles(" ".join(copy))):
            copy = edited(rng, words, 4)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * i for i in range(60)]


@pytest.mark.parametrize(("paired", "frequent", "known"), [(32, 10**6, 10**6), (2, 10**6, 0), (2, 3, 10**6)])
def test_large_groups_and_near_misses(spark, paired, frequent, known):
    """Copies that are similar to a base, to a copy or to nothing, also where a bucket has more members than are paired."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [base] * 3 + [edited(rng, base, rng.randrange(1, 8)) for _ in range(60)]
    for words in [*texts[-10:]]:
        texts += [edited(rng, words, 2) for _ in range(3)]
    other = [f"v{rng.randrange(900)}" for _ in range(120)]
    texts += [other, other[:96], other[:100], other[10:], other[:60] + base[:60], ["a"], ["a"], ["a", "b"], [], ["A"]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS).repartition(3), paired, frequent, known)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    kept = near_copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and near_copies.keep_one(no_docs).collect() == []
    rows = [(-1 if d is None else d, t or "") for d, t, *_ in odd_rows]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_sample(sample):
    rows = [(r["doc_id"], r["text"] or "") for r in sample.collect()]
    assert sorted(r["doc_id"] for r in near_copies.keep_one(sample).collect()) == brute_kept(rows)


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """5000 unlinked documents that share a passage, a third of their words, and a group of near copies."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) + " " + passage) for i in range(5000)]
    base = rows[0][1].split()
    rows += [(10_000 + i, " ".join(edited(rng, base, 1))) for i in range(100)]
    tried = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: (tried.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(near_copies, "_crossed", lambda *a: pytest.fail("nothing is left to compare"))
    kept = near_copies.keep_one(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(5000))
    assert sum(tried) < 20_000  # 100 near copies; all pairs of the passage would be 12 million


def test_blocks_of_a_large_group():
    """Links found in blocks join what all similar pairs join."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = []
    for i in range(120):
        s = base.copy()
        s[rng.choice(400, int(rng.integers(25, 130)), replace=False)] = rng.integers(0, 1 << 63, 1, np.uint64) + np.uint64(i)
        sets.append(np.unique(s))
    nodes = [(i, i, s) for i, s in enumerate(sets)]

    def parts(links):
        top = list(range(len(sets)))
        for a, b in links:
            old, new = top[a], top[b]
            top = [new if t == old else t for t in top]
        return {frozenset(i for i, t in enumerate(top) if t == r) for r in top}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if near_copies.similar(sets[i], sets[j])]
    found = [x for lo in range(0, 120, 40) for at in range(0, 120, 50) for x in near_copies.joining_links(nodes[lo:lo + 40], nodes[at:at + 50])]
    assert 3 < len(parts(every)) < 100 and parts(found) == parts(every)


def test_prefixes_order():
    sets = [np.array(sorted({5 << 32, 7 << 32, 9 << 32, 11 << 32, 20 << 32}), np.uint64), np.array([3 << 32], np.uint64), np.zeros(0, np.uint64)]
    frequent = np.array([5, 7, 9, 11], np.uint64), np.array([90, 50, 70, 50])
    assert [(p >> np.uint64(32)).tolist() for p in near_copies.prefixes(sets, frequent)] == [[20, 7], [3], []]
    assert near_copies._unpacked(near_copies._packed(np.array([1, 7, (1 << 32) - 1], np.uint64))).tolist() == [1, 7, (1 << 32) - 1]


def test_stage_takes_simhash_components_too(spark):
    from quillspark.llm import near_copies, simhash, stages

    base = "alpha beta gamma " * 100
    rows = [(i, base + " ".join(f"w{i}x{j}" for j in range(12)), None, None, 0) for i in range(3)] + [(9, "another text with words of its own", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert near_copies.keep_one(docs).count() == 4  # unlike by their sets of shingles
    assert simhash.keep_one(docs).count() == 2
    assert sorted(r["doc_id"] for r in stages.keep_one_of_near_copies(spark, docs, "").collect()) == [0, 9]
