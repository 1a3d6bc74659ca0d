"""Near and exact repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import induced, simhash, suffix_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest index reachable from each fingerprint."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            least = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
            if least < root[i]:
                root[i], changed = least, True
    return root


def test_masks_cover_the_radius():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("limit", [64, 1])
def test_components_of_planted_fingerprints(spark, limit):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centres) | {0, 2**64 - 1, 1 << 63}
    for c in centres:
        chain = c
        for _ in range(12):
            chain ^= 1 << rng.randrange(64)
            chain ^= 1 << rng.randrange(64)
            fps |= {chain, c ^ (1 << rng.randrange(64)) ^ (1 << 63)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit=limit)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups, expected = {}, {}
    for f, w in zip(signed, want):
        groups.setdefault(found.get(f, f), set()).add(f)
        expected.setdefault(w, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    root = brute_components(fps)
    ids = [d for d, *_ in odd_rows]
    want = [(ids[i], f"{fps[i]:016x}", min((ids[j] for j in range(len(ids)) if root[j] == root[i] and ids[j] is not None), default=None))
            for i in range(len(ids))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in kept.collect()]
    assert len(rows) == len(set(root)) and {f for _, f in rows} <= set(fps)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    for members in groups.values():
        first = min((ids[i] is not None, ids[i] or 0) for i in members)
        assert sum(1 for d, f in rows if f in {fps[i] for i in members}) == 1
        assert (first[1] if first[0] else None) in {d for d, f in rows if f in {fps[i] for i in members}}


def sorted_suffixes(data, folder, memory):
    path = folder / "text"
    path.write_bytes(data)
    out, shared = [], []
    induced.InducedSorter(str(path), str(folder), memory).sort(lambda s, p: (out.extend(s.tolist()), shared.extend(p.tolist())))
    for f in folder.iterdir():
        f.unlink()
    return out[::-1], shared[::-1]


@pytest.mark.parametrize("memory, block", [(8, 4), (50, 16), (10**6, 1 << 18)])
def test_induced_sorting(tmp_path, monkeypatch, memory, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = random.Random(memory)
    for trial in range(40):
        data = bytes(rng.choice(range(97, 97 + rng.choice([1, 2, 3, 26]))) for _ in range(rng.randint(1, 300)))
        if trial % 3 == 0:
            data = data[:50] * rng.randint(1, 8) + bytes([rng.choice([0, 255])])
        order, shared = sorted_suffixes(data, tmp_path, memory)
        assert sorted(order) == list(range(len(data)))
        for i, (a, b) in enumerate(zip(order, order[1:])):
            x, y = data[a:a + induced.DEPTH], data[b:b + induced.DEPTH]
            same = next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert x <= y and shared[i] == same


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60, unique=True), st.data())
def test_marks_all_but_the_first_of_a_group(suffixes, data):
    lcp = [0] + [data.draw(st.sampled_from([99, 100])) for _ in suffixes[1:]]
    valid = np.array([data.draw(st.booleans()) for _ in range(61)])
    marked, marks = np.zeros(61, bool), set()
    visitor = induced.RepeatMarks(valid, marked)
    step = data.draw(st.integers(1, 7))
    for lo in range(0, len(suffixes), step):
        visitor(np.array(suffixes[lo:lo + step]), np.array(lcp[lo:lo + step], np.uint8))
    group = []
    for s, p in [*zip(suffixes, lcp), (None, 0)]:
        if p < 100:
            marks |= set(sorted(group)[1:])
            group = []
        if s is not None and valid[s]:
            group.append(s)
    assert set(np.flatnonzero(marked).tolist()) == marks


def brute_repeats(rows, n=100):
    """Per (id, text) of distinct documents in order: bytes, removed, runs, sha256 of the rest, rest."""
    seen, out = set(), {}
    for d, t in rows:
        b, covered = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - n + 1):
            if b[i:i + n] in seen:
                covered[i:i + n] = b"\1" * n
            seen.add(b[i:i + n])
        rest = bytes(c for c, m in zip(b, covered) if not m)
        runs = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out[d, t] = (len(b), len(b) - len(rest), runs, hashlib.sha256(rest).hexdigest())
    return out


def check_repeats(docs, rows):
    got = suffix_dedup.remove_repeats(docs).collect()
    want = brute_repeats(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault((d, len(t.encode())), []).append(t)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == sorted(
        (d, *want[d, t]) for d, t in rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_planted_passages(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([99, 100, 101, 150, 400]))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz ß中") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        rows.append((d, "".join(parts)))
    rows += [(100, "ab" * 200), (101, "q" * 1000), (102, "q" * 99), (103, "abc" * 90 + "ab" * 60), (104, rows[3][1]), (105, "period " * 300)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_repeats_in_the_sample(sample):
    check_repeats(sample, sorted((r["doc_id"], r["text"] or "") for r in sample.collect()))


def test_repeats_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["n_bytes"] == 0 and by[None][0]["n_removed"] == 0
    assert by[18][0] == by[18][1] and by[18][0]["n_removed"] == 0  # repeated rows are one document
    tail = by[12][0]
    assert tail["n_removed"] == len(next(t for d, t, *_ in odd_rows if d == 11).encode()) and bytes(tail["kept"]) == b" tail"
    assert by[14][0]["n_removed"] == 598 and len(by[14][0]["spans"]) == 1
    assert suffix_dedup.remove_repeats(no_docs).collect() == []
    short = suffix_dedup.shorten(odd_docs)
    assert short.columns == odd_docs.columns and short.count() == len(odd_rows)
    kept = {r["doc_id"]: r for r in short.collect()}
    assert kept[12]["text"] == " tail" and kept[12]["n_chars"] == 5 and kept[5]["text"] is None


def test_removal_keeps_whole_characters():
    text = "aé中b".encode()
    assert suffix_dedup.whole_characters(text, [(2, 4)]).decode() == "aé中b"
    assert suffix_dedup.whole_characters(text, [(0, 3)]).decode() == "中b"
