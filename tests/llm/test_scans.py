"""License scan, document fingerprints and neighbour search against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, imatch, license_scan

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases(spark, odd_docs, odd_rows, sample, no_docs):
    for docs, rows in ((odd_docs, odd_rows), (sample, [(r["doc_id"], r["text"]) for r in sample.collect()])):
        got = license_scan.scan(docs).collect()
        want = [(d, *brute_licenses(t)) for d, t in {(d, t) for d, t, *_ in rows}]
        assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(want, key=str)
    assert license_scan.scan(no_docs).collect() == []


def test_notices_with_words_added_or_left_out(spark):
    notice = dict((label, text) for text, label in license_scan.NOTICES if label == "bsd")["bsd"]
    changed = notice.replace("source and", "any source code and").replace("following ", "")
    rows = [(1, f"before {notice.upper()}! after"), (2, f"before {changed} after"), (3, " ".join(notice.split()[:8])), (4, "redistribution of use and in source")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["score"] == 1.0 and got[1]["n_spans"] == 1
    assert got[2]["labels"] == "bsd" and 0.6 < got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.6 and got[4]["labels"] == ""


def test_a_document_that_repeats_a_phrase(spark):
    got = license_scan.scan(spark.createDataFrame([(1, "cc by " * 5000), (2, "all rights reserved")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (5000, 0, 9998)
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["score"]) == (1, "reserved", 1.0)


def brute_edits(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        q = len(t) // 4
        edited = t[:len(t) - q] + rows[(i + 1) % len(rows)][1][:q]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("blocks", [1, 3, 512])
def test_edits_and_next_documents(odd_docs, odd_rows, monkeypatch, blocks):
    monkeypatch.setattr(imatch.with_next, "__defaults__", (blocks,))
    got = imatch.compare_edits(odd_docs).collect()
    want = brute_edits([(d, t or "") for d, t, *_ in odd_rows])
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[16]["fingerprint"] == by[17]["fingerprint"] and by[16]["near_next"] == 1.0
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and set(by[5]["fingerprint"]) == {"0"}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_no_documents_and_a_single_one(spark, no_docs):
    assert imatch.compare_edits(no_docs).collect() == []
    row = imatch.compare_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


def test_fingerprints_by_brute_force(spark, sample):
    import xxhash

    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    terms = {d: set(re.findall(r"[^\W_]+", t.lower())) for d, t in rows}
    df = {}
    for found in terms.values():
        for t in found:
            df[t] = df.get(t, 0) + 1
    n = len(rows)
    band = {t for t, c in df.items() if max(2, imatch.LOW * n) <= c <= max(2, imatch.HIGH * n)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    code = {t: signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in df}
    hashed = {r["code"]: r for r in imatch.lexicon(sample).collect()}
    assert set(hashed) == {code[t] for t in band} | {0}
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(sample).collect()}
    for d, found in terms.items():
        kept = sorted(code[t] for t in found & band)
        if not kept:
            continue
        parts = [kept] + [[c for c in kept if hashed[c][f"r{s}"] & (((1 << s) - 1) << i * s) == 0] for s in imatch.SIZES for i in range(8)]
        want = ""
        for part in parts:
            x = 0
            for c in part:
                x ^= hashed[c]["h"]
            want += f"{(x & 0x3FFFFFFF) + 1 if part else 0:08x}"
        assert got[d] == want


def test_native_plan_has_no_python(sample):
    plan = imatch.compare_edits(sample)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int, block long")


def brute_neighbours(rows, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in x:
        if q % 20 == 0:
            near = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.integers(-3, 4, 3).astype(float) + [0, 0, 5]) for i in range(0, 15)]
    bad = [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 2.0]), (23, [float("nan"), 1.0, 1.0]), (24, [float("inf"), 1.0, 0.0]),
           (25, []), (26, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows = [(i, None if v is None else [x if x is None else float(x) for x in v], 1, 0.1, 2, 3) for i, v in [*good, *bad, good[4]]]
    got = ann.search(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    want = brute_neighbours(good, 20)
    assert [(r["query_id"], r["rank"], r["vec_id"], pytest.approx(r["score"])) for r in got] == [
        (q, n, i, s) for q in sorted(want) for n, (i, s) in enumerate(want[q], 1)]
    assert ann.search(vectors(spark, [])).collect() == [] and ann.search(vectors(spark, rows[15:])).count() == 0


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 2.0 + i % 2]) for i in range(200)]
    got = ann.search(vectors(spark, [(i, v, 0, 0.0, 0, 0) for i, v in rows])).orderBy("query_id", "rank").collect()
    want = brute_neighbours(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == want


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 20)
    found = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(found[q]) == 20 for q in want)
    assert np.mean([len(found[q] & {i for i, _ in near}) / 20 for q, near in want.items()]) >= 0.9


def test_probes_come_in_order_of_success():
    lsh = ann.PStable(8, tables=1, directions=3)
    unit = np.random.default_rng(3).normal(size=(4, 9))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    names = lsh.probes(0, unit, 27)
    cell, part = lsh.cells(0, unit)
    assert (names[:, 0] == lsh.key(cell)).all() and all(len(set(r)) == 27 for r in names.tolist())
    cost = {int(lsh.key(cell[0] + m)): sum(p * p if d < 0 else (1 - p) ** 2 if d > 0 else 0 for p, d in zip(part[0], m)) for m in lsh.moves.tolist()}
    assert all(cost[a] <= cost[b] + 1e-12 for a, b in zip(names[0].tolist(), names[0].tolist()[1:]))
