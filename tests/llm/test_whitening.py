"""Whitening against exact arithmetic with fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, n long"


def brute(rows):
    """Of vectors of one length: exact n, deviations and covariances."""
    x = [[math.floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    y = [[n * r[i] - sums[i] for i in range(dim)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n ** 3) for j in range(dim)] for i in range(dim)]
    return n, y, [sum(v * v for v in r) for r in y], cov


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def check(got, rows, components):
    n, y, deviation, cov = brute(rows)
    v = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = {}
    for (vec_id, _), yi, dev in zip(rows, y, deviation, strict=True):
        assert len(got[vec_id]) == min(components, len(yi))
        for k, r in enumerate(got[vec_id]):
            assert (r["component"], r["n"], r["deviation"], r["deviation_digits"]) == (k + 1, n, dev, str(dev))
            assert r["explained"] == pytest.approx(values[k] / v.trace(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            want = np.dot([float(Fraction(c, n)) for c in yi], vectors[:, k]) / math.sqrt(values[k])
            if abs(want) > 1e-3:
                assert signs.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-8)


def test_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert len(rows) > 64
    check(by_row(whitening.whiten(vectors)), rows, 32)


def test_odd_vectors(spark):
    rng = random.Random(4)
    fine = [(i, [rng.gauss(0, 1 + d) for d in range(5)]) for i in range(40)]
    other = [(100 + i, [rng.gauss(0, 3), rng.gauss(5, 1)]) for i in range(30)]
    bad = [(60, None), (61, []), (62, [1.0, None, 2.0, 3.0, 4.0]), (63, [1.0, math.nan, 2.0, 3.0, 4.0]), (64, [math.inf, 1.0, 2.0, 3.0, 4.0])]
    docs = spark.createDataFrame([(i, v, None, 9, 9) for i, v in fine + other + bad], SCHEMA).repartition(3)
    got = by_row(whitening.whiten(docs, components=4))
    assert set(got) == {i for i, _ in fine + other}
    as_floats = [(i, [float(np.float32(c)) for c in v]) for i, v in fine]
    check({i: got[i] for i, _ in fine}, as_floats, 4)
    check({i: got[i] for i, _ in other}, [(i, [float(np.float32(c)) for c in v]) for i, v in other], 4)


def test_repeated_and_equal_rows(spark):
    rows = [(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"], r["n"]) for r in got} == {(None, 0.0, 0, None, 4)}
    few = spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (2, [2.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = by_row(whitening.whiten(few))
    assert [abs(r["whitened"]) if r["whitened"] is not None else None for r in got[1]] == [pytest.approx(1), None, None]


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none.limit(0)).collect() == []


def test_huge_entries(spark):
    rows = [(1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [1e17, -1e200]), (4, [3.0, 4.0])]
    got = by_row(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    top = (1 << 63) - 1
    x = [[top, 128 + 10**6], [-top - 1 + 10**6, 64 + 10**6], [64 * 10**17 + 10**6, -top - 1 + 10**6], [192 + 10**6, 256 + 10**6]]
    s = [sum(r[i] for r in x) for i in (0, 1)]
    for i, r in enumerate(x, 1):
        want = sum((4 * r[d] - s[d]) ** 2 for d in (0, 1))
        assert got[i][0]["deviation_digits"] == str(want) and got[i][0]["deviation"] is None


@pytest.mark.parametrize("reach", [10, 1 << 28, 1 << 45, 1 << 61])
def test_exact_sums(reach):
    rng = np.random.default_rng(1)
    z = rng.integers(-reach, reach, (500, 3))
    assert whitening.square_sums(z).tolist() == [sum(int(v) ** 2 for v in c) for c in z.T]
    assert whitening.column_sums(z) == [sum(map(int, c)) for c in z.T]
    n, sums = 1 << 20, [int(c) for c in rng.integers(-reach, reach, 3)]
    assert (whitening.centred(z, n, sums) == n * z.astype(object) - np.array(sums, object)).all()
