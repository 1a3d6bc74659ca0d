"""Embedding whitening by polarisation: every covariance is a difference of exact variances.

Entries become integers, so no sum is ever rounded:

1. n and the sums S of each dimension, by one scan.
2. With y = n*x - S (centred, still an integer), the sums of y_i^2 of each dimension and of (y_i + y_j)^2 of each pair of
   dimensions, by a second scan. 2*y_i*y_j = (y_i + y_j)^2 - y_i^2 - y_j^2 then gives all covariances.
3. The matrix goes to ``eigh`` on the driver: its size depends on the vectors' length only.
4. A third scan projects each row; a fourth, over what it wrote, measures how far the result is from white.

Tasks send one row per dimension and pair, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
NEGLIGIBLE = 1e-12  # share of the trace below which a component has no variance of its own
_CELLS = 1 << 18  # entries held by one step
_LONG = 1 << 63
_LIMB = 10 ** 18
_SUMS = "dim int, i int, j int, hi decimal(38,0), lo decimal(38,0)"


def remaining(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double>, dim: the rows whose vector is neither null nor empty nor holds null or non-finite entries.

    Repeated rows and ids stay, null ids too.
    """
    x, inf = F.col("embedding").cast("array<double>"), float("inf")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    ).withColumn("dim", F.size("embedding"))


def integers(c: np.ndarray) -> np.ndarray:
    """floor(64*c) + 1000000 as int64; what lies beyond 64 bits stays at the bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        floor = np.floor(SCALE * c)
        x = floor.astype(np.int64)
    top = np.int64(_LONG - 1)
    x = np.where(floor >= float(_LONG), top, np.where(floor < -float(_LONG), -top - 1, x))
    return np.where(x > top - SHIFT, top, x + SHIFT)


def _parts(batches):
    """(dim, ids, x) of bounded parts, each of vectors of one length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            rows, step = np.flatnonzero(dims == dim), max(1, _CELLS // dim)
            for lo in range(0, len(rows), step):
                part = batch.take(pa.array(rows[lo:lo + step]))
                yield dim, part.column("vec_id"), integers(part.column("embedding").flatten().to_numpy().reshape(-1, dim))


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of int64 columns: the halves of 32 bits are added apart."""
    hi, lo = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(v) for h, v in zip(hi, lo, strict=True)]


def square_sums(z: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of columns (Python integers); z is int64, or holds Python integers."""
    if z.dtype == object:
        return (z * z).sum(0)
    most = max(int(z.max(initial=0)), -int(z.min(initial=0)))
    if most * most * max(1, len(z)) < _LONG:
        return np.einsum("ij,ij->j", z, z).astype(object)
    a, b = z >> 31, z & 0x7FFFFFFF  # z = a * 2^31 + b; each product is below 2^62
    total = 0
    for product, shift in ((a * a, 62), (a * b, 32), (b * b, 0)):
        total = total + ((product >> 31).sum(0).astype(object) * (1 << 31) + (product & 0x7FFFFFFF).sum(0).astype(object)) * (1 << shift)
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: int64 where that and its pair sums fit, else Python integers."""
    near = [s // n for s in sums]
    reach = max(max(abs(int(a) - m), abs(int(b) - m)) for a, b, m in zip(x.min(0), x.max(0), near, strict=True)) if len(x) else 0
    if n * (reach + 1) < _LONG >> 2:
        return n * (x - np.array(near, np.int64)) - np.array([s - n * m for s, m in zip(sums, near, strict=True)], np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sum_rows(totals: dict[int, tuple[list[tuple[int, int]], list[int]]]):
    for dim, (places, sums) in totals.items():
        i, j = zip(*places, strict=True)
        yield pa.record_batch([
            pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
            *(pa.array(v, pa.decimal128(38, 0)) for v in zip(*(divmod(int(s), _LIMB) for s in sums), strict=True)),
        ], ["dim", "i", "j", "hi", "lo"])


def _added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    rows = parts.groupBy("dim", "i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows:
        out.setdefault(r["dim"], {})[r["i"], r["j"]] = int(r["hi"]) * _LIMB + int(r["lo"])
    return out


def first_moments(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and S of the vectors of each length."""

    def run(batches):
        totals: dict = {}
        for dim, _, x in _parts(batches):
            old = totals.get(dim, [0] * (dim + 1))
            totals[dim] = [a + b for a, b in zip(old, [len(x), *column_sums(x)], strict=True)]
        yield from _sum_rows({d: ([(i, -1) for i in range(-1, d)], s) for d, s in totals.items()})

    found = _added(rows.mapInArrow(run, _SUMS))
    return {dim: (s[-1, -1], [s[i, -1] for i in range(dim)]) for dim, s in found.items()}


def polarised_sums(rows: DataFrame, moments: dict[int, tuple[int, list[int]]]) -> dict[int, dict[tuple[int, int], int]]:
    """Of each length: the sum of y_i^2 at (i, i), and of (y_i + y_j)^2 at (i, j)."""

    def run(batches):
        totals: dict = {}
        for dim, _, x in _parts(batches):
            y = centred(x, *moments[dim])
            sums = [square_sums(y)] + [square_sums(y[:, i + 1:] + y[:, i:i + 1]) for i in range(dim - 1)]
            totals[dim] = totals.get(dim, 0) + np.concatenate(sums)
        yield from _sum_rows({d: ([(i, i) for i in range(d)] + [(i, j) for i in range(d) for j in range(i + 1, d)], s) for d, s in totals.items()})

    return _added(rows.mapInArrow(run, _SUMS))


def covariance(dim: int, n: int, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariances of x (divisor n), each the nearest double to its exact value."""
    v = np.zeros((dim, dim))
    for (i, j), total in sums.items():
        product = total if i == j else total - sums[i, i] - sums[j, j]
        v[i, j] = v[j, i] = float(Fraction(product, (1 if i == j else 2) * n ** 3))
    return v


@dataclass(frozen=True)
class Whitening:
    """The fit of all vectors of one length. ``components`` are columns by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int], v: np.ndarray, most: int) -> Whitening:
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:most]
        trace = float(np.trace(v))
        share = values[order] / trace if trace > 0 else np.zeros(len(order))
        return cls(n, sums, values[order], vectors[:, order], np.where(share > NEGLIGIBLE, share, 0.0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening of the vectors of each length, from all of them."""
    rows = remaining(vectors)
    moments = first_moments(rows)
    sums = polarised_sums(rows, moments) if moments else {}
    return {dim: Whitening.of(n, s, covariance(dim, n, sums[dim]), components) for dim, (n, s) in moments.items()}


def deviations(y: np.ndarray) -> tuple[list[int | None], list[str]]:
    """Sums of squares of the rows: as 64-bit integers (null where one doesn't fit) and as digits."""
    sums = square_sums(y.T).tolist()
    return [s if s < _LONG else None for s in sums], [str(s) for s in sums]


def apply(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, deviation, deviation_digits, whitened array<double> (null entries for components without variance)."""

    def run(batches):
        for dim, ids, x in _parts(batches):
            m = models[dim]
            y = centred(x, m.n, m.sums)
            has = m.explained > 0
            w = (y.astype(np.float64) / m.n) @ (m.components[:, has] / np.sqrt(m.eigenvalues[has]))
            full = np.full((len(x), len(has)), np.nan)
            full[:, has] = w
            flat = pa.array(full.ravel(), mask=np.isnan(full.ravel()))
            offsets = pa.array(np.arange(len(x) + 1) * len(has), pa.int32())
            fits, digits = deviations(y)
            yield pa.record_batch([ids, pa.array(np.full(len(x), dim, np.int32)), pa.array(fits, pa.int64()), pa.array(digits),
                                   pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "dim", "deviation", "deviation_digits", "whitened"])

    return remaining(vectors).mapInArrow(run, "vec_id long, dim int, deviation long, deviation_digits string, whitened array<double>")


def identity_errors(whitened: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """Of each length: the largest absolute entry of the covariance of the rows' whitened values minus the identity.

    Values are centred by ``apply`` already; the mean that rounding left is taken out as well. Components without variance
    are left out; none at all give null.
    """

    def run(batches):
        sums: dict = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                w = part.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                w = np.column_stack([np.ones(len(w)), w[:, models[dim].explained > 0]])
                sums[dim] = sums.get(dim, 0) + w.T @ w
        for dim, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                  ["dim", "i", "j", "total"])

    parts = whitened.select("dim", "whitened").mapInArrow(run, "dim int, i int, j int, total double")
    worst: dict[int, float | None] = dict.fromkeys(models)
    found = parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect()
    means = {(r["dim"], r["j"]): r["total"] for r in found if r["i"] == 0}
    for r in found:
        if r["i"]:
            n = models[r["dim"]].n
            entry = r["total"] / n - means[r["dim"], r["i"]] / n * (means[r["dim"], r["j"]] / n)
            worst[r["dim"]] = max(worst[r["dim"]] or 0.0, abs(entry - (r["i"] == r["j"])))
    return worst


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: a row for each row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out; repeated rows and ids and null ids stay. Vectors of
    different lengths are fits of their own. Entries whose integer leaves 64 bits stay at the bound. A deviation beyond 64 bits
    is null and only in ``deviation_digits``. Components without variance (fewer vectors than dimensions, equal vectors) have a null
    ``whitened`` and an ``explained`` of 0. Other columns are not read.
    """
    spark = vectors.sparkSession
    models = fit(vectors, components)
    rows = settle(apply(vectors, models), "whitened")
    errors = identity_errors(rows, models) if models else {}
    # one row per length and component: as small as the models, which the driver holds
    about = spark.createDataFrame(
        [(dim, k, m.n, float(m.explained[k]), errors[dim]) for dim, m in models.items() for k in range(len(m.explained))],
        "dim int, k int, n long, explained double, identity_error double")
    return (
        rows.select("vec_id", "dim", "deviation", "deviation_digits", F.posexplode("whitened").alias("k", "whitened"))
        .join(F.broadcast(about), ["dim", "k"])
        .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")
    )
