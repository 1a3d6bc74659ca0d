"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component that makes them unit
vectors, so the largest inner product is the smallest Euclidean distance. A table is a few
Gaussian directions (made orthogonal), cut into intervals; a bucket is a cell of them. A query
visits the cell it falls in and its neighbours in the order of their estimated success: the
squared distances to the crossed borders, summed. Vectors in visited buckets are ranked by their
exact inner products in double precision, and the tables' candidates are merged.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

TABLES = 2
DIRECTIONS = 8
WIDTH = 2.4  # of an interval, in standard deviations of a random unit vector's projection
PROBES = 1000
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2048


class PStable:
    """The directions and borders of all tables for vectors of one length."""

    def __init__(self, dim: int, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH, seed: int = 1):
        rng, self.k = np.random.default_rng(seed), min(directions, dim + 1)
        self.width = width / np.sqrt(dim)
        self.directions = [np.linalg.qr(rng.normal(size=(dim + 1, self.k)))[0] for _ in range(tables)]
        self.shift = rng.uniform(0, self.width, (tables, self.k))
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=self.k)), np.int8)

    def cells(self, t: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (unit @ self.directions[t] + self.shift[t]) / self.width
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    @staticmethod
    def key(cell: np.ndarray) -> np.ndarray:
        """A 64-bit name of each cell."""
        out = np.zeros(cell.shape[:-1], np.uint64)
        with np.errstate(over="ignore"):
            for i in range(cell.shape[-1]):
                out = (out ^ cell[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.astype(np.int64)

    def probes(self, t: int, unit: np.ndarray, n: int) -> np.ndarray:
        """Names of the ``n`` cells each query visits, in estimated success order."""
        cell, part = self.cells(t, unit)
        down, up = self.moves == -1, self.moves == 1
        cost = (part ** 2) @ down.T.astype(float) + ((1 - part) ** 2) @ up.T.astype(float)
        n = min(n, len(self.moves))
        first = np.argpartition(cost, n - 1, axis=1)[:, :n]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(cost, first, 1), axis=1, kind="stable"), 1)
        return self.key(cell[:, None, :] + self.moves[first])


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double>: one row per id.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than the commonest. Of an id's several vectors the least one counts.
    """
    x = F.col("embedding").cast("array<double>")
    inf = float("inf")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
        & F.exists("embedding", lambda v: v != 0))
    one = settle(fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sizes = one.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return one.where(F.size("embedding") == sizes[0]["n"]) if sizes else one


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


CELLS = "table int, block long, bucket long, rep long, ids array<long>, embedding array<double>"
ASKED = "table int, block long, qid long, embedding array<double>, buckets array<long>"


def _data_cells(classes: DataFrame, lsh: PStable, norm: float, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _stack(part.column("embedding")) / norm
                unit = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])
                for t in range(len(lsh.directions)):
                    bucket = lsh.key(lsh.cells(t, unit)[0])
                    yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket % blocks), pa.array(bucket),
                                           *(part.column(c) for c in ("rep", "ids", "embedding"))],
                                          ["table", "block", "bucket", "rep", "ids", "embedding"])

    return classes.mapInArrow(run, CELLS)


def _query_cells(queries: DataFrame, lsh: PStable, probes: int, blocks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                q = _stack(part.column("embedding"))
                unit = np.column_stack([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros(len(q))])
                for t in range(len(lsh.directions)):
                    names = lsh.probes(t, unit, probes)
                    row = np.repeat(np.arange(len(q)), names.shape[1])
                    block, name = names.ravel() % blocks, names.ravel()
                    order = np.lexsort((block, row))
                    row, block, name = row[order], block[order], name[order]
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(block) != 0)]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(name))
                    who = part.take(pa.array(row[cut]))
                    yield pa.record_batch([pa.array(np.full(len(cut), t, np.int32)), pa.array(block[cut]), who.column("qid"),
                                           who.column("embedding"), lists], ["table", "block", "qid", "embedding", "buckets"])

    return queries.mapInArrow(run, ASKED)


def _nearest(k: int):
    """Best ``k`` ids of a block's visited buckets for each query that visits them."""

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if data.empty or asked.empty:
            return empty
        data = data.sort_values(["bucket", "rep"])
        x, q, rep = np.stack(data["embedding"].to_numpy()), np.stack(asked["embedding"].to_numpy()), data["rep"].to_numpy()
        names, start = np.unique(data["bucket"].to_numpy(), return_index=True)
        ends = np.append(start[1:], len(data))
        here: list[list[int]] = [[] for _ in names]
        for i, visited in enumerate(asked["buckets"]):
            at = np.arange(len(names)) if visited is None else np.flatnonzero(np.isin(names, visited))
            for b in at.tolist():
                here[b].append(i)
        rows, found = [], []
        for b, who in enumerate(here):
            if not who:
                continue
            s = q[who] @ x[start[b]:ends[b]].T
            if s.shape[1] > k:
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1:k]
                i, j = np.nonzero(s >= least - 1e-9 * (1 + np.abs(least)))
            else:
                i, j = np.indices(s.shape).reshape(2, -1)
            rows.append(np.array(who)[i])
            found.append(start[b] + j)
        if not rows:
            return empty
        row, at = np.concatenate(rows), np.concatenate(found)
        rough = np.empty(len(row))
        for lo in range(0, len(row), 65536):
            rough[lo:lo + 65536] = np.einsum("ij,ij->i", q[row[lo:lo + 65536]], x[at[lo:lo + 65536]])
        row, at, rough = _best(row, rep[at], rough, k, at)
        ids = data["ids"].to_numpy()[at]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        row, score, ids = np.repeat(row, many), np.repeat(rough, many), np.concatenate(ids)
        row, ids, score = _best(row, ids, score, k, ids)
        return pd.DataFrame({"qid": asked["qid"].to_numpy()[row], "vec_id": ids, "score": score})

    return run


def _best(row, name, score, k, keep):
    """The first k of each row by score, ties to the smaller name: rows, ``keep`` and scores."""
    order = np.lexsort((name, -score, row))
    row, keep, score = row[order], keep[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], keep[rank < k], score[rank < k]


def _dealt(cells: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a cell (table, block, part, qpart): blocks of too many rows or queries are split,
    and the other side's rows repeated for each part."""
    by = ["table", "block"]
    parts = cells.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    parts = parts.join(asked.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qparts")), by)
    parts = settle(parts, "cell-sizes")
    data = cells.join(parts, by).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn(
        "qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    queries = asked.join(parts, by).withColumn("qpart", F.pmod(F.xxhash64("qid"), "qparts").cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = [*by, "part", "qpart"]
    return data.select(*key, "bucket", "rep", "ids", "embedding"), queries.select(*key, "qid", "embedding", "buckets")


def _scan(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    data, queries = _dealt(cells, asked)
    key = ["table", "block", "part", "qpart"]
    found = data.groupBy(key).cogroup(queries.groupBy(key)).applyInPandas(_nearest(k), "qid long, vec_id long, score double")
    once = found.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def search(vectors: DataFrame, k: int = 20, is_query: Column | None = None, probes: int = PROBES,
           tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every other vector, for each query row.

    ``is_query`` tells the queries (default: ids divisible by 20). Equal vectors are one
    class that is searched once; a class keeps its ``k + 1`` smallest ids, as no other can
    be among the first k of any query. A query that finds fewer than k although there are more visits
    every bucket. Nearest first, ties to the smaller id. Empty tables give no rows. See
    ``clean`` for vectors that take no part.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    base = clean(vectors)
    norm = base.agg(F.max(F.sqrt(F.aggregate(F.transform("embedding", lambda v: v * v), F.lit(0.0), lambda a, b: a + b))).alias("norm"),
                    F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not norm["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    classes = base.withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1).groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = settle(classes, "vector-classes")
    asked = base.where(is_query)
    heads = settle(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "queries")
    members = settle(asked.join(heads, "embedding").select("qid", F.col("vec_id").alias("query_id")), "query-members")
    lsh, blocks = PStable(norm["dim"], tables), max(1, -(-classes.count() // BLOCK_ROWS))
    cells = settle(_data_cells(classes, lsh, norm["norm"], blocks), "cells")
    visits = settle(_query_cells(heads, lsh, probes, blocks), "visits")

    def ranked(top: DataFrame, members: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        both = members.join(top, "qid").where("vec_id != query_id")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = settle(ranked(_scan(cells, visits, k + 1), members), "found")
    want = min(k, norm["n"] - 1)
    counts = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = members.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < want).select("qid", "query_id")
    short = settle(short, "short")
    if not short.isEmpty():
        everywhere = cells.where(F.col("table") == 0)
        rest = heads.join(short.select("qid").distinct(), "qid").select(
            F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
            "qid", "embedding", F.lit(None).cast("array<long>").alias("buckets"))
        again = ranked(_scan(everywhere, rest, k + 1), short)
        first = first.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
