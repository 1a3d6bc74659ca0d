"""Keyword top-k that leaves out the postings of terms that cannot decide.

``postings``    per term, source type and block of chunks the chunks' places in the block, their counts and the list's largest saturated
                frequencies, in falling order. A row without a term holds the ids and lengths of a block's chunks. A block is made by
                the task that reads its chunks and is written where it is made; only chunks whose id comes several times are shuffled

A query's terms alone have their largest frequencies gathered from the blocks, as many as its hits (``term_tops``).

For a query, ``weight * top`` bounds what a term can add, and the k-th entry of a term's list gives a score that k chunks
reach for sure. Terms of the least bounds that stay below that score even together can't bring a chunk into the
best k: their postings are left out. The other terms' postings meet the queries block by block and give partial sums inside tasks;
chunks whose sum and the bounds left out stay below the k-th best sum go, so no row per (query, chunk) is made for them. What survives is scored whole from its own term row, so the rows are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, fits_broadcast, settle
from .index import Index
from .search import (
    BLOCK_POSTINGS, DEFAULT_SOURCE_TYPE, SCORE_DIGITS, _ranked_with_limits, _result_types, _saturated, _with_k, allowed_sources, best_places,
    block_sums, in_cells, numbered_terms, query_rows, query_terms, query_weights, saturated,
)

DEPTH = 128
_SPREAD = 16  # groups of blocks whose largest entries of a term are put together first
_STORED = "block bigint, source_type string, term string, at array<int>, tf array<int>, tops array<double>, ids array<string>, dls array<int>"
_SLACK = 10.0 ** -(SCORE_DIGITS - 3)  # sums of doubles in another order stay within this


def build_postings(index: Index, depth: int = DEPTH) -> None:
    """Write the lists beside the index, from its stored term rows, each block by the task that reads its chunks.

    Chunks of one id count as one, so those whose id comes several times meet in a block by a shuffle. If they are too many to
    broadcast their ids, all chunks do.
    """
    avg_dl = index.corpus_stats.first()["avg_dl"] or 1.0
    rows = index.chunk_terms.select(
        F.xxhash64("chunk_id").alias("_id"), "chunk_id", "source_type", "dl", F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tfs"))
    repeated = settle(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated")
    few = fits_broadcast(repeated)
    met = rows.join(F.broadcast(repeated), "_id", "left_semi") if few else rows
    blocks = max(1, -(-(met.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_POSTINGS))
    # below 0, so that they differ from the blocks of tasks
    stored = met.withColumn("block", F.lit(-1) - F.pmod("_id", F.lit(blocks))).drop("_id").groupBy("block").applyInArrow(_met(avg_dl, depth), _STORED)
    if few:
        alone = rows.join(F.broadcast(repeated), "_id", "left_anti").drop("_id")
        stored = alone.mapInArrow(_blocks(avg_dl, depth, BLOCK_POSTINGS), _STORED).unionByName(stored)
    stored.write.mode("overwrite").parquet(f"{index.path}/postings")


def _met(avg_dl: float, depth: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _inverted(key[0].as_py(), rows, avg_dl, depth)

    return run


def _blocks(avg_dl: float, depth: int, most: int):
    """A task's chunks, as they come, in blocks of at most ``most`` postings; a chunk of more is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            # a chunk takes one place besides its postings, so that those without a term have a bound too
            room = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False) + 1)
            first = 0
            while first < len(room):
                before = room[first - 1] if first else 0
                last = max(int(np.searchsorted(room, before + most - size, "right")), first if held else first + 1)
                if last > first:
                    held.append(batch.slice(first, last - first))
                    size += room[last - 1] - before
                if last < len(room):
                    yield from _inverted(number, pa.Table.from_batches(held), avg_dl, depth).to_batches()
                    number, held, size = number + 1, [], 0
                first = last
        if held:
            yield from _inverted(number, pa.Table.from_batches(held), avg_dl, depth).to_batches()

    return run


def _inverted(block: int, rows: pa.Table, avg_dl: float, depth: int) -> pa.Table:
    """The chunks of a block as lists by source type and term, after one row with the chunks' ids and lengths."""
    terms, types = rows.column("terms").combine_chunks(), rows.column("source_type").combine_chunks().dictionary_encode()
    coded = terms.flatten().dictionary_encode()
    kind = pc.fill_null(types.indices, len(types.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    list_of = kind[owner] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    tf, dl = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False), rows.column("dl").combine_chunks().to_numpy(zero_copy_only=False)
    part = saturated(tf, dl[owner], avg_dl)
    order = np.argsort(list_of, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(list_of[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    ends = np.append(head, len(order))
    # the largest parts of each list, in falling order
    down = np.lexsort((-part, list_of))
    nth = np.arange(len(down)) - np.repeat(head, np.diff(ends))
    first = nth < depth
    kept = np.append(0, np.cumsum(np.minimum(np.diff(ends), depth)))
    which, word = np.divmod(list_of[order][head], max(1, len(coded.dictionary)))

    def lists(values, bounds):
        found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
        return pa.concat_arrays([pa.nulls(1, found.type), found])

    return pa.table({
        "block": pa.array(np.full(len(head) + 1, block), pa.int64()),
        "source_type": pa.concat_arrays([pa.nulls(1, pa.string()), types.dictionary.cast(pa.string()).take(
            pa.array(which, mask=which == len(types.dictionary)))]),
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(word))]),
        "at": lists(owner[order].astype(np.int32), ends), "tf": lists(tf[order].astype(np.int32), ends),
        "tops": lists(part[down][first], kept),
        "ids": pa.concat_arrays([pa.array([rows.column("chunk_id").to_pylist()], pa.list_(pa.string())), pa.nulls(len(head), pa.list_(pa.string()))]),
        "dls": pa.concat_arrays([pa.array([dl.tolist()], pa.list_(pa.int32())), pa.nulls(len(head), pa.list_(pa.int32()))]),
    })


def _stored(index: Index) -> DataFrame:
    return index.spark.read.schema(_STORED).parquet(f"{index.path}/postings")


def postings(index: Index) -> DataFrame:
    """block, source_type, term, at (the chunk's place in its block) and tf, one row per (term, chunk)."""
    lists = _stored(index).where("term IS NOT NULL").select("block", "source_type", "term", F.explode(F.arrays_zip("at", "tf")).alias("p"))
    return lists.select("block", "source_type", "term", "p.at", "p.tf")


def partial_sums(index: Index, queries: DataFrame, allowed: Sequence[str] | None, default_source: str | None, schema: str,
                 query_type: pa.DataType, avg_dl: float) -> DataFrame:
    """query_id, chunk_id, score: sums over the terms of ``queries`` (``query_rows`` with ``floor``), of chunks that may decide.

    Without a floor, of each block of chunks the best k of a query; with one, all chunks whose sum reaches it.
    """
    every = _stored(index)
    read = broadcast_if_small(queries.select(F.explode("terms").alias("term")).distinct())
    lists = allowed_sources(every.where("term IS NOT NULL"), allowed, default_source).join(read, "term", "left_semi")
    heads = every.where("term IS NULL")
    wide = ("block", "term", "at", "tf", "ids", "dls")

    def score(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        lists = stored.filter(pc.is_valid(stored.column("term")))
        if lists.num_rows and asked.num_rows:
            known, numbers, values, bounds = numbered_terms(asked)
            head = stored.filter(pc.is_null(stored.column("term")))
            ids = head.column("ids").combine_chunks().flatten().dictionary_encode()
            dl = head.column("dls").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            names, place = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)
            at = lists.column("at").combine_chunks()
            code = np.repeat(pc.index_in(lists.column("term").combine_chunks(), value_set=known).to_numpy(zero_copy_only=False),
                             pc.list_value_length(at).to_numpy(zero_copy_only=False))
            at, tf = at.flatten().to_numpy(zero_copy_only=False), lists.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            sums = block_sums(code, place[at], saturated(tf, dl[at], avg_dl), len(names), len(names) == len(place), numbers, values, bounds)
            rows = (asked.column(c).to_pylist() for c in ("query_id", "_k", "floor"))
            for query, k, floor, total in zip(*rows, sums, strict=True):
                found = best_places(total, k) if floor is None else np.flatnonzero((total >= floor) & (total > 0))
                out[0].extend([query] * len(found))
                out[1].extend(names.take(pa.array(found)).to_pylist())
                out[2].append(total[found])
        scores = np.concatenate(out[2]) if out[2] else np.zeros(0)
        return pa.table([pa.array(out[0], query_type), pa.array(out[1], pa.string()), pa.array(scores)], ["query_id", "chunk_id", "score"])

    return in_cells(lists.select(*wide).unionByName(heads.select(*wide)), heads, queries, score, schema)


def term_tops(lists: DataFrame, depth: int) -> DataFrame:
    """term, parts: the largest saturated frequencies of each term of the stored ``lists``, ``depth`` at most, in falling order."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("parts")), asc=False), 1, depth).alias("parts")
    parts = lists.select("term", F.pmod(F.xxhash64("block"), F.lit(_SPREAD)).alias("_part"), F.slice("tops", 1, depth).alias("parts"))
    return parts.groupBy("term", "_part").agg(best).groupBy("term").agg(best)


def term_bounds(weights: DataFrame, limits: DataFrame, index: Index, allowed: Sequence[str] | None,
                default_source: str | None = DEFAULT_SOURCE_TYPE) -> DataFrame:
    """query_id, term, weight, bound, sure, rest, essential for each term of each query.

    ``bound`` is the most a term can add, ``sure`` a score that the query's k best reach, ``rest`` the bounds of this and all
    lesser terms together; terms whose ``rest`` stays below ``sure`` are not essential. Where a list is shorter than k, it
    vouches for nothing.
    """
    stored = allowed_sources(_stored(index).where("term IS NOT NULL"), allowed, default_source)
    asked = stored.join(broadcast_if_small(weights.select("term").distinct()), "term", "left_semi")
    tops = term_tops(asked, max(1, limits.agg(F.max("_k")).first()[0] or 1))
    lists = tops.join(broadcast_if_small(weights.select("query_id", "term", "weight")), "term").join(limits, "query_id").select(
        "query_id", "term", "weight", (F.col("weight") * F.get("parts", F.lit(0))).alias("bound"),
        F.coalesce(F.col("weight") * F.get("parts", F.col("_k") - 1), F.lit(0.0)).alias("kth"))
    upward = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lists.select(
        "query_id", "term", "weight", "bound", F.max("kth").over(Window.partitionBy("query_id")).alias("sure"), F.sum("bound").over(upward).alias("rest"),
    ).withColumn("essential", F.col("rest") >= F.col("sure") - F.lit(_SLACK))


def keyword_topk_pruned(queries: DataFrame, index: Index, k: int | None = None, allowed: Sequence[str] | None = None,
                        default_source: str | None = DEFAULT_SOURCE_TYPE, factor: int = 1) -> DataFrame:
    """The rows of ``search.keyword_topk``, from an index with ``build_postings``: query_id, chunk_id, rank, score."""
    wanted = _with_k(queries, k, factor)
    limits = settle(wanted.select("query_id", "_k"), "limits")
    asked = query_terms(wanted, index.settings["term_re"])
    weights = settle(query_weights(asked, index).where("term = stored_term").select("query_id", "term", "weight"), "weights")
    bounds = settle(term_bounds(weights, limits, index, allowed, default_source), "bounds")
    read = query_rows(bounds.where("essential").select("query_id", "term", "weight"), limits)
    avg_dl = index.corpus_stats.first()["avg_dl"] or 1.0
    schema, query_type = _result_types(limits)
    # Twice over the lists: (query, chunk) pairs are kept only when the k-th best partial sum of all chunks is known.
    asked = settle(read.withColumn("floor", F.lit(None).cast("double")), "essential")
    best = partial_sums(index, asked, allowed, default_source, schema, query_type, avg_dl)
    kth = _ranked_with_limits(best, limits).join(limits, "query_id").where("rank = _k").select("query_id", F.col("score").alias("kth"))
    floors = bounds.groupBy("query_id").agg(F.max("sure").alias("sure"), F.coalesce(F.max(F.when(~F.col("essential"), F.col("rest"))), F.lit(0.0)).alias("left"))
    floors = floors.join(kth, "query_id", "left").select("query_id", (F.greatest("sure", F.coalesce("kth", F.lit(0.0))) - F.col("left") - F.lit(_SLACK)).alias("floor"))
    asked = settle(read.join(floors, "query_id"), "floors")
    alive = partial_sums(index, asked, allowed, default_source, schema, query_type, avg_dl).select("query_id", "chunk_id")
    alive = settle(alive, "alive")
    # whole scores of what is left, each chunk for the queries it is left for
    terms = index.chunk_terms.join(broadcast_if_small(alive.select("chunk_id").distinct()), "chunk_id", "left_semi")
    found = terms.select("chunk_id", "dl", F.explode("terms").alias("t")).select("chunk_id", F.col("t.term").alias("term"), _saturated(F.col("t.tf"), avg_dl).alias("part"))
    scored = found.join(alive, "chunk_id").join(broadcast_if_small(weights), ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") * F.col("part")), SCORE_DIGITS).alias("score")).where("score > 0")
    return _ranked_with_limits(scored, limits)
