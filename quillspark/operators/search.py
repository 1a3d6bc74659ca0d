"""Keyword, semantic and hybrid top-k search for many queries at once.

A batch of queries that is measured to be small is broadcast and every task
keeps its own best k per query, so only ``k`` rows per query and task are
shuffled. A batch beyond the limit meets the chunks block by block in a
shuffle instead. Both ways are exact and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import TERM_RE, is_blank, strict_json, strip, terms
from ..session import broadcast_if_small, fits_broadcast, settle
from .index import Index

K1 = 1.2
B = 0.75
RRF_K = 60
DEFAULT_TOP_K = 10
MAX_TOP_K = 30
OVERFETCH = 2
MAX_PER_DOCUMENT = 3
DEFAULT_SOURCE_TYPE = "docs"

# Scores are compared after rounding, so that equal texts tie whatever the
# order their parts were summed in; ties go to the smaller chunk id.
SCORE_DIGITS = 9
_QUERY_BLOCK = 256
_ROW_BLOCK = 1024
# What one batch of queries may send to every task; larger batches go another way.
MAX_SHARED_WEIGHTS = 1_000_000
MAX_SHARED_VECTORS = 8192
MAX_SHARED_BYTES = 32 * 1024 * 1024
# Where nothing is broadcast: what meets in one task at once.
MAX_BLOCK_QUERIES = 4096
BLOCK_POSTINGS = 2_000_000
_MERGE_PARTS = 32


# --- queries ---------------------------------------------------------------------


def parse_query_args(args: DataFrame, raw_col: str = "arguments") -> DataFrame:
    """Read search arguments given as JSON text: adds query, top_k and error.

    Blank text means no arguments; anything but a JSON object is an error, and so
    is a missing query. ``top_k`` is taken as an integer where it reads as one,
    else the default, and held between 1 and 30.
    """
    raw = F.coalesce(strip(raw_col), F.lit(""))
    parsed = strict_json(F.when(raw == "", F.lit("{}")).otherwise(raw))
    is_object = parsed.isNotNull() & ((raw == "") | raw.startswith("{"))
    top_k = F.coalesce(F.try_variant_get(parsed, "$.top_k", "int"), F.lit(DEFAULT_TOP_K))
    query = F.coalesce(strip(F.try_variant_get(parsed, "$.query", "string")), F.lit(""))
    return args.withColumns({
        "query": F.when(is_object & (query != ""), query),
        "top_k": F.when(is_object, F.greatest(F.lit(1), F.least(F.lit(MAX_TOP_K), top_k))),
        "error": F.when(~is_object, F.lit("invalid JSON arguments"))
        .when(query == "", F.lit("missing required parameter: query")),
    })


def allowed_sources(df: DataFrame, allowed: Sequence[str] | None,
                    default: str | None = DEFAULT_SOURCE_TYPE) -> DataFrame:
    """Access filter: null means the default type, an empty list means no rows at all."""
    if allowed is None:
        return df if default is None else df.where(F.col("source_type") == default)
    if not allowed:
        return df.where(F.lit(False))
    return df.where(F.col("source_type").isin(*allowed))


# --- local top-k -----------------------------------------------------------------


class _TopK:
    """Best k rows per query seen by one task so far, ties by chunk id.

    ``floor`` is a score that k rows of a query already reach; rows below it are
    dropped at once, rows that tie with it are kept until they are compared by id.
    """

    def __init__(self, query_ids: Sequence, ks: np.ndarray):
        self.query_ids, self.ks = query_ids, np.asarray(ks)
        self.floor = np.full(len(query_ids), -np.inf)
        self.parts: list[pd.DataFrame] = []
        self.waiting = 0
        self.limit = max(200_000, 4 * int(self.ks.sum()))

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` has one row per id and one column per query; ``-inf`` is no match."""
        scores = np.round(scores, SCORE_DIGITS)
        width, deepest = scores.shape[1], int(self.ks.max())
        floor = self.floor[first:first + width]
        if len(scores) >= deepest:
            np.maximum(floor, np.partition(scores, len(scores) - deepest, axis=0)[len(scores) - deepest], out=floor)
        rows, cols = np.nonzero((scores >= floor) & (scores > -np.inf))
        if len(rows):
            self.parts.append(pd.DataFrame({
                "q": cols + first, "score": scores[rows, cols], "id": ids.take(pa.array(rows)).to_pandas(),
            }))
            self.waiting += len(rows)
        if self.waiting > self.limit:
            self._compact()

    def add_sums(self, sums: Iterator[np.ndarray], ids: pa.Array) -> None:
        """One array per query, in order, with the score of each id; 0 or less is no match."""
        numbers, scores, places = [], [], []
        for number, total in enumerate(sums):
            total, k = np.round(total, SCORE_DIGITS), int(self.ks[number])
            places.append(best_places(np.where(total >= self.floor[number], total, 0.0), k))
            scores.append(total[places[-1]])
            numbers.append(np.full(len(places[-1]), number))
            if len(scores[-1]) >= k:
                self.floor[number] = max(self.floor[number], scores[-1].min())
        if sum(map(len, scores)):
            self.parts.append(pd.DataFrame({
                "q": np.concatenate(numbers), "score": np.concatenate(scores), "id": ids.take(pa.array(np.concatenate(places))).to_pandas(),
            }))
            self.waiting += len(self.parts[-1])
        if self.waiting > self.limit:
            self._compact()

    def _compact(self) -> pd.DataFrame:
        every = pd.concat(self.parts, ignore_index=True).sort_values(["q", "score", "id"], ascending=[True, False, True])
        nth = every.groupby("q").cumcount().to_numpy()
        limit = self.ks[every["q"].to_numpy()]
        last = every[nth == limit - 1]
        self.floor[last["q"].to_numpy()] = np.maximum(self.floor[last["q"].to_numpy()], last["score"].to_numpy())
        best = every[nth < limit]
        self.parts, self.waiting = [best], len(best)
        return best

    def batches(self, query_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.parts:
            best = self._compact()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.query_ids[q] for q in best["q"]], type=query_type),
                    pa.array(best["id"], type=pa.string()), pa.array(best["score"], type=pa.float64()),
                ],
                names=["query_id", "chunk_id", "score"],
            )


def _result_types(limits: DataFrame) -> tuple[str, pa.DataType]:
    data_type = limits.schema["query_id"].dataType
    return f"query_id {data_type.simpleString()}, chunk_id string, score double", to_arrow_type(data_type)


def _with_k(queries: DataFrame, k: int | None, factor: int = 1) -> DataFrame:
    """Queries with their own number of hits: ``top_k`` where present, else the given k."""
    limit = F.lit(k if k is not None else DEFAULT_TOP_K)
    if "top_k" in queries.columns:
        limit = F.coalesce(F.col("top_k"), limit)
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    return queries.where(~is_blank("query")).withColumn("_k", (limit * factor).cast("int"))


# --- keyword ---------------------------------------------------------------------


def query_terms(queries: DataFrame, term_re: str = TERM_RE) -> DataFrame:
    """``query_id, term, qtf, code``: how often each query repeats each of its terms."""
    return (
        queries.select("query_id", F.explode(terms("query", term_re)).alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        .withColumn("code", F.xxhash64("term"))
    )


def query_weights(wanted: DataFrame, index: Index) -> DataFrame:
    """``query_id, term, code, weight`` with weight = idf × repeats, for query terms in the index.

    ``code`` is the 64-bit hash that scoring compares. Every stored term with the
    code of a query term is returned as ``stored_term``, so that two terms with
    one code can be noticed.
    """
    stored = index.term_stats.select(F.col("term").alias("stored_term"), "df", F.xxhash64("term").alias("code"))
    stats = index.corpus_stats.select("n_chunks").withColumn("_one", F.lit(1))
    idf = F.log(F.lit(1.0) + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        wanted.join(stored, "code")
        .withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
        .select("query_id", "term", "stored_term", "code", (idf * F.col("qtf")).alias("weight"))
    )


def _saturated(tf: Column, avg_dl: float) -> Column:
    """Saturated frequency of a term that occurs ``tf`` times in a chunk of ``dl`` terms."""
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(float(avg_dl)))
    return tf * F.lit(K1 + 1.0) / (tf + norm)


def keyword_topk(queries: DataFrame, index: Index, k: int | None = None,
                 allowed: Sequence[str] | None = None, default_source: str | None = DEFAULT_SOURCE_TYPE,
                 factor: int = 1, force_shuffle: bool = False) -> DataFrame:
    """BM25 top-k of ``queries(query_id, query[, top_k])``: query_id, chunk_id, rank, score.

    Queries are cut into terms by the pattern the index was built with.
    """
    wanted = _with_k(queries, k, factor)
    asked = query_terms(wanted, index.settings["term_re"])
    rows = allowed_sources(index.chunk_terms, allowed, default_source)
    avg_dl = index.corpus_stats.first()["avg_dl"] or 1.0
    limits = wanted.select("query_id", "_k")
    if not force_shuffle and fits_broadcast(asked, max_rows=MAX_SHARED_WEIGHTS):
        asked = F.broadcast(asked)
        table = query_weights(asked, index).join(limits, "query_id").toPandas()
        # Two different terms under one code need the join by term.
        if (table["term"] == table["stored_term"]).all():
            return _keyword_by_scan(rows, table, limits, avg_dl)
    weights = query_weights(asked, index).where("term = stored_term")
    return _keyword_by_cells(rows, weights, limits, avg_dl)


def _keyword_by_scan(rows: DataFrame, table: pd.DataFrame, limits: DataFrame, avg_dl: float) -> DataFrame:
    table = table.sort_values(["query_id", "code"])
    query_ids, first = np.unique(table["query_id"].to_numpy(), return_index=True)
    codes, numbers = np.unique(table["code"].to_numpy(dtype=np.int64), return_inverse=True)
    shared = rows.sparkSession.sparkContext.broadcast({
        "query_ids": query_ids.tolist(), "ks": table["_k"].to_numpy()[first], "codes": codes,
        # Query q has the terms numbers[bounds[q]:bounds[q + 1]], with these weights.
        "numbers": numbers, "weights": table["weight"].to_numpy(dtype=np.float64), "bounds": np.append(first, len(table)),
    })
    schema, query_type = _result_types(limits)

    # Terms cross to Python as numbers; the saturated frequency is computed before that.
    slim = rows.select(
        "chunk_id", F.transform("terms.term", lambda t: F.xxhash64(t)).alias("code"),
        F.transform("terms.tf", lambda tf: _saturated(tf, avg_dl)).alias("part"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        if not len(q["query_ids"]):
            return
        top = _TopK(q["query_ids"], q["ks"])
        for batch in batches:
            code = batch.column("code").flatten().to_numpy()
            if not len(code):
                continue
            value = batch.column("part").flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("code")).to_numpy())
            at = np.minimum(np.searchsorted(q["codes"], code), len(q["codes"]) - 1)
            known = q["codes"][at] == code
            top.add_sums(block_sums(at[known], owner[known], value[known], batch.num_rows, True, q["numbers"], q["weights"], q["bounds"]),
                         batch.column("chunk_id"))
        yield from top.batches(query_type)

    return _ranked_with_limits(slim.mapInArrow(score, schema), limits)


def query_rows(weights: DataFrame, limits: DataFrame) -> DataFrame:
    """query_id, _k, terms, weights: a row per query, with all its terms."""
    asked = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("w"))
    return asked.join(limits, "query_id").select("query_id", "_k", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"))


def in_cells(rows: DataFrame, blocks: DataFrame, queries: DataFrame, score, schema: str) -> DataFrame:
    """``score(rows, queries)`` for each pair of a block of chunks and a block of queries, both bounded and met by a shuffle.

    ``rows`` has ``block`` and what is stored of its chunks, ``blocks`` lists the blocks, ``queries`` are ``query_rows``.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    # half full on average, so that uneven hashing stays within the limit
    parts = max(1, -(-2 * size["n"] // MAX_BLOCK_QUERIES), -(-2 * (size["terms"] or 0) // MAX_SHARED_WEIGHTS))
    if size["n"] <= MAX_BLOCK_QUERIES and (size["terms"] or 0) <= MAX_SHARED_WEIGHTS:
        parts = 1
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    mine = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("_part")
    asked = blocks.select(F.col("block").alias("_block")).distinct().crossJoin(queries.withColumn("_part", mine))
    return rows.select("*", every).groupBy("block", "part").cogroup(asked.groupBy("_block", "_part")).applyInArrow(score, schema)


def block_sums(code: np.ndarray, at: np.ndarray, part: np.ndarray, size: int, unique: bool,
               numbers: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Per query the summed ``weight * part`` of each of ``size`` chunks, from postings (code, at, part).

    Query q has the terms ``numbers[bounds[q]:bounds[q + 1]]``. Unless ``unique``, a chunk may have several postings of one term.
    """
    order = np.argsort(code, kind="stable")
    code, at, part = code[order], at[order], part[order]
    start = np.searchsorted(code, np.arange(int(numbers.max(initial=-1)) + 2)).tolist()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        total = np.zeros(size)
        for c, w in zip(numbers[lo:hi].tolist(), weights[lo:hi].tolist(), strict=True):
            first, last = start[c], start[c + 1]
            if unique:
                total[at[first:last]] += w * part[first:last]
            else:
                np.add.at(total, at[first:last], w * part[first:last])
        yield total


def numbered_terms(queries: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a block of queries; its entries as term numbers, weights and bounds per query."""
    terms = queries.column("terms").combine_chunks()
    coded = terms.flatten().dictionary_encode()
    bounds = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))).astype(np.int64)
    return (coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            queries.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False), bounds)


def best_places(total: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest positive values and of all that tie with the last of them."""
    found = np.flatnonzero(total > 0)
    if len(found) > k:
        value = total[found]
        found = found[value >= np.partition(value, len(value) - k)[len(value) - k]]
    return found


def saturated(tf: np.ndarray, dl: np.ndarray, avg_dl: float) -> np.ndarray:
    """``_saturated`` inside a task."""
    return tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * dl / float(avg_dl)))


def _keyword_by_cells(rows: DataFrame, weights: DataFrame, limits: DataFrame, avg_dl: float) -> DataFrame:
    """Score without a broadcast: blocks of chunks meet blocks of queries, and each such cell keeps its best k per query.

    What is shuffled are the chunks' term rows, once per block of queries, and the queries, once per block of chunks; never a row per
    (query, chunk). Terms are compared as texts.
    """
    schema, query_type = _result_types(limits)
    postings = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-postings // BLOCK_POSTINGS))
    slim = rows.select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), "chunk_id", "dl",
        F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tfs"))

    def score(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if chunks.num_rows and queries.num_rows:
            known, numbers, values, bounds = numbered_terms(queries)
            listed = chunks.column("terms").combine_chunks()
            code = pc.index_in(listed.flatten(), value_set=known)
            asked = pc.is_valid(code).to_numpy(zero_copy_only=False)
            code = pc.drop_null(code).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(chunks.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))[asked]
            tf = chunks.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)[asked]
            part = saturated(tf, chunks.column("dl").to_numpy()[owner], avg_dl)
            ids = chunks.column("chunk_id").combine_chunks().dictionary_encode()
            names, place = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)
            sums = block_sums(code, place[owner], part, len(names), len(names) == chunks.num_rows, numbers, values, bounds)
            for query, k, total in zip(queries.column("query_id").to_pylist(), queries.column("_k").to_pylist(), sums, strict=True):
                total = np.round(total, SCORE_DIGITS)
                found = best_places(total, k)
                out[0].extend([query] * len(found))
                out[1].extend(names.take(pa.array(found)).to_pylist())
                out[2].append(total[found])
        scores = np.concatenate(out[2]) if out[2] else np.zeros(0)
        return pa.table([pa.array(out[0], query_type), pa.array(out[1], pa.string()), pa.array(scores)], ["query_id", "chunk_id", "score"])

    numbered = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    return _ranked_with_limits(in_cells(slim, numbered, settle(query_rows(weights, limits), "query-rows"), score, schema), limits)


def _ranked_with_limits(scored: DataFrame, limits: DataFrame) -> DataFrame:
    # In two steps, so that the lists all tasks have kept of one query do not meet in one task;
    # the bound of the first is the largest number this batch asks for.
    deepest = limits.agg(F.max("_k")).first()[0] or 1
    best = [F.col("score").desc(), F.col("chunk_id")]
    parts = Window.partitionBy("query_id", "_part").orderBy(*best)
    few = scored.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(_MERGE_PARTS))).withColumn(
        "_nth", F.row_number().over(parts)).where(F.col("_nth") <= deepest).drop("_part", "_nth")
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= deepest)
    return (
        top.join(limits, "query_id").where(F.col("rank") <= F.col("_k"))
        .select("query_id", "chunk_id", "rank", "score")
    )


# --- semantic --------------------------------------------------------------------


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int | None = None,
                allowed: Sequence[str] | None = None, default_source: str | None = DEFAULT_SOURCE_TYPE,
                factor: int = 1) -> DataFrame:
    """Exact cosine top-k of ``queries(query_id, embedding[, top_k])`` over stored vectors.

    Query vectors travel in blocks of bounded size; each block is one scan of the
    vectors in which every task keeps its best k. A zero vector has no direction
    and is never a hit.
    """
    spark = vectors.sparkSession
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    limit = F.lit(k if k is not None else DEFAULT_TOP_K)
    if "top_k" in queries.columns:
        limit = F.coalesce(F.col("top_k"), limit)
    wanted = queries.select("query_id", "embedding", (limit * factor).cast("int").alias("_k"))
    rows = allowed_sources(vectors, allowed, default_source).select("chunk_id", "embedding")
    schema, query_type = _result_types(wanted)

    # Written once, so that the queries' own plan doesn't run again for each block. Blocks are bounded by
    # bytes too, and half full on average, so that uneven hashing stays within the limit.
    wanted = settle(wanted, "wanted")
    measured = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    size, most = measured["n"], max(1, min(MAX_SHARED_VECTORS, MAX_SHARED_BYTES // (8 * max(1, measured["dim"] or 1))))
    blocks = 1 if size <= most else -(-size * 2 // most)
    tables = (
        wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas() for n in range(blocks)
    )
    found = None
    for table in tables:
        if not len(table):
            continue
        shared = spark.sparkContext.broadcast((
            table["query_id"].tolist(), table["_k"].to_numpy(), np.vstack(table["embedding"].to_numpy()).astype(np.float64),
        ))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, ks, matrix = shared.value
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            top = _TopK(query_ids, ks)
            for batch in batches:
                for low in range(0, batch.num_rows, _ROW_BLOCK):
                    part = batch.slice(low, _ROW_BLOCK)
                    stored = part.column("embedding").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, -1)
                    norm = np.linalg.norm(stored, axis=1, keepdims=True)
                    for first in range(0, len(query_ids), _QUERY_BLOCK):
                        with np.errstate(divide="ignore", invalid="ignore"):
                            cosine = stored @ unit[first:first + _QUERY_BLOCK].T / norm
                        cosine[~np.isfinite(cosine)] = -np.inf
                        top.add(first, cosine, part.column("chunk_id"))
            yield from top.batches(query_type)

        hits = rows.mapInArrow(score, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    return _ranked_with_limits(found, wanted.select("query_id", "_k"))


# --- fusion and shaping ----------------------------------------------------------


def rrf_fuse(arms: Sequence[DataFrame], limits: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: the score is the sum of 1 / (rrf_k + rank)."""
    both = arms[0].select("query_id", "chunk_id", "rank")
    for arm in arms[1:]:
        both = both.unionByName(arm.select("query_id", "chunk_id", "rank"))
    # The lists are short. Shuffling them by name keeps the sum right in sessions
    # that trust a union's partitioning (see session.SAFE_CONF).
    fused = both.repartition("query_id", "chunk_id").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), SCORE_DIGITS).alias("score")
    )
    return _ranked_with_limits(fused, limits)


def hybrid_topk(queries: DataFrame, index: Index, k: int | None = None, allowed: Sequence[str] | None = None,
                default_source: str | None = DEFAULT_SOURCE_TYPE, rrf_k: int = RRF_K) -> DataFrame:
    """Keyword and semantic arms at twice the depth, fused by rank, cut to k.

    ``queries(query_id, query, embedding[, top_k])``.
    """
    queries = settle(queries, "queries")
    sparse = keyword_topk(queries, index, k, allowed, default_source, factor=OVERFETCH)
    dense = vector_topk(queries.where(~is_blank("query")), index.vectors, k, allowed, default_source, factor=OVERFETCH)
    return rrf_fuse([dense, sparse], _with_k(queries, k).select("query_id", "_k"), rrf_k)


def cap_per_document(hits: DataFrame, max_per_document: int = MAX_PER_DOCUMENT) -> DataFrame:
    """Keep the first m hits of a document per query; hits without a document always stay."""
    if max_per_document <= 0:
        return hits
    missing = F.coalesce(F.col("document_id"), F.lit("")) == ""
    order = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return (
        hits.withColumn("_nth", F.row_number().over(order))
        .where(missing | (F.col("_nth") <= max_per_document)).drop("_nth")
    )


def hit_rows(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the stored payload to ranked chunk ids, with the defaults of the hit shape.

    Ranked lists hold at most k rows per query. They are written first, so the
    search runs once however often the hits are read, and are the measured,
    broadcast side of one unshuffled scan of the payload table.
    """
    joined = broadcast_if_small(settle(ranked, "ranked")).join(chunks, "chunk_id")
    have = set(joined.columns)

    def col(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in have else default).alias(name)

    none = F.lit(None).cast("string")
    shaped = joined.select(
        "query_id", "rank", "chunk_id",
        col("document_id", F.lit("")), col("document_title", F.lit("Untitled")),
        col("document_url", none), col("document_content_path", none),
        col("source_type", F.lit(DEFAULT_SOURCE_TYPE)), col("content", F.lit("")),
        col("section_path", F.array().cast("array<string>")), col("anchor", none),
        col("chunk_index", F.lit(0)), col("char_start", F.lit(0)), col("char_end", F.lit(0)), "score",
    )
    return settle(shaped, "hits")


def citation_rows(hits: DataFrame) -> DataFrame:
    """The ten citation columns (typed defaults, no score) beside the query and rank."""
    none = F.lit(None).cast("string")
    defaults = {
        "chunk_id": F.lit(""), "content": F.lit(""), "document_id": F.lit(""), "document_title": F.lit(""),
        "document_url": none, "document_content_path": none, "source_type": F.lit(""),
        "section_path": F.array().cast("array<string>"), "anchor": none, "chunk_index": F.lit(0),
    }
    have = set(hits.columns)
    return hits.select(
        "query_id", "rank",
        *[(F.coalesce(F.col(c), d) if c in have else d).alias(c) for c, d in defaults.items()],
    )
