"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

Index: documents are read in shards of bounded size. A shard is one row: its documents' ids and lengths, and per term a list of
postings in blocks of ``BLOCK``, compressed to bytes (gaps between documents, frequencies). Beside each block stand its
last document, its highest frequency and its shortest document, which bound every score in it.

Search, per shard and query, lists in falling order of their greatest score:

1. While the lists that follow could still lift a new document to the k-th best score (the heap's, or that of the sums so far if
   higher), a list is essential: it is read whole and every document in it is a candidate.
2. The others only add to candidates. A candidate is dropped when its sum, the bound of its block in this list and
   the bounds of the lists after it stay below the k-th best score; blocks without a candidate left are never decompressed.
3. What is left enters the query's heap, which goes on to the task's next shard. The tasks' heaps are merged at the end.

All scores are 64-bit integers, so bounds and ties are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_work_dir, settle
from .common import slices, texts

DEPTH = 50
BLOCK = 128
SHARD_BYTES = 8 << 20
SHARD_ROWS = 1 << 16
PIECE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch: both the JVM and the Python worker hold it whole, beside the executor's heap
# Rows of megabytes: Parquet's first look at its buffers comes after 100 rows unless told otherwise, and pages and row groups, which
# readers hold whole, would grow to all shards of a task. So each row is looked at, and a group ends before it would exceed 8 MB by another row.
_FILE_LIMITS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
QUERIES_PER_PASS = 1024
MERGE_PARTS = 64
_NO_ID = -(1 << 63)
_LONG = 1 << 63

# A-Z become a-z, all other characters below 0x80 but a-z and 0-9 end a term; bytes of longer characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

SHARDS = ("ids array<long>, lengths array<int>, n_terms long, n_held long, terms array<binary>, df array<int>, widths array<int>, "
          "last array<int>, top_tf array<int>, least_length array<int>, postings binary")


# --- terms -----------------------------------------------------------------------


def _pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text's bytes in pieces that end between terms."""
    start = 0
    while len(data) - start > size:
        end = data.find(b" ", start + size)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:]


def term_counts(of: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """terms (distinct), and (term's number, text's number, count) of each that occurs, sorted, for large_binary texts."""
    names, codes, owners, counts = [], [], [], []
    group: list[bytes] = []
    first = held = 0

    def close(n: int) -> None:
        nonlocal group, first, held
        if group:
            words = pc.split_pattern(pa.array(group, pa.binary()), b" ")
            owner = np.repeat(np.arange(len(group)), pc.list_value_length(words).to_numpy()) + first
            coded = words.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            empty = pc.index(coded.dictionary, pa.scalar(b"", coded.dictionary.type)).as_py()
            keep = code != empty
            key, count = np.unique(code[keep] * (len(of) + 1) + owner[keep], return_counts=True)
            names.append(coded.dictionary)
            codes.append(key // (len(of) + 1))
            owners.append(key % (len(of) + 1))
            counts.append(count)
        group, first, held = [], n, 0

    for i, text in enumerate(of):
        for j, piece in enumerate(_pieces(text.as_buffer().to_pybytes().translate(_TABLE) if text.is_valid else b"")):
            if j or held + len(piece) > PIECE_BYTES:
                close(i)
            group.append(piece)
            held += len(piece)
    close(len(of))
    if not names:
        none = np.zeros(0, np.int64)
        return pa.array([], pa.binary()), none, none, none
    whole = pa.chunked_array(names).dictionary_encode()
    terms = whole.chunk(0).dictionary
    code = np.concatenate([c.indices.to_numpy(zero_copy_only=False).astype(np.int64)[k] for c, k in zip(whole.chunks, codes, strict=True)])
    key, at = np.unique(code * (len(of) + 1) + np.concatenate(owners), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    return terms, key // (len(of) + 1), key % (len(of) + 1), count


# --- shards ----------------------------------------------------------------------


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _lists(values, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _put(buffer: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for byte in range(4):
        on = width > byte
        buffer[at[on] + byte] = (values[on] >> (8 * byte)) & 255


def make_shard(ids: pa.Array, of: pa.Array) -> pa.RecordBatch:
    """One row of the index."""
    terms, code, doc, tf = term_counts(of)
    lengths = np.bincount(doc, tf, len(of)).astype(np.int64)
    used, df = np.unique(code, return_counts=True)
    starts = np.cumsum(df) - df
    nth = np.arange(len(doc)) - np.repeat(starts, df)
    before = np.where(nth == 0, -1, np.concatenate([[-1], doc[:-1]]))
    gap = doc - before
    block_starts = np.flatnonzero(nth % BLOCK == 0)
    if len(doc):
        def width(x):
            most = np.maximum.reduceat(x, starts)
            return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))

        gap_width, tf_width = width(gap), width(tf)
        top_tf, least = np.maximum.reduceat(tf, block_starts), np.minimum.reduceat(lengths[doc], block_starts)
        last = doc[np.append(block_starts[1:], len(doc)) - 1]
    else:
        gap_width = tf_width = top_tf = least = last = np.zeros(0, np.int64)
    # a list's gaps, then its frequencies
    size = df * (gap_width + tf_width)
    base = np.cumsum(size) - size
    postings = np.zeros(int(size.sum()), np.uint8)
    of_list = np.repeat(np.arange(len(df)), df)
    _put(postings, base[of_list] + nth * gap_width[of_list], gap, gap_width[of_list])
    _put(postings, base[of_list] + df[of_list] * gap_width[of_list] + nth * tf_width[of_list], tf, tf_width[of_list])
    return pa.RecordBatch.from_arrays([
        _lists(pc.fill_null(ids, _NO_ID), pa.int64()), _lists(lengths, pa.int32()), pa.array([int(lengths.sum())]), pa.array([int((lengths > 0).sum())]),
        _lists(terms.take(pa.array(used)).cast(pa.binary()), None), _lists(df, pa.int32()), _lists(gap_width * 8 + tf_width, pa.int32()),
        _lists(last, pa.int32()), _lists(top_tf, pa.int32()), _lists(least, pa.int32()), pa.array([postings.tobytes()], pa.binary()),
    ], names=[c.split()[0] for c in SHARDS.split(", ")])


@dataclass(frozen=True)
class RankedIndex:
    """A written index: one row per shard."""

    spark: SparkSession
    path: str

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARDS).parquet(self.path)


def build(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> RankedIndex:
    """Write the index of all documents' whole texts; repeated rows are documents of their own, a null text has no terms."""

    def run(batches):
        ids, held, size = [], [], 0

        def shard():
            return make_shard(pa.concat_arrays(ids), pa.concat_arrays(held))

        # small slices are put together, so that a shard is about as large as it may be wherever batches end
        for part in slices(batches, rows=shard_rows, size=shard_bytes // 8):
            more = part.column("text").cast(pa.large_binary())
            if held and (size + more.nbytes > shard_bytes or sum(map(len, held)) + len(more) > shard_rows):
                yield shard()
                ids, held, size = [], [], 0
            ids.append(part.column("doc_id"))
            held.append(more)
            size += more.nbytes
        if held:
            yield shard()

    path = path or new_work_dir(docs.sparkSession, "ranked-index")
    _bounded(docs.sparkSession)
    texts(docs).mapInArrow(run, SHARDS).write.mode("overwrite").options(**_FILE_LIMITS).parquet(path)
    return RankedIndex(docs.sparkSession, path)


class Shard:
    """A shard row as its reader sees it. ``decoded`` counts the blocks it decompressed."""

    def __init__(self, row: pa.RecordBatch):
        def column(name):
            return row.column(name).flatten().to_numpy(zero_copy_only=False)

        self.ids, self.lengths = column("ids"), column("lengths").astype(np.int64)
        self.terms, self.df, width = row.column("terms").flatten(), column("df").astype(np.int64), column("widths").astype(np.int64)
        self.gap_width, self.tf_width = width // 8, width % 8
        size = self.df * (self.gap_width + self.tf_width)
        self.base = np.cumsum(size) - size
        blocks = -(-self.df // BLOCK)
        self.first_block = np.cumsum(blocks) - blocks
        self.n_blocks = blocks
        self.last, self.top_tf, self.least = column("last").astype(np.int64), column("top_tf").astype(np.int64), column("least_length").astype(np.int64)
        self.postings = np.frombuffer(row.column("postings")[0].as_buffer(), np.uint8)
        self.decoded = 0

    def _read(self, base: int, width: int, at: np.ndarray) -> np.ndarray:
        out = self.postings[base + at * width].astype(np.int64)
        for byte in range(1, width):
            out |= self.postings[base + at * width + byte].astype(np.int64) << (8 * byte)
        return out

    def blocks(self, t: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks of list ``t``."""
        self.decoded += len(which)
        df, gw, tw, first = int(self.df[t]), int(self.gap_width[t]), int(self.tf_width[t]), int(self.first_block[t])
        at = which[:, None] * BLOCK + np.arange(BLOCK)
        there = at < df
        at = np.minimum(at, df - 1)
        gaps = np.where(there, self._read(int(self.base[t]), gw, at), 0)
        gaps[:, 0] += np.where(which > 0, self.last[first + which - 1], -1)
        docs = np.cumsum(gaps, axis=1)[there]
        return docs, self._read(int(self.base[t]) + df * gw, tw, at[there])


# --- scores ----------------------------------------------------------------------


@dataclass(frozen=True)
class Corpus:
    """N documents with a term, and L terms of all documents."""

    n: int
    total: int

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """m = 100 - 50 + ((50 * n * N) div L) of documents of ``lengths`` terms."""
        if 50 * self.n * int(lengths.max(initial=0)) < _LONG:
            return 50 + 50 * self.n * lengths // self.total
        return np.array([50 + 50 * self.n * int(n) // self.total for n in lengths], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))


def part_score(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


class Heap:
    """The best ``depth`` (score, doc_id) of a query so far; ties go to the smaller id."""

    def __init__(self, depth: int):
        self.depth, self.scores, self.ids = depth, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """A document below this score can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.depth else 1

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        best = np.lexsort((ids, -scores))[:self.depth]
        self.scores, self.ids = scores[best], ids[best]


class Searcher:
    """Scores one shard for many queries; the lists it has read stay for the next query."""

    def __init__(self, shard: Shard, corpus: Corpus):
        self.shard, self.corpus, self.norm = shard, corpus, corpus.norm(shard.lengths)
        self.bounds: dict[int, np.ndarray] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block_bounds(self, t: int) -> np.ndarray:
        """The greatest part score each block of list ``t`` may hold."""
        if t not in self.bounds:
            s = self.shard
            at = slice(int(s.first_block[t]), int(s.first_block[t] + s.n_blocks[t]))
            self.bounds[t] = part_score(s.top_tf[at], self.corpus.norm(s.least[at]))
        return self.bounds[t]

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.lists:
            docs, tf = self.shard.blocks(t, np.arange(int(self.shard.n_blocks[t])))
            self.lists[t] = docs, part_score(tf, self.norm[docs])
        return self.lists[t]

    def search(self, asked: list[tuple[int, int]], heap: Heap) -> None:
        """``asked``: (list, weight) of the query's terms that this shard holds; weights are positive."""
        order = sorted(((int(self.block_bounds(t).max()) * w, t, w) for t, w in asked), reverse=True)
        left = np.cumsum([b for b, _, _ in order][::-1])[::-1].tolist() + [0]
        sums, floor, i = np.zeros(len(self.norm), np.int64), heap.floor, 0
        while i < len(order) and left[i] >= floor:
            _, t, w = order[i]
            docs, part = self.whole(t)
            sums[docs] += w * part
            i += 1
            if i < len(order) and len(sums) > heap.depth:
                floor = max(floor, int(np.partition(sums, len(sums) - heap.depth)[len(sums) - heap.depth]))
        alive = np.flatnonzero(sums)
        for at in range(i, len(order)):
            _, t, w = order[at]
            alive = alive[sums[alive] + left[at] >= floor]
            if not len(alive):
                return
            first = int(self.shard.first_block[t])
            block = np.searchsorted(self.shard.last[first:first + int(self.shard.n_blocks[t])], alive)
            bound = np.append(self.block_bounds(t), 0)[block] * w
            alive, block = (x[sums[alive] + bound + left[at + 1] >= floor] for x in (alive, block))
            if t in self.lists:
                docs, part = self.lists[t]
            else:
                docs, tf = self.shard.blocks(t, np.unique(block[block < int(self.shard.n_blocks[t])]))
                part = part_score(tf, self.norm[docs])
            place = np.minimum(np.searchsorted(docs, alive), max(0, len(docs) - 1))
            hit = docs[place] == alive if len(docs) else np.zeros(len(alive), bool)
            sums[alive[hit]] += w * part[place[hit]]
            if len(alive) > heap.depth:
                floor = max(floor, int(np.partition(sums[alive], len(alive) - heap.depth)[len(alive) - heap.depth]))
        alive = alive[sums[alive] >= floor]
        heap.push(sums[alive], self.shard.ids[alive])


# --- search ----------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term binary: each query's distinct terms."""

    def run(batches):
        for part in slices(batches):
            terms, code, owner, _ = term_counts(part.column("text").cast(pa.large_binary()))
            yield pa.record_batch([part.column("qid").take(pa.array(owner)), terms.take(pa.array(code)).cast(pa.binary())], ["qid", "term"])

    return queries.mapInArrow(run, "qid long, term binary")


def document_frequencies(index: RankedIndex, wanted: list[bytes]) -> dict[bytes, int]:
    """Of each wanted term, the documents of all shards that hold it."""
    names = pa.array(wanted, pa.binary())

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.index_in(batch.column("terms").slice(row, 1).flatten(), value_set=names)
                known = pc.is_valid(at)
                yield pa.record_batch([at.filter(known).cast(pa.int32()), batch.column("df").slice(row, 1).flatten().filter(known).cast(pa.int64())], ["term", "df"])

    found = index.shards.select("terms", "df").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {wanted[r["term"]]: r["df"] for r in found}


def _one_pass(index: RankedIndex, asked: dict[int, list[bytes]], corpus: Corpus, depth: int) -> DataFrame:
    """Each task's heaps for the queries of one pass: qid, doc_id, score."""
    names = sorted({t for terms in asked.values() for t in terms})
    df = document_frequencies(index, names)
    number = {t: i for i, t in enumerate(names)}
    weight = [corpus.weight(df[t]) if t in df else 0 for t in names]
    wanted = {q: [number[t] for t in terms if weight[number[t]] > 0] for q, terms in asked.items()}
    shared = index.spark.sparkContext.broadcast((pa.array(names, pa.binary()), weight, wanted))

    def run(batches):
        names, weight, wanted = shared.value
        heaps = {q: Heap(depth) for q in wanted}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1))
                at = pc.index_in(names, value_set=shard.terms).to_numpy(zero_copy_only=False)
                searcher = Searcher(shard, corpus)
                for q, terms in wanted.items():
                    here = [(int(at[t]), weight[t]) for t in terms if at[t] == at[t]]
                    if here:
                        searcher.search(here, heaps[q])
        for q, heap in heaps.items():
            if len(heap.ids):
                yield pa.record_batch([pa.array(np.full(len(heap.ids), q)), pa.array(heap.ids), pa.array(heap.scores)], ["qid", "doc_id", "score"])

    return index.shards.mapInArrow(run, "qid long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, depth: int = DEPTH, index: RankedIndex | None = None, per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``depth`` best documents of each query (item_id, text), best first.

    Equal scores go by ascending doc_id (null first). Null, empty and term-free texts match nothing. Repeated rows of documents are documents of their
    own, ranked one after the other; queries that repeat an id are one query each, ranked under one id. Queries go in passes of ``per_pass``,
    as one pass's terms are sent to every task; documents are indexed whole, whatever their length.
    """
    spark = docs.sparkSession
    _bounded(spark)
    index = index or build(docs)
    stats = index.shards.agg(F.sum("n_held").alias("n"), F.sum("n_terms").alias("total")).first()
    corpus = Corpus(stats["n"] or 0, stats["total"] or 0)
    numbered = queries.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("qid"))
    numbered = settle(numbered, "queries")
    terms = settle(query_terms(numbered.select("qid", "text")), "query-terms")
    passes = max(1, -(-numbered.count() // per_pass))
    # by hash, so a pass holds about as many queries
    in_pass = F.pmod(F.xxhash64("qid"), F.lit(passes))
    found = None
    for p in range(passes if corpus.n else 0):
        asked: dict[int, list[bytes]] = {}
        for r in terms.where(in_pass == p).collect():
            asked.setdefault(r["qid"], []).append(bytes(r["term"]))
        if asked:
            heaps = _one_pass(index, asked, corpus, depth)
            found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return spark.createDataFrame([], f"item_id {numbered.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    # each heap is sorted; merged in two steps, so that the heaps of all tasks don't meet in one
    best = [F.desc("score"), F.asc("doc_id")]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    few = found.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "part").orderBy(*best))).where(F.col("nth") <= depth)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best))).where(F.col("rank") <= depth)
    return top.join(numbered.select("qid", "item_id"), "qid").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(_NO_ID).cast("long")).alias("doc_id"), "score")
