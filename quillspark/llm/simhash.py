"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``radius`` differing bits are linked, and documents reachable over links
form one component. A random linear map gives each of the 64 bits a vector of ``radius + 1``
bits; every non-zero vector ``v`` of that length is a table whose mask holds the bits whose
vector is orthogonal to ``v``. At most ``radius`` differing bits span less than the whole
space, so some ``v`` is orthogonal to all of them: the pair agrees on that table's mask and
meets in one of its buckets, always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import map_slices, texts

RADIUS = 2
SEED = 42
SHINGLE = 3
BUCKET_LIMIT = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, seed: int = SEED, width: int = SHINGLE) -> int:
    """The 64-bit majority of the shingles' XXH64 values, as a signed number; 0 without words."""
    import xxhash

    words = text.translate(_LOWER).split()  # bytes.split cuts at space and 9..13
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 4096):
        run = words[lo:min(n, lo + 4096) + width - 1]
        if width == 3 and len(words) >= 3:
            hashes = [digest(b"%b %b %b" % s, seed) for s in zip(run, run[1:], run[2:])]
        else:
            hashes = [digest(b" ".join(run[i:i + width]), seed) for i in range(max(1, len(run) - width + 1))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row's whole text; a null text counts as empty, with fp 0."""

    def make():
        def step(batch):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            return pa.record_batch([batch.column("doc_id"), pa.array([fingerprint(t) for t in raw], pa.int64())], ["doc_id", "fp"])

        return step

    return map_slices(texts(docs), make, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 20) -> list[int]:
    """The 2^(radius + 1) - 1 masks, as signed numbers.

    Bit positions get the non-zero vectors in turn, in a shuffled order, so all masks have about as many bits.
    """
    size = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, size), bits)
    np.random.default_rng(seed).shuffle(vectors)
    masks = []
    for v in range(1, size):
        mask = sum(1 << i for i, m in enumerate(vectors.tolist()) if bin(m & v).count("1") % 2 == 0)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the members of one small bucket as all their links would, at most one per member."""
    left = np.sort(members.view(np.uint64))  # bits of a negative number would be counted without its sign
    while len(left):
        group, rest = left[:1], left[1:]
        frontier = group
        while len(frontier) and len(rest):
            near = (np.bitwise_count(frontier[:, None] ^ rest[None, :]) <= radius).any(0)
            frontier, rest = rest[near], rest[~near]
            group = np.concatenate([group, frontier])
        group = group.view(np.int64)
        yield from ((int(m), int(group[0])) for m in group[1:])
        left = rest


def links(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (a, b), a > b, of distinct fingerprints whose components are those of all links.

    ``fps`` has distinct ``fp``. Buckets of up to ``limit`` members are joined in one list;
    they yield a spanning forest, not all pairs. Members of larger buckets take the exact
    way for the rest: two fingerprints are within 2 r bits exactly if balls of radius r
    around them meet, so each member names its ball's points and
    joins the smallest member that names the same point: linear in the members, however large the bucket.
    """
    if radius != 2:
        raise ValueError("links between members of large buckets are made for a radius of 2")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                 for i, m in enumerate(masks)])).alias("t")
    keys = settle(fps.select("fp", tables).select("fp", "t.table", "t.key"), "covering-keys")
    sizes = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(keys.join(sizes, ["table", "key"]), "covering-buckets")
    small = shared.where(F.col("n") <= limit).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))

    def forests(batches):
        for batch in batches:
            found = [pair for members in batch.column("fps") for pair in _forest(np.array(members.as_py(), np.int64), radius)]
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    near = small.select("fps").mapInArrow(forests, "a long, b long")
    crowded = shared.where(F.col("n") > limit).select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    named = crowded.select("fp", F.explode(points).alias("point"))
    least = named.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "b")
    far = named.join(least, "point").where("fp > b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node that has an edge.

    Alternates two steps until nothing changes: each node's larger neighbours move to its
    smallest neighbour, then its smaller ones do. Every round is a written table; a node's
    neighbours are only ever aggregated to their minimum, so a hot node is combined before the shuffle.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large.where("a != b"), "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        after = settle(small, "edges-small")
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        edges = after


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root: one fingerprint that stands for all that are reachable from it."""
    distinct = settle(prints.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, radius))
    return settle(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    One row per input row; rows that repeat an id keep their own fingerprints. Null and
    empty texts have fingerprint zero and are linked like any other. Null ids have a
    row, and a null component only where the whole component has no id.
    Equal fingerprints are joined first, so only distinct ones meet in buckets.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    rooted = _roots(prints, radius)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted, "fp")
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null first), then of the smallest text hash.

    Rows that repeat both id and text are one document, of which one row stays.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("__k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th")]

    def make():
        def step(batch):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            return pa.record_batch([batch.column("__k"), batch.column("__th"), pa.array([fingerprint(t) for t in raw], pa.int64())], ["__k", "__th", "fp"])

        return step

    prints = map_slices(docs.select(*key, F.coalesce("text", F.lit("")).alias("text")), make, "__k long, __th long, fp long")
    prints = settle(prints.groupBy("fp").agg(F.min(F.struct("__k", "__th")).alias("first")), "fingerprint-heads")
    heads = prints.join(_roots(prints, radius), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    kept = docs.select("*", *key).join(heads, ["__k", "__th"], "left_semi")
    return kept.dropDuplicates(["__k", "__th"]).select(*docs.columns)
