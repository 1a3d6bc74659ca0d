"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

An exact prefix-filtered join. All sets are put into one order, rare shingles first: at 0.8, two similar sets of at most n shingles
share one of the first n // 5 + 1 of each. So documents meet by the shingles of their prefixes, in buckets. A common passage
comes last in the order and brings no documents together that share nothing else.

1. The frequency of every shingle is counted; the most frequent ones (a bounded table) are sent to all tasks. All others count as
   equally rare and go by hash. Which shingles are in that table changes the sizes of buckets, never the links.
2. Equal sets are one node. Buckets of a few nodes give their pairs, if sizes and places in the prefixes allow a link.
3. In a larger bucket (many near copies) all are compared with one hub. Nodes that this leaves in another component meet the bucket's
   members in blocks: bit maps bound what two sets can share, and only links that join components leave the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle
from .common import map_slices, slices
from .simhash import _LOWER, components

WIDTH = 5  # words of a shingle
SIMILAR = (4, 5)  # least similarity, as a fraction
PAIRED = 32  # members of a bucket up to which all its pairs are compared at once
FREQUENT = 1_000_000  # shingles whose frequency every task knows
COUNTED = 1_000_000  # shingles counted together, roughly
BLOCK = 256  # members of a block in large buckets
_SALTS = 16
KNOWN = 2_000_000  # repeated shingles that are sent to all tasks; more are joined
BATCH_ROWS = 256  # rows with sets or maps in an Arrow batch
_SHIFT = np.uint64(32)  # frequencies are counted for the first four bytes of a hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its shingles. Fewer words than ``width`` are one shingle, no words none."""
    from xxhash import xxh3_64_intdigest

    words = [t.translate(_LOWER).split() for t in texts]
    coded = pa.array([w for of in words for w in of], pa.binary()).dictionary_encode()
    known = np.array([xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else known
    at = 0
    for of in words:
        part, n = hashes[at:at + len(of)], max(1, len(of) - width + 1)
        at += len(of)
        if not len(part):
            yield part
            continue
        value = np.full(n, len(part) if len(part) < width else width, np.uint64)
        for j in range(min(width, len(part))):
            value = _mix(value + part[j:j + n])
        yield np.unique(value)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the least similarity; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def named(docs: DataFrame) -> DataFrame:
    """The rows with ``__k`` and ``__th``, which name a document."""
    return docs.withColumns({
        "__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")),
        "__th": F.xxhash64(F.coalesce("text", F.lit("")))})


def _packed(codes: np.ndarray) -> bytes:
    """Sorted 32-bit codes as their gaps, low halves first: the high ones are nearly all zero and compress."""
    gaps = np.diff(codes, prepend=np.uint64(0)).astype("<u4")
    return (gaps & 0xFFFF).astype("<u2").tobytes() + (gaps >> 16).astype("<u2").tobytes()


def _unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.uint64)
    return np.cumsum(halves[0] | halves[1] << np.uint64(16), dtype=np.uint64)


def _bits_for(n: int) -> int:
    """Bits of the map of a set of n shingles: a power of two, four to eight per shingle."""
    return min(1 << 20, max(64, 1 << (4 * n).bit_length()))


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """The map as 64-bit words, in which each shingle sets one bit."""
    out = np.zeros(bits := _bits_for(len(shingles)), bool)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A map of more words as one of ``size`` words: halves laid over each other."""
    return words if len(words) <= size else np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def _may_be_similar(n: np.ndarray, maps: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """False where bit maps prove that two sets of sizes n and m share too little: what one map lacks of the other isn't shared."""
    most = np.minimum(n - np.bitwise_count(maps & ~others).sum(-1, dtype=np.int64), m - np.bitwise_count(others & ~maps).sum(-1, dtype=np.int64))
    return most * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (n + m)


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.coalesce("text", F.lit("")).alias("text"))


def frequent_shingles(rows: DataFrame, most: int = FREQUENT, above: int = PAIRED) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (the first four bytes of each, sorted) in more than ``above`` documents and their numbers; the ``most`` frequent, if more.

    Counted in all documents. Codes and counts travel packed, one row per slice of texts and range of codes.
    """
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, chars // (6 * COUNTED))

    def count(batches):
        for part in slices(batches):
            sets = list(shingle_sets(part.column("text").cast(pa.large_binary()).to_pylist()))
            codes, n = np.unique(np.concatenate(sets) >> _SHIFT, return_counts=True)
            group = (codes * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1 if len(group) else []
            out, lo = ([], [], []), 0
            for hi in ends:
                out[0].append(int(group[lo]))
                out[1].append(_packed(codes[lo:hi]))
                out[2].append(n[lo:hi].astype("<u4").tobytes())
                lo = hi
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["shingles", "codes", "counts"])

    def total(codes, counts):
        # code and count in one number each, sorted in place
        both = np.concatenate([c << _SHIFT | n for c, n in zip(codes, counts, strict=True)])
        both.sort()
        head = np.flatnonzero(np.append(True, (both[1:] ^ both[:-1]) >> _SHIFT != 0))
        found, n = both[head] >> _SHIFT, np.add.reduceat(both & np.uint64(0xFFFFFFFF), head)
        keep = n > above
        return pa.record_batch([pa.array(found[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["code", "df"])

    def add(batches):
        now, codes, counts = None, [], []
        for batch in batches:
            for group, packed, many in zip(batch.column("shingles").to_pylist(), batch.column("codes"), batch.column("counts"), strict=True):
                if group != now and codes:
                    yield total(codes, counts)
                    codes, counts = [], []
                now = group
                codes.append(_unpacked(packed.as_buffer()))
                counts.append(np.frombuffer(many.as_buffer(), "<u4"))
        if codes:
            yield total(codes, counts)

    parts = _texts(rows).mapInArrow(count, "shingles long, codes binary, counts binary")
    found = parts.repartition(groups, "shingles").sortWithinPartitions("shingles").mapInArrow(add, "code long, df long")
    top = found.orderBy(F.desc("df"), "code").limit(most).toArrow()
    codes = top.column("code").to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return codes[order], top.column("df").to_numpy()[order]


def prefixes(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of each sorted set, its first n // 5 + 1 shingles: by frequency, then by hash."""
    codes, df = frequent
    out = []
    whole = np.concatenate([*sets, np.zeros(0, np.uint64)])
    f = np.zeros(len(whole), np.int64)
    if len(codes):
        at = np.minimum(np.searchsorted(codes, whole >> _SHIFT), len(codes) - 1)
        f = np.where(codes[at] == whole >> _SHIFT, df[at], 0)
    lo = 0
    for s in sets:
        here, n = f[lo:lo + len(s)], len(s) // SIMILAR[1] + 1
        lo += len(s)
        rare = s[here == 0][:n]
        out.append(rare if len(rare) == min(n, len(s)) else s[np.lexsort((s, here))[:n]])
    return out


def _signed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """__k, __th, node (hash of the shingle set), n (its size), prefix, bits (its bit map)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        from xxhash import xxh3_64_intdigest

        def step(batch):
            sets = list(shingle_sets(batch.column("text").cast(pa.large_binary()).to_pylist()))
            nodes = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            return pa.record_batch([batch.column("__k"), batch.column("__th"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()),
                                    pa.array([p.view(np.int64) for p in prefixes(sets, shared.value)], pa.list_(pa.int64())),
                                    pa.array([bit_map(x).tobytes() for x in sets], pa.binary())], ["__k", "__th", "node", "n", "prefix", "bits"])

        return step

    return map_slices(_texts(docs, "__k", "__th"), make, "__k long, __th long, node long, n long, prefix array<long>, bits binary")


def _sets(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """node, shingles (the sorted hashes as bytes) of the documents that stand for ``heads``."""

    def make():
        seen: set[int] = set()

        def step(batch):
            # rows may repeat id and text: each task makes a node's set once
            new = [n not in seen and not seen.add(n) for n in batch.column("node").to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            sets = shingle_sets(batch.column("text").cast(pa.large_binary()).to_pylist())
            return pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

        return step

    of = _texts(docs, "__k", "__th").join(broadcast_if_small(heads.select("node", "first.*")), ["__k", "__th"])
    return map_slices(of.select("node", "text"), make, "node long, shingles binary")


def _plausible(pairs: DataFrame, heads: DataFrame, salts: int = 1) -> DataFrame:
    """The pairs (a, b) whose bit maps allow a link. With ``salts``, a b of very many pairs is spread over as many keys."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("an").to_numpy(), batch.column("bn").to_numpy(), batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_may_be_similar(n, folded(x, len(y)), m, folded(y, len(x))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = heads.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("x"))
    y = heads.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("y"))
    return _salted(pairs, x, y, salts).select("a", "b", "an", "bn", "x", "y").mapInArrow(run, "a long, b long")


def _salted(pairs: DataFrame, x: DataFrame, y: DataFrame, salts: int) -> DataFrame:
    y = y.join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int")).join(x, "a").join(y, ["b", "salt"])


def _verified(pairs: DataFrame, sets: DataFrame, salts: int = 1) -> DataFrame:
    """Those of the pairs (a, b) that are similar. With ``salts``, a b of very many pairs is spread over as many keys."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            yield batch.select(["a", "b"]).filter(pa.array([
                similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)], pa.bool_()))

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(c)) for n, c in (("a", "x"), ("b", "y")))
    return _salted(pairs, x, y, salts).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _all_pairs(batches):
    """The pairs of each small bucket whose sizes and places allow a link."""
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        members = batch.column("members")
        flat = members.flatten()
        node, n, pos = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "pos"))
        bounds = members.offsets.to_numpy() - members.offsets[0].as_py()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            v, m, at = node[lo:hi], n[lo:hi], pos[lo:hi]
            # no more than what stands before, this shingle and what stands after can be shared
            most = 1 + np.minimum(at[:, None], at) + np.minimum((m - at)[:, None], m - at) - 1
            i, j = np.nonzero((most * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (m[:, None] + m)) & (v[:, None] > v))
            a.append(v[i])
            b.append(v[j])
        yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def joining_links(apart: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Similar pairs of (node, root, set) from either side that join all components which such pairs can join."""
    maps = [[bit_map(s) for _, _, s in side] for side in (apart, members)]
    words = min((len(m) for side in maps for m in side), default=1)
    own, theirs = ([folded(m, words) for m in side] for side in maps)
    theirs, sizes = np.array(theirs, np.uint64).reshape(len(members), words), np.array([len(s) for _, _, s in members], np.int64)
    top: dict[int, int] = {}

    def root(r):
        while top.setdefault(r, r) != r:
            r = top[r]
        return r

    out = []
    for (node, r, s), mine in zip(apart, own, strict=True):
        for j in np.flatnonzero(_may_be_similar(np.int64(len(s)), mine, sizes, theirs)).tolist():
            other, q, t = members[j]
            if (x := root(r)) != (y := root(q)) and similar(s, t):
                top[x] = y
                out.append((node, other))
    return out


def _crossed(placed: DataFrame, apart: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between nodes ``apart`` (code, node, root) and the members ``placed`` of their buckets, block by block."""
    sizes = placed.join(apart.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(
        apart.groupBy("code").agg(F.count(F.lit(1)).alias("m")), "code")
    sizes = sizes.select("code", F.ceil(F.col("n") / block).cast("int").alias("theirs"), F.ceil(F.col("m") / block).cast("int").alias("mine"))

    def side(rows, own, others, role):
        number = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others)
        spread = rows.join(sizes, "code").select("code", "node", "root", number, F.col(others).alias("_n")).withColumnRenamed("_n", others)
        return spread.select("code", "node", "root", own, every).select("code", "node", "root", "mine", "theirs", F.lit(role).alias("role"))

    both = side(apart, "mine", "theirs", 0).unionByName(side(placed, "theirs", "mine", 1)).join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        sides = ([], [])
        for node, root, role, s in zip(*(table.column(c).to_pylist() for c in ("node", "root", "role", "shingles")), strict=True):
            sides[role].append((node, root, np.frombuffer(s, np.uint64)))
        found = joining_links(*(sorted(x, key=lambda m: m[0]) for x in sides))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return both.groupBy("code", "mine", "theirs").applyInArrow(run, "a long, b long")


def _in_buckets(members: DataFrame, heads: DataFrame, sizes: DataFrame, known: int) -> DataFrame:
    """node, n, copies, pos, code, size of the prefix shingles that several nodes have."""
    if sizes.count() > known:
        return members.join(sizes, "code").select("node", "n", "copies", "pos", "code", "size")
    table = sizes.toArrow()
    codes, size = (table.column(c).to_numpy() for c in ("code", "size"))
    order = np.argsort(codes)
    shared = heads.sparkSession.sparkContext.broadcast((codes[order], size[order]))

    def run(batches):
        codes, size = shared.value
        for batch in batches:
            prefix = batch.column("prefix")
            lengths, code = np.diff(prefix.offsets.to_numpy()), prefix.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = np.flatnonzero(codes[at] == code) if len(codes) else np.zeros(0, np.int64)
            of = pa.array(owner[hit])
            yield pa.record_batch([*(batch.column(c).take(of) for c in ("node", "n", "copies")), pa.array(pos[hit].astype(np.int32)),
                                   pa.array(code[hit]), pa.array(size[at[hit]])], ["node", "n", "copies", "pos", "code", "size"])

    return heads.select("node", "n", "copies", "prefix").mapInArrow(run, "node long, n long, copies long, pos int, code long, size long")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs started inside send rows to Python in batches of at most ``rows``: each may hold the sets of two long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def links(docs: DataFrame, heads: DataFrame, paired: int = PAIRED, block: int = BLOCK, known: int = KNOWN) -> DataFrame:
    """Pairs (a, b) of similar nodes whose components are those of all similar nodes.

    ``docs`` are named rows, ``heads`` has node, n, copies, prefix, bits and first, a row per node. All pairs of a bucket of up to
    ``paired`` members that may be similar are compared. In a larger one all are compared with the member
    of most copies; those that this doesn't join are compared with the members of other components in blocks.
    """
    members = heads.select("node", "n", "copies", F.posexplode("prefix").alias("pos", "code"))
    sizes = settle(members.groupBy("code").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    shared = settle(_in_buckets(members, heads, sizes, known), "shared-buckets")
    small = shared.where(F.col("size") <= paired).groupBy("code").agg(F.collect_list(F.struct("node", "n", F.col("pos").cast("long").alias("pos"))).alias("members"))
    large = shared.where(F.col("size") > paired)
    hubs = large.groupBy("code").agg(F.max(F.struct("copies", "node", "n")).alias("hub"))
    large = settle(large.join(hubs, "code").select("code", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "large-buckets")
    spokes = large.where(F.col("node") != F.col("hub")).where(_sizes_fit(F.col("n"), F.col("hub_n"))).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tried, spokes = settle(small.select("members").mapInArrow(_all_pairs, "a long, b long").distinct(), "pairs"), settle(spokes, "spokes")
    with _small_batches(docs.sparkSession):
        tried = settle(_plausible(tried, heads), "plausible-pairs")
        spokes = settle(_plausible(spokes, heads, _SALTS), "plausible-spokes")
    asked = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    sets = settle(_sets(docs, settle(heads.join(asked, "node", "left_semi").select("node", "first"), "asked")), "shingle-sets")
    with _small_batches(docs.sparkSession):
        found = settle(_verified(tried, sets).unionByName(_verified(spokes, sets, _SALTS)), "similar-pairs")
    if large.isEmpty():
        return found
    roots = settle(components(found), "first-roots")
    root = F.coalesce("root", "node").alias("root")
    placed = settle(large.join(roots, "node", "left").select("code", "node", "hub", root), "placed")
    hub_roots = placed.where("node = hub").select("code", F.col("root").alias("hub_root"))
    apart = settle(placed.join(hub_roots, "code").where("root != hub_root").select("code", "node", "root"), "apart")
    if apart.isEmpty():
        return found
    with _small_batches(docs.sparkSession):
        crossed = settle(_crossed(placed.select("code", "node", "root"), apart, sets, block), "crossed")
    return found.unionByName(crossed)


def keep_one(docs: DataFrame, paired: int = PAIRED, frequent: int = FREQUENT, known: int = KNOWN) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest id (null first), then of the smallest text hash.

    Documents are linked if their shingle sets have a similarity of ``SIMILAR`` or more; components are all that is
    reachable over links. Texts without words are alike. Rows that repeat both id and text are one document, of which one row stays.
    """
    rows = named(docs)
    signed = _signed(rows, frequent_shingles(docs, frequent, paired)).groupBy("node").agg(
        F.min(F.struct("__k", "__th")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    heads = settle(signed, "shingle-heads")
    roots = components(links(rows, heads, paired, known=known))
    kept = heads.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows.join(kept.select("first.*"), ["__k", "__th"], "left_semi").dropDuplicates(["__k", "__th"]).select(*docs.columns)
