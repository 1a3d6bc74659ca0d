"""Exact removal of repeated 100-byte strings across all documents, by suffix sorting in shards.

Whatever shard two equal strings stand in decides nothing if equal strings always meet:

1. Each 100-byte window has an anchor, the least hash among its 16-byte substrings. Neighbouring
   windows with one anchor form a *stretch*. Equal windows have equal anchors. Stretches are
   reduced where they are made: of equal ones in a slice all but the first are marked repeats at once. A stretch that holds its anchor twice may repeat inside.
2. Stretches meet by anchor. Of equal stretches all but the first are repeats. An anchor with one
   stretch left has no more repeats, but for stretches that repeat inside; that is most of the corpus, and its text is never sent.
3. The other anchors' stretches are sent with their text to shards by anchor. A shard's text is sorted by
   external induced sorting (``induced``); of the windows that share 100 bytes all but the first are repeats.
4. The repeats of each document meet and its bytes that any of them covers are removed.

"First" is by (doc_id, place); null ids come first, and rows that share an id are ordered by a hash of their text. Rows that
repeat both id and text are the same document: each has a row, and none is a repeat of the other.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import map_slices, slices
from .induced import BLOCK, DEPTH, InducedSorter, RepeatMarks

LENGTH = DEPTH  # bytes of a repeated string
ANCHOR = 16  # bytes of the substrings that are hashed
STRETCH = 128  # windows of a stretch at most
SHARD_BYTES = 2 << 20
MAX_SHARDS = 65_536  # beyond this many a shard grows instead, and is sorted through the disk queues
SLICE = {"rows": 512, "size": 1 << 20}  # about forty times that is in use while a slice's windows are hashed
PARTS = 4096  # stretches whose texts are sent at a time
NULL_ID = -(1 << 63)
_SEPARATOR = b"\xff"  # never in UTF-8

STRETCHES = "v long, s long, k long, th long, start int, n int, inner boolean, repeat boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """The least or largest of each ``w`` values from a place on."""
    blocks = np.full(-(-len(x) // w) * w + w, fill, x.dtype)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    before = reduce.accumulate(blocks, axis=1).ravel()
    after = reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(after[:len(x)], before[w - 1:len(x) + w - 1])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the least hash of the substrings inside the window that starts there (no meaning near the end),
    and whether that window holds it twice, as all do that have an equal window in their stretch, or one of their stretch does."""
    n, w = len(data), LENGTH - ANCHOR + 1
    words = np.ndarray((n + 8,), "<u8", buffer=np.frombuffer(data + bytes(ANCHOR), np.uint8), strides=(1,))
    with np.errstate(over="ignore"):
        h = _mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) + _mix(words[8:n + 8]))
    least = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    # a place is an anchor if it is the least of some window over it
    over = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), least]), w, np.maximum, 0)[:n]
    at = np.flatnonzero(over == h)
    pair = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] < w))
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, np.maximum(0, at[pair + 1] - w + 1), 1)
    np.add.at(edges, at[pair] + 1, -1)
    return least, np.cumsum(edges[:-1]) > 0


def _found(batches):
    """The stretches of each slice; a text longer than a slice is read in blocks, whose windows don't overlap."""
    size = SLICE["size"]
    for part in slices(batches, **SLICE):
        raw, k, th = part.column("text").cast(pa.large_binary()), part.column("k").to_pylist(), part.column("th").to_pylist()
        if part.num_rows > 1:
            yield _stretches(sorted(zip(k, th, [0] * len(k), raw.to_pylist(), strict=True)))
            continue
        whole = raw[0].as_buffer()
        for lo in range(0, max(1, whole.size - LENGTH + 1), size):
            yield _stretches([(k[0], th[0], lo, whole[lo:lo + size + LENGTH - 1].to_pybytes())])


def _stretches(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """The stretches of sorted (k, th, place of the first byte, bytes), of equal ones only the first; the others as repeats, joined where they touch."""
    from xxhash import xxh3_64_intdigest

    names = [c.split()[0] for c in STRETCHES.split(", ")]
    least, twice = anchors(b"".join([r[3] for r in rows]))
    cols, at = [[] for _ in _TYPES], 0
    for k, th, first, text in rows:
        windows = len(text) - LENGTH + 1
        if windows > 0:
            v = least[at:at + windows]
            cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            n = np.diff(np.append(cut, windows))
            if n.max() > STRETCH:
                parts = -(-n // STRETCH)
                inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                cut, whole = np.repeat(cut, parts) + inner * STRETCH, np.repeat(n, parts)
                n = np.minimum(STRETCH, whole - inner * STRETCH)
            inner = np.logical_or.reduceat(twice[at:at + windows], cut)
            s = [xxh3_64_intdigest(text[a:b]) for a, b in zip(cut.tolist(), (cut + n + LENGTH - 1).tolist(), strict=True)]
            for col, x in zip(cols, (v[cut].view(np.int64), np.array(s, np.uint64).view(np.int64), np.full(len(cut), k), np.full(len(cut), th), cut + first, n, inner), strict=True):
                col.append(x)
        at += len(text)
    if not cols[0]:
        return pa.record_batch([pa.array([], t) for t in (*_TYPES, pa.bool_())], names)
    cols = np.stack([np.concatenate(c) for c in cols])
    # equal stretches side by side, in order of documents; were two others to share this sum, equal ones might stay apart, for the next step
    v, s, k, th, start, n, inner = cols[:, np.argsort(_spread(cols[1]) + cols[0], kind="stable")]
    head = np.append(True, (v[1:] != v[:-1]) | (s[1:] != s[:-1]))
    at_head = np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))
    again = ~head & (k == k[at_head]) & (th == th[at_head]) & (start == start[at_head])  # a repeated row
    rk, rth, rs, rn = (x[~head & ~again] for x in (k, th, start, n + LENGTH - 1))
    order = np.lexsort((rs, rth, rk))
    rk, rth, rs, re = rk[order], rth[order], rs[order], (rs + rn)[order]
    if len(rk):
        # equal stretches of one text have no end beyond a later one's, except in repeated rows: take the running end
        new_doc = np.append(True, (rk[1:] != rk[:-1]) | (rth[1:] != rth[:-1]))
        lift = np.cumsum(new_doc) * (1 << 32)
        reach = np.maximum.accumulate(re + lift) - lift
        fresh = new_doc | np.append(True, rs[1:] > reach[:-1])
        cut = np.flatnonzero(fresh)
        rk, rth, rs, rn = rk[cut], rth[cut], rs[cut], np.maximum.reduceat(re, cut) - rs[cut]
    out = [np.concatenate(x) for x in ((v[head], rs ^ _spread(rk)), (s[head], rs), (k[head], rk), (th[head], rth), (start[head], rs), (n[head], rn), (inner[head], rs * 0))]
    arrays = [pa.array(x.astype(np.int64), pa.int64()).cast(t) for x, t in zip(out, _TYPES, strict=True)]
    return pa.record_batch([*arrays, pa.array(np.arange(len(out[0])) >= head.sum())], names)


def _spread(k: np.ndarray) -> np.ndarray:
    """A number per id under which its repeats travel, so that they go to all partitions alike."""
    with np.errstate(over="ignore"):
        return _mix(k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``k`` (id, or NULL_ID) and ``th`` (64-bit hash of the text), which name a document, and its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """k, th, z: the texts compressed, as they are sent twice."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress

        def step(batch):
            z = [pack(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            return pa.record_batch([batch.column("k"), batch.column("th"), pa.array(z, pa.binary())], ["k", "th", "z"])

        return step

    return map_slices(rows, make, "k long, th long, z binary", **SLICE)


def _cut(batches):
    """The texts of the parts of each packed document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        parts = batch.column("parts")
        per = np.diff(parts.offsets.to_numpy())
        v, start, n = parts.flatten().flatten()
        k, th = (np.repeat(batch.column(c).to_numpy(), per) for c in ("k", "th"))
        at, ends = start.to_numpy().tolist(), (start.to_numpy() + n.to_numpy() + LENGTH - 1).tolist()

        def out(lo: int, hi: int, held: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([v.slice(lo, hi - lo), pa.array(k[lo:hi]), pa.array(th[lo:hi]), start.slice(lo, hi - lo), pa.array(held, pa.binary())],
                                   ["v", "k", "th", "start", "text"])

        held, done, end = [], 0, 0
        for z, size in zip(batch.column("z"), per.tolist(), strict=True):
            text, first, end = unpack(z.as_py()), end, end + size
            for lo in range(first, end, PARTS):
                hi = min(end, lo + PARTS)
                held += [text[i:j] for i, j in zip(at[lo:hi], ends[lo:hi], strict=True)]
                if len(held) >= PARTS:
                    yield out(done, hi, held)
                    held, done = [], hi
        if held:
            yield out(done, end, held)


def _shard_repeats(batches):
    """Sort one shard's stretches (in order of documents) and give the places of its repeated windows as ranges."""
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:  # scratch of this task alone, gone when it ends
        path, rows, places, before = *(os.path.join(folder, x) for x in ("text", "rows", "row-places")), None
        with open(path, "wb") as f, open(rows, "wb") as g, open(places, "wb") as h:
            at = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    names = np.column_stack([part.column(c).to_numpy() for c in ("k", "th", "start")]).astype(np.int64)
                    new = np.append(before is None or (names[0] != before).any(), (names[1:] != names[:-1]).any(1))  # else a repeated row
                    before, text = names[-1], part.column("text").filter(pa.array(new))
                    size = pc.binary_length(text).to_numpy().astype(np.int64)
                    f.write(b"".join([t + _SEPARATOR for t in text.to_pylist()]))
                    np.column_stack([names[new], size]).tofile(g)
                    ends = at + np.cumsum(size + 1)
                    (ends - size - 1).tofile(h)
                    at = int(ends[-1]) if len(ends) else at
        if not at:
            return
        table, offset, n = np.memmap(rows, np.int64, "r").reshape(-1, 4), np.memmap(places, np.int64, "r"), at

        def flags(name):
            return np.memmap(os.path.join(folder, name), bool, "w+", shape=(n,))

        valid, marked = flags("valid"), flags("marked")
        for lo in range(0, len(table), 1024):
            first, size = np.asarray(offset[lo:lo + 1024]), np.asarray(table[lo:lo + 1024, 3])
            steps = np.zeros(first[-1] + size[-1] + 1 - first[0], np.int8)
            windows = size - LENGTH + 1
            fits = windows > 0
            steps[first[fits] - first[0]] = 1
            steps[(first + windows)[fits] - first[0]] = -1
            valid[first[0]:first[0] + len(steps)] = np.cumsum(steps, dtype=np.int8).astype(bool)
        InducedSorter(path, folder).sort(RepeatMarks(valid, marked))
        for lo, hi in _runs(marked):
            row = np.searchsorted(offset, lo, side="right") - 1
            k, th, start, _ = table[row].T
            yield pa.record_batch([
                pa.array(k), pa.array(th), pa.array((start + lo - offset[row]).astype(np.int32)),
                pa.array((hi - lo - 1 + LENGTH).astype(np.int32))], ["k", "th", "start", "n"])


def _runs(marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the starts and ends of maximal runs of true values."""
    held = None  # a run that reaches the end of its block
    for lo in range(0, len(marked), BLOCK):
        part = np.diff(np.asarray(marked[lo:lo + BLOCK]).astype(np.int8), prepend=0, append=0)
        first, end = lo + np.flatnonzero(part == 1), lo + np.flatnonzero(part == -1)
        if held is not None:
            if len(first) and first[0] == lo:
                first[0] = held
            else:
                first, end = np.append(held, first), np.append(lo, end)
            held = None
        if len(end) and end[-1] == lo + BLOCK:
            held, first, end = first[-1], first[:-1], end[:-1]
        if len(first):
            yield first, end
    if held is not None:
        yield np.array([held]), np.array([len(marked)])


def repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(k, th, start, n): byte ranges of repeats, at least ``LENGTH`` bytes each; ranges may overlap. And the packed texts."""
    rows = keyed(docs)
    packed = _packed(rows)
    found = rows.mapInArrow(_found, STRETCHES).repartition("v")
    same = Window.partitionBy("v", "repeat", "s").orderBy("k", "th", "start")
    anchor = Window.partitionBy("v", "repeat")
    ranked = found.select("*", F.rank().over(same).alias("place"), F.row_number().over(same).alias("row")).select(
        "*", (F.min("s").over(anchor) < F.max("s").over(anchor)).alias("several"))
    again = F.col("repeat") | (F.col("place") > 1)
    open_ = ~again & (F.col("row") == 1) & (F.col("several") | F.col("inner"))
    known = settle(ranked.where(again | open_).select(
        "v", "k", "th", "start", F.when(again & ~F.col("repeat"), F.col("n") + LENGTH - 1).otherwise(F.col("n")).alias("n"), open_.alias("open")), "stretches")
    asked = known.where("open").groupBy("k", "th").agg(F.collect_list(F.struct("v", "start", "n")).alias("parts"), F.sum(F.col("n") + LENGTH).alias("size"))

    total = known.where("open").agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, min(max_shards, -(-total // shard_bytes)))
    texts = asked.join(packed, ["k", "th"]).select("k", "th", "parts", "z").mapInArrow(_cut, "v long, k long, th long, start int, text binary")
    sorted_ = texts.repartition(int(shards), "v").sortWithinPartitions("k", "th", "start")
    inner = settle(sorted_.mapInArrow(_shard_repeats, "k long, th long, start int, n int"), "shard-repeats")
    return known.where("NOT open").select("k", "th", "start", "n").unionByName(inner), packed


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the bytes that any of the ranges covers."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans):
        end = min(size, start + n)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end: maximal removed runs), kept (the remaining bytes).

    One row per input row. Null texts count as empty; documents under 100 bytes never
    lose anything. Only ``doc_id`` and ``text`` are read.
    """
    found, packed = repeats(docs)
    per = found.groupBy("k", "th").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    rows = packed.join(per, ["k", "th"], "left").select("k", "z", "parts")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                text = [unpack(z) for z in part.column("z").to_pylist()]
                runs = [merged(p or [], len(t)) for p, t in zip(part.column("parts").to_pylist(), text, strict=True)]
                kept = [_without(t, r) for t, r in zip(text, runs, strict=True)]
                ids = [None if k == NULL_ID else k for k in part.column("k").to_pylist()]
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in text], pa.int64()),
                    pa.array([len(t) - len(x) for t, x in zip(text, kept, strict=True)], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the runs, which give back bytes of characters that they cover in part."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    fitted = []
    for start, end in runs:
        while inside(start) and start < end:
            start += 1
        while inside(end) and end > start:
            end -= 1
        fitted.append((start, end))
    return _without(text, fitted)


def shorten(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without the repeats; ``n_chars`` follows.

    Characters that a repeat covers only in part stay whole. Null texts stay null; a text that is all
    repeats becomes empty.
    """
    found, _ = repeats(docs)
    per = found.groupBy(F.col("k").alias("__k"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("start", "n")).alias("__parts"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")), "__th": F.xxhash64(text)})
    rows = rows.join(per, ["__k", "__th"], "left").drop("__k", "__th")
    schema, where = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                raw = part.column("text").cast(pa.large_binary()).to_pylist()
                new = [t if t is None or not p else whole_characters(t, merged(p, len(t))) for t, p in zip(raw, part.column("__parts").to_pylist(), strict=True)]
                new = pa.array([None if t is None else t.decode() for t in new], pa.string())
                part = part.drop_columns(["__parts"]).set_column(where, part.schema.field("text"), new.cast(part.schema.field("text").type))
                if "n_chars" in part.schema.names:
                    at = part.schema.get_field_index("n_chars")
                    part = part.set_column(at, part.schema.field(at), pa.compute.utf8_length(new).cast(part.schema.field(at).type))
                yield part

    return rows.mapInArrow(run, schema)
