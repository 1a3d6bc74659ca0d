"""Token ids as binary shards, each with a minimal perfect hash index over its document keys.

A shard is two files below one folder, named by the attempt that wrote them:

* ``*.ids``: the ids of its documents one after the other, little endian, 16 bits each
  where all ids of the tokenizer fit, else 32 bits;
* ``*.idx``: an npz with ``meta`` (JSON: id type, number of rows with a null key),
  ``bounds`` (place of every row in the payload), ``keys`` (distinct keys ascending), the hash levels
  (``bits``, ``level_bits``) and, per slot, ``fingerprint``, ``first`` (row) and ``rows``.

The manifest is a table with one row per shard in document order. It only names files of
attempts that ended, so a repeated or lost attempt leaves nothing that is read.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_work_dir, settle
from .common import slices, texts
from .tokens import tokenizer_path, word_encoder

ROWS_PER_SHARD = 16_384


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys (the splitmix64 finisher), one function per seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys as levels of bit arrays.

    On each level the keys that meet no other key set their bit; the rest go on to the
    next level. A key's slot is the rank of its bit over all levels, so n keys have the
    slots 0..n-1. A key that was never added gets some slot or -1: compare fingerprints.
    """

    GAMMA, LEVELS, FINGERPRINT_SEED = 2, 64, 1000

    def __init__(self, bits: np.ndarray, level_bits: np.ndarray):
        self.bits, self.level_bits = bits, level_bits
        counts = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.cumsum(counts) - counts
        self.base = np.cumsum(level_bits) - level_bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, words, sizes = keys.astype(np.uint64), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = -(-cls.GAMMA * len(left) // 64) * 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys are not distinct")
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.uint64)
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, base) in enumerate(zip(self.level_bits, self.base, strict=True)):
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = self.rank[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return slot

    @classmethod
    def fingerprints(cls, keys: np.ndarray) -> np.ndarray:
        return (mix(np.asarray(keys), cls.FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def _index_bytes(keys: np.ndarray, nulls: int, bounds: np.ndarray, kind: str) -> bytes:
    """The index of rows in key order, those with a null key first."""
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    mph, n = PerfectHash.build(distinct), len(distinct)
    slot = mph.slots(distinct)
    fingerprint, at, many = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    fingerprint[slot], at[slot], many[slot] = PerfectHash.fingerprints(distinct), first + nulls, rows
    out = io.BytesIO()
    np.savez(out, meta=np.frombuffer(json.dumps({"ids": kind, "nulls": nulls}).encode(), np.uint8), bounds=bounds,
             keys=distinct, bits=mph.bits, level_bits=mph.level_bits, fingerprint=fingerprint, first=at, rows=many)
    return out.getvalue()


class Shard:
    """Keyed access to one written shard."""

    def __init__(self, base: str):
        fs, path = pa.fs.FileSystem.from_uri(base)
        with fs.open_input_stream(path + ".idx") as f:
            index = np.load(io.BytesIO(f.read()))
        self.payload = fs.open_input_file(path + ".ids")
        meta = json.loads(index["meta"].tobytes())
        self.dtype, self.nulls = np.dtype(meta["ids"]), meta["nulls"]
        self.bounds, self.keys = index["bounds"], index["keys"]
        self.hash = PerfectHash(index["bits"], index["level_bits"])
        self.fingerprint, self.first, self.rows = index["fingerprint"], index["first"], index["rows"]

    def find(self, keys) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key, -1 and 0 for a key whose fingerprint isn't here."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == PerfectHash.fingerprints(keys[known])
        at = np.where(known, slot, 0)
        if not len(self.first):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        return np.where(known, self.first[at], -1), np.where(known, self.rows[at], 0)

    def ids(self, row: int) -> np.ndarray:
        start, end = (int(x) * self.dtype.itemsize for x in self.bounds[row:row + 2])
        return np.frombuffer(self.payload.read_at(end - start, start), self.dtype).astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key; empty for an unknown key."""
        first, rows = (int(x[0]) for x in self.find([key]))
        return [self.ids(first + i) for i in range(rows)]

    def close(self) -> None:
        self.payload.close()


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)


MANIFEST = "shard int, base string, n_rows long, n_tokens long"


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 1, folder: str | None = None,
                 rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Encode every whole text and write its ids with ``end_id`` after them; returns the manifest.

    Rows are in ascending ``doc_id`` order (null first), repeated ids in the order of
    their texts' bytes; the ranges are chosen by Spark, so shards are about even.
    A null or empty text is the end id alone. ``folder`` is below the shared folder
    unless given. An empty table gives an empty manifest.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    folder = _uri(folder or new_work_dir(spark, "token-shards"))
    # ids alone are counted: the column the scan reads is eight bytes wide
    n = max(spark.sparkContext.defaultParallelism, -(-docs.select("doc_id").count() // rows_per_shard))

    def run(batches):
        from pyspark import TaskContext

        encoder, shard = word_encoder(path), TaskContext.get().partitionId()
        kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        base, keys, lengths, nulls = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}", [], [], 0
        fs, at = pa.fs.FileSystem.from_uri(base)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        out = None
        for part in slices(batches, size=4 << 20):
            ids, bounds = encoder.encode(part.column("text"))
            out = out or fs.open_output_stream(at + ".ids")
            out.write(np.insert(ids, bounds[1:], end_id).astype(kind).tobytes())
            ids_here = part.column("doc_id")
            nulls += ids_here.null_count
            keys.append(ids_here.drop_null().to_numpy())
            lengths.append(np.diff(bounds) + 1)
        if out is None:
            return
        out.close()
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        with fs.open_output_stream(at + ".idx") as f:
            f.write(_index_bytes(np.concatenate(keys), nulls, bounds, kind))
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([base]), pa.array([len(bounds) - 1]),
                               pa.array([int(bounds[-1])])], ["shard", "base", "n_rows", "n_tokens"])

    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    return settle(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all shards before. One row per shard, so a single window is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files by key.

    Each key of a shard is looked up in its hash index, its fingerprint compared and its
    ids read from the payload; rows without a key stand before the others.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["base"])
                first, rows = shard.find(shard.keys)
                if (first < 0).any():
                    raise ValueError(f"{row['base']}: a key is missing from its own index")
                keyed = np.repeat(first - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
                at = np.concatenate([np.arange(shard.nulls), keyed]).astype(np.int64)
                keys = pa.concat_arrays([pa.nulls(shard.nulls, pa.int64()), pa.array(np.repeat(shard.keys, rows), pa.int64())])
                for lo in range(0, len(at), 4096):
                    here = at[lo:lo + 4096]
                    crc = [zlib.crc32(shard.ids(i).tobytes()) for i in here.tolist()]
                    yield pa.record_batch([
                        keys.slice(lo, 4096), pa.array(row["start"] + shard.bounds[here], pa.int64()),
                        pa.array(shard.bounds[here + 1] - shard.bounds[here], pa.int64()), pa.array(crc, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    placed = shard_starts(manifest).select("base", "start")
    return placed.repartition(max(1, manifest.count()), "base").mapInArrow(run, schema)

