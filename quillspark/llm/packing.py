"""Best-fit packing of token documents into fixed-length sequences, certified by lower bounds.

1. Every document becomes pieces of at most ``capacity`` tokens (only longer ones are cut).
2. Pieces are dealt evenly into partitions; each is packed by best-fit decreasing and its
   number of sequences compared with a lower bound from dual feasible functions. Equal
   numbers certify that the partition cannot be packed better.
3. Sequences with free space of partitions that have no certificate are opened; their
   pieces meet in fewer partitions, where they exchange places by another run of step 2.
   This goes on until all are certified, one partition is left, or a round gains nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import slices, texts
from .tokens import tokenizer_path, word_encoder

CAPACITY = 2048
PIECES_PER_PARTITION = 50_000
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset int, certified boolean"


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces (ids and then ``end_id``).

    A null or empty text is the end id alone; repeated rows are packed as often as they occur.
    """
    path = path or tokenizer_path()

    def run(batches):
        encoder = word_encoder(path)
        for part in slices(batches, size=4 << 20):
            ids, bounds = encoder.encode(part.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            n_pieces = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(part.num_rows), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(capacity, (bounds[1:] - bounds[:-1])[row] - start)
            at, data = (bounds[row] + start) * 4, ids.tobytes()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length (given in descending order), and the free space of each sequence.

    Open sequences are kept by free space; a bit set names the spaces in use, so the
    tightest one that fits is one bit operation away.
    """
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, where, offset, free = 0, [], [], []
    for n in lengths.tolist():
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            sequence = open_[space].pop()
            if not open_[space]:
                spaces ^= 1 << space
        else:
            space, sequence = capacity, len(free)
            free.append(capacity)
        where.append(sequence)
        offset.append(capacity - space)
        left = space - n
        free[sequence] = left
        if left:
            if not open_[left]:
                spaces |= 1 << left
            open_[left].append(sequence)
    return np.array(where, np.int64), np.array(offset, np.int64), np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of sequences below which the lengths cannot be packed, by dual feasible functions.

    Of each function only its value on the histogram of lengths is needed: rounding
    by a threshold (long ones count as whole, short ones below it as nothing), and rounding
    down to multiples of 1/k.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # u_t: sizes over capacity - t count as capacity, sizes below t as 0
    total, many = np.cumsum(count * size), np.cumsum(count)
    for t in range(1, capacity // 2 + 1):
        whole = many[-1] - many[capacity - t]
        middle = total[capacity - t] - total[t - 1]
        best = max(best, int(whole) + -(-int(middle) // capacity))
    # f_k: x -> x if (k + 1) x / capacity is whole, else its floor / k
    for k in range(1, 65):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(round_: int, capacity: int):
    """Packs one whole partition; sequence ids hold the round, the partition and a number in it."""

    def run(frames):
        from pyspark import TaskContext

        parts = list(frames)
        part = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        if part.empty:
            return
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = part["length"].to_numpy()
        where, offset, free = best_fit_decreasing(lengths, capacity)
        certified = len(free) == lower_bound(lengths, capacity)
        base = round_ << 56 | TaskContext.get().partitionId() << 32
        part["sequence_id"], part["offset"] = base + where, offset.astype(np.int32)
        part["certified"] = certified | (free[where] == 0)
        part["doc_id"] = part["doc_id"].astype("Int64")
        yield part[[c.split()[0] for c in PLACED.split(", ")]]

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION,
         rounds: int = ROUNDS) -> DataFrame:
    """Place pieces (PIECES columns) in sequences: adds sequence_id, offset and certified.

    ``certified`` tells that the sequence is full or belongs to a partition that meets
    its lower bound. A partition holds ``per_partition`` pieces or fewer, dealt evenly whatever their keys, so
    no document, source or repeated row makes one larger. No pieces give an empty result.
    """
    items = settle(items, "pieces")
    done, n, last = None, items.count(), None
    for round_ in range(rounds):
        if n == 0 and done is not None:
            break
        parts = max(1, -(-n // per_partition))
        placed = settle(items.repartition(parts).mapInPandas(_packer(round_, capacity), PLACED), "packed")
        kept = placed.where("certified")
        n, open_ = (placed.where("NOT certified").agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first())
        final = parts == 1 or round_ == rounds - 1 or (last is not None and open_ >= last)
        done = placed if done is None and final else kept if done is None else done.unionByName(placed if final else kept)
        if final:
            break
        items, last = placed.where("NOT certified").select(*[c.split()[0] for c in PIECES.split(", ")]), open_
    return done
