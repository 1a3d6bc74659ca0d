"""Hierarchical packing: sequences of several lengths, each filled to the brim.

1. Documents are routed to tiers of window sizes (powers of two): what is longer than the largest window is cut into full
   ones, and the rest goes to the smallest tier that holds it.
2. The tiers are packed from the longest to the shortest. A window's gap takes the longest document of the shorter tiers that
   fits, again and again; where none fits, one of them is cut to fill the gap and its rest goes back to its tier.
3. Where the shorter tiers are empty, a document is cut at half its window: a full window of the next tier.
4. What is left of all partitions (less than the smallest window of each) meets in fewer partitions, until one
   is left. Its rest becomes windows of smaller powers of two. So no sequence is padded.
5. The sequences of each tier are dealt to training steps in turn, so that steps hold equally many of every tier.

The ids of a document never leave the task that made them, but for the rests of step 4.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .byte_words import byte_tokenizer_path, byte_word_encoder
from .common import slices, texts

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 64 * 2048
RESTS_PER_PARTITION = 20_000
_PLACED = (pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                      ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("part", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]))
PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, "
          "part long, nth long, ids binary")


class Tiers:
    """Packs documents of one partition that arrive bit by bit; what fills no window waits for more.

    Waiting documents are stacks by length; a bit set names the lengths in use, so the longest one
    below a limit is one bit operation away.
    """

    def __init__(self, tiers=TIERS, first_id: int = 0, part: int = 0):
        self.tiers, self.part, self.next_id = tuple(sorted(tiers, reverse=True)), part, first_id
        self.waiting: dict[int, list[tuple]] = {}
        self.used, self.made = 0, dict.fromkeys(self.tiers, 0)
        self._out()

    def _out(self) -> None:
        self.placed: list[tuple] = []

    def _wait(self, length: int, doc: tuple) -> None:
        """``doc``: (doc_id, start, doc_tokens, bytes of the ids, place in them)."""
        if length:
            self.waiting.setdefault(length, []).append(doc)
            self.used |= 1 << length

    def _longest(self, most: int) -> int:
        """The greatest length waiting that is at most ``most``, else 0."""
        return max(0, (self.used & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def _take(self, length: int) -> tuple:
        stack = self.waiting[length]
        doc = stack.pop()
        if not stack:
            self.used ^= 1 << length
        return doc

    @staticmethod
    def _after(doc: tuple, n: int) -> tuple:
        """What is left of a document when its first ``n`` ids are gone."""
        return (doc[0], doc[1] + n, doc[2], doc[3], doc[4] + 4 * n)

    def _window(self, size: int, items: list[tuple[int, tuple]]) -> None:
        offset, nth = 0, self.made.get(size, 0)
        for n, (doc_id, start, total, ids, at) in items:
            self.placed.append((doc_id, start, n, zlib.crc32(ids[at:at + 4 * n]), total, self.next_id, offset, size, self.part, nth))
            offset += n
        self.next_id, self.made[size] = self.next_id + 1, nth + 1

    def add(self, doc_id: int | None, ids: memoryview, start: int = 0, total: int | None = None) -> None:
        """A document's ids (little-endian, 32 bits); full windows of a longer one are cut off at once."""
        n, top = len(ids) // 4, self.tiers[0]
        doc = (doc_id, start, n if total is None else total, ids, 0)
        for _ in range(n // top):
            self._window(top, [(top, doc)])
            doc = self._after(doc, top)
        self._wait(n % top, doc)

    def pack(self) -> None:
        """Make every window that can be filled; less than the smallest window stays."""
        for size, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while (n := self._longest(size)) > shorter:
                items, gap = [(n, self._take(n))], size - n
                while gap:
                    if fits := self._longest(min(gap, shorter or size)):
                        items.append((fits, self._take(fits)))
                        gap -= fits
                    elif longer := self._longest(shorter or size):
                        doc = self._take(longer)
                        items.append((gap, doc))
                        self._wait(longer - gap, self._after(doc, gap))
                        gap = 0
                    else:
                        break
                if not gap:
                    self._window(size, items)
                    continue
                if not shorter:  # too little is left for one more window
                    for n, doc in items:
                        self._wait(n, doc)
                    break
                n, doc = items[0]
                self._window(shorter, [(shorter, doc)])
                self._wait(n - shorter, self._after(doc, shorter))
                for n, doc in items[1:]:
                    self._wait(n, doc)

    def rests(self) -> list[tuple[int, tuple]]:
        return [(n, doc) for n in sorted(self.waiting, reverse=True) for doc in self.waiting[n]]

    def finish(self) -> None:
        """The rest as windows of the powers of two that add up to it."""
        rests = self.rests()
        left = sum(n for n, _ in rests)
        self.waiting, self.used = {}, 0
        for size in (1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1):
            items, gap = [], size
            while gap:
                n, doc = rests.pop(0)
                m = min(n, gap)
                items.append((m, doc))
                gap -= m
                if n > m:
                    rests.insert(0, (n - m, self._after(doc, m)))
            self._window(size, items)

    def batch(self, last: bool = False) -> pa.RecordBatch:
        """What was placed since the last call; with ``last`` the rest too, as rows with their ids and no sequence."""
        rows = [(*p, None) for p in self.placed]
        if last:
            rows += [(d[0], d[1], n, None, d[2], None, None, None, self.part, None, bytes(d[3][d[4]:d[4] + 4 * n])) for n, d in self.rests()]
        self._out()
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PLACED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACED, strict=True)], schema=_PLACED)

    def keep(self) -> None:
        """Hold the ids of what waits in memory of their own, so that the texts before can go."""
        for n, stack in self.waiting.items():
            self.waiting[n] = [(d[0], d[1], d[2], memoryview(bytes(d[3][d[4]:d[4] + 4 * n])), 0) for d in stack]


def _from_texts(docs: DataFrame, path: str, end_id: int, tiers) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer = byte_word_encoder(path), Tiers(tiers, part << 32, part)
        for batch in slices(batches, size=4 << 20):
            ids, bounds = encoder.encode(batch.column("text"))
            ids = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes())
            at = ((bounds + np.arange(len(bounds))) * 4).tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:], strict=False):
                packer.add(doc_id, ids[a:b])
            packer.pack()
            packer.keep()
            yield packer.batch()
        yield packer.batch(last=True)

    return texts(docs).mapInArrow(run, PLACED)


def _from_rests(rests: DataFrame, round_: int, parts: int, tiers) -> DataFrame:
    """One more round over the rests; the last one, of a single partition, leaves nothing."""

    def run(batches):
        from pyspark import TaskContext

        part = round_ << 24 | TaskContext.get().partitionId()
        packer, seen = Tiers(tiers, part << 32, part), False
        for batch in batches:
            for r in batch.to_pylist():
                packer.add(r["doc_id"], memoryview(r["ids"]), r["start"], r["doc_tokens"])
                seen = True
        packer.pack()
        if parts == 1 and seen:
            packer.finish()
        yield packer.batch(last=True)

    # sorted, so that a task that runs again places them alike
    few = rests.select("doc_id", "start", "doc_tokens", "ids").repartition(parts)
    return few.sortWithinPartitions("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, PLACED)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, tiers=TIERS, per_partition: int = RESTS_PER_PARTITION) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, part, nth: the pieces of all documents, packed.

    Each id of each document (its text's ids and then ``end_id``) is in one piece; ``offset`` is the piece's place in its sequence, ``tier``
    the sequence's length, all of it filled. A null or empty text is the end id alone; repeated rows are documents of their own, null
    ids stay null. No documents give an empty result. ``tiers`` are powers of two.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    placed = settle(_from_texts(docs, path or byte_tokenizer_path(), end_id, tiers), "tiers")
    done, n, round_ = placed.where("sequence_id IS NOT NULL"), placed.where("sequence_id IS NULL").count(), 1
    parts = 2 * n
    while n:
        parts = max(1, min(-(-n // per_partition), parts // 2))
        placed = settle(_from_rests(placed.where("sequence_id IS NULL"), round_, parts, tiers), "tier-rests")
        done = done.unionByName(placed.where("sequence_id IS NOT NULL"))
        n, round_ = 0 if parts == 1 else placed.where("sequence_id IS NULL").count(), round_ + 1
    return done.drop("ids")


def deal_steps(placed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Adds ``step`` from 0: steps of about ``step_tokens`` tokens.

    Sequences are numbered tier by tier and dealt in turn, so two steps differ by at most one sequence of each tier and
    one in all. The numbers come from one row per partition and tier, summed in two steps.
    """
    starts = placed.where("offset = 0").groupBy("tier", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = settle(starts, "tier-counts")
    total = starts.agg(F.sum(F.col("n") * F.col("tier"))).first()[0] or 0
    steps = max(1, -(-total // step_tokens))
    # as in operators.ordered: blocks of partitions carry one row each
    block = F.floor(F.col("part") / 1024)
    inside = Window.partitionBy("tier", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(F.desc("tier"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("block", block)
    blocks = starts.groupBy("tier", "block").agg(F.sum("n").alias("n")).select(
        "tier", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = starts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["tier", "block"]).select(
        "tier", "part", (F.col("base") + F.col("inside")).alias("first"))
    return placed.join(numbered, ["tier", "part"]).withColumn("step", F.pmod(F.col("first") + F.col("nth"), F.lit(steps))).drop("first")
