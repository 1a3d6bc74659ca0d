"""External induced suffix sorting with common-prefix lengths, for one shard of text.

Suffixes are sorted by their first ``DEPTH`` bytes; each comes with the length of the prefix it
shares with the one before, up to ``DEPTH``. All large arrays are files of a scratch folder.

* A suffix is of type S if it is smaller than the next suffix, else L. An S suffix after an L
  suffix is a seed. The seeds are named by the bytes and types up to the next seed, and the
  string of names is sorted the same way again and again on names of names (each round's names span twice
  as many seeds) until a name covers ``DEPTH`` bytes or is alone.
* From the sorted seeds the L suffixes follow in ascending, from those the S suffixes in descending
  order: a suffix taken from the queue puts its left neighbour in. As arrivals at one first
  byte are already in order, the priority queue is one first-in first-out queue per byte, and
  writes to disk what exceeds its memory.
* Two suffixes that follow each other in a queue share one byte more than their right neighbours do;
  those share the least value passed since the one before, so the values are carried along.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

DEPTH = 100
BLOCK = 1 << 18
MEMORY = 1 << 21  # items that a queue or a sort holds before it uses files
_CODES = 7  # of nine bits (byte and type) in a key

_ROW = np.dtype([("old", np.int64), ("key", np.uint64), ("seed", np.int64)])

_Rows = tuple[np.ndarray, np.ndarray, np.ndarray]
Visit = Callable[[np.ndarray, np.ndarray], None]


class BucketQueues:
    """A disk-backed priority queue of (suffix, common prefix) whose arrivals at each key come in order."""

    def __init__(self, folder: str, name: str, memory: int = MEMORY):
        self.base, self.memory, self.held = os.path.join(folder, name), memory, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.on_disk: dict[int, int] = {}

    def push(self, key: int, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(key, []).append((suffix, lcp))
        self.held += len(suffix)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for key, parts in self.parts.items():
            with open(f"{self.base}-{key}.suffix", "ab") as s, open(f"{self.base}-{key}.lcp", "ab") as p:
                for suffix, lcp in parts:
                    s.write(suffix.tobytes())
                    p.write(lcp.tobytes())
                    self.on_disk[key] = self.on_disk.get(key, 0) + len(suffix)
        self.parts, self.held = {}, 0

    def _read(self, key: int, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.fromfile(f"{self.base}-{key}.suffix", np.int64, n, offset=at * 8),
                np.fromfile(f"{self.base}-{key}.lcp", np.uint8, n, offset=at))

    def blocks(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In order of arrival. What arrives at this key meanwhile isn't seen."""
        parts, n = self.parts.get(key, []), self.on_disk.get(key, 0)
        for at in range(0, n, BLOCK):
            yield self._read(key, at, min(BLOCK, n - at))
        yield from _joined(parts)

    def backwards(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for suffix, lcp in reversed(list(_joined(self.parts.get(key, [])))):
            yield suffix[::-1], lcp[::-1]
        n = self.on_disk.get(key, 0)
        for end in range(n, 0, -BLOCK):
            at = max(0, end - BLOCK)
            suffix, lcp = self._read(key, at, end - at)
            yield suffix[::-1], lcp[::-1]

    def drop(self, key: int) -> None:
        self.held -= sum(len(s) for s, _ in self.parts.pop(key, []))
        if self.on_disk.pop(key, 0):
            os.remove(f"{self.base}-{key}.suffix")
            os.remove(f"{self.base}-{key}.lcp")


def _joined(parts):
    """The parts in order, small ones put together to blocks."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BLOCK:
            yield np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held])
            held, n = [], 0
    if held:
        yield np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held])


def _with_equals(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Of blocks of (seed, whether a new name begins with it), the seeds that share their name with a neighbour."""
    held = None  # the last seed, whose right neighbour isn't seen yet, and whether its name is new
    for i, new in blocks:
        if held is not None:
            i, new = np.append(held[0], i), np.append(held[1], new)
        same = ~new[1:]
        shared = np.append(same, False) | ~new
        yield i[:-1][shared[:-1]]
        held = i[-1], new[-1]
    if held is not None and not held[1]:
        yield np.array([held[0]])


def _place(run: np.ndarray, row: np.void) -> int:
    """How many rows of a sorted run are smaller than a row."""
    lo, hi, row = 0, len(run), row.item()
    while lo < hi:
        mid = (lo + hi) // 2
        if run[mid].item() < row:
            lo = mid + 1
        else:
            hi = mid
    return lo


class InducedSorter:
    """Sorts the suffixes of a text file, descending, and hands them to a visitor block by block."""

    def __init__(self, path: str, folder: str, memory: int = MEMORY):
        self.folder, self.memory, self.files = folder, memory, 0
        self.kept: list[str] = []
        self.n = os.path.getsize(path)
        with open(path, "ab") as f:  # words of eight bytes may be read beyond the end
            f.write(bytes(DEPTH + 16))
        self.padded = np.memmap(path, np.uint8, "r")
        self.text = self.padded[:self.n]
        self.words = np.ndarray((self.n + DEPTH + 8,), "<u8", buffer=self.padded, strides=(1,))

    def _array(self, name: str, n: int, dtype) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(os.path.join(self.folder, name), dtype, "w+", shape=(n,))

    def sort(self, visit: Visit) -> None:
        """``visit(suffixes, lcp)``: descending; lcp is shared with the suffix visited before."""
        if not self.n:
            return
        seeds, lcp = self._seeds()
        self._descend(self._ascend(seeds, lcp), visit)

    # seeds

    def _types(self) -> np.ndarray:
        """True for S suffixes, from the end in blocks."""
        out, text = self._array("types", self.n, bool), self.text
        following, above = -1, False  # the byte right of the block and its suffix' type; the end is smallest
        for lo in range((self.n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            part = text[lo:lo + BLOCK].astype(np.int16)
            right = np.append(part[1:], np.int16(following))
            differs = part != right
            at = np.where(differs, np.arange(len(part)), len(part))
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
            small = np.append(part < right, above)
            out[lo:lo + len(part)] = small[at]
            following, above = int(part[0]), bool(out[lo])
        return out

    def _seed_places(self, types: np.ndarray) -> np.ndarray:
        def blocks():
            before = True
            for lo in range(0, self.n, BLOCK):
                part = np.asarray(types[lo:lo + BLOCK])
                yield lo + np.flatnonzero(part & ~np.append(before, part[:-1]))
                before = bool(part[-1])

        places, at = self._array("places", sum(map(len, blocks())), np.int64), 0
        for found in blocks():
            places[at:at + len(found)] = found
            at += len(found)
        return places

    def _seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """The seeds in ascending order, and the prefix each shares with the one before."""
        types = self._types()
        place = self._seed_places(types)
        m = len(place)
        rank = self._array("rank", m, np.int64)

        def length(i: np.ndarray) -> np.ndarray:
            """A name covers the next seed's first byte."""
            return np.where(i + 1 < m, place[np.minimum(i + 1, m - 1)], self.n - 1) + 1 - place[i]

        def coded(i: np.ndarray, step: int) -> np.ndarray:
            key, at, end = np.zeros(len(i), np.uint64), place[i] + step * _CODES, place[i] + length(i)
            for j in range(_CODES):
                p = np.minimum(at + j, self.n - 1)
                code = self.text[p].astype(np.uint64) * np.uint64(2) + types[p] + np.uint64(1)
                key = key << np.uint64(9) | np.where(at + j < end, code, np.uint64(0))
            return key

        def everyone():
            return (np.arange(lo, min(lo + BLOCK, m)) for lo in range(0, m, BLOCK))

        step, longest = 0, max((int(length(i).max()) for i in everyone()), default=0)
        active = everyone
        while step * _CODES < min(longest, DEPTH + _CODES):
            # those that ended before have equal keys in their group and stay as they are
            def going(active=active, step=step):
                return (i[length(i) > step * _CODES] for i in active())

            active = self._refine(rank, going, lambda i, step=step: coded(i, step))
            step += 1
        span = 1
        active = self._shared(rank, everyone)
        while any(map(len, active())) and span < DEPTH // 2 + 1:  # seeds are two bytes apart at least
            def next_name(i, span=span):
                there = i + span < m
                return np.where(there, rank[np.minimum(i + span, m - 1)] + 1, 0).astype(np.uint64)

            active = self._refine(rank, active, next_name)
            span *= 2
        seeds, at = self._array("seeds", m, np.int64), 0
        for _, _, i in self._sorted((rank[i], np.zeros(len(i), np.uint64), i) for i in everyone()):
            seeds[at:at + len(i)] = place[i]
            at += len(i)
        return seeds, self._shared_prefixes(seeds)

    def _sorted(self, rows: Iterator[_Rows]) -> Iterator[_Rows]:
        """Blocks of (rank, key, seed) in ascending order. Beyond memory, sorted runs are files, cut at common
        bounds into ranges that fit and are sorted one after the other."""
        held, n, runs = [], 0, []

        def joined() -> _Rows:
            old, key, i = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(old) and int(key.max()) < 1 << 32 and int(old.max()) < 1 << 31:
                order = np.argsort(old.astype(np.uint64) << np.uint64(32) | key, kind="stable")
            else:
                order = np.lexsort((key, old))
            return old[order], key[order], i[order]

        def spill() -> None:
            self.files += 1
            run = np.memmap(os.path.join(self.folder, f"run-{self.files}"), _ROW, "w+", shape=(n,))
            for name, x in zip(_ROW.names, joined(), strict=True):
                run[name] = x
            runs.append(run)

        for block in rows:
            held.append(block)
            n += len(block[0])
            if n >= self.memory:
                spill()
                held, n = [], 0
        if not runs:
            if n:
                yield joined()
            return
        if n:
            spill()
        held = []
        every = max(1, self.memory // (2 * len(runs)))  # a range has at most so many rows more of each run than it should
        samples = np.concatenate([run[::every] for run in runs])
        samples = np.sort(samples, order=_ROW.names)[max(1, len(runs) // 2)::max(1, len(runs) // 2)]
        cuts = np.array([[_place(run, x) for run in runs] for x in samples] + [[len(r) for r in runs]], np.int64).reshape(-1, len(runs))
        before = np.zeros(len(runs), np.int64)
        for cut in cuts:
            parts = [run[a:b] for run, a, b in zip(runs, before.tolist(), cut.tolist(), strict=True) if a < b]
            before = cut
            if parts:
                held = [tuple(np.array(part[name]) for name in _ROW.names) for part in parts]
                out = joined()
                held = []
                yield out
        for run in runs:
            os.remove(run.filename)

    def _kept(self, blocks: Iterator[np.ndarray]) -> Callable[[], Iterator[np.ndarray]]:
        """Blocks to read again and again, in a file beyond memory; it goes when the next are kept."""
        parts, n, path = [], 0, None
        for block in blocks:
            parts.append(block)
            n += len(block)
            if n > self.memory:
                if path is None:
                    self.files += 1
                    path = os.path.join(self.folder, f"active-{self.files}")
                with open(path, "ab") as f:
                    for part in parts:
                        f.write(part.tobytes())
                parts, n = [], 0
        for old in self.kept:  # what the blocks were made of isn't read again
            os.remove(old)
        self.kept = [path] if path else []

        def again() -> Iterator[np.ndarray]:
            size = os.path.getsize(path) // 8 if path else 0
            for at in range(0, size, BLOCK):
                yield np.fromfile(path, np.int64, min(BLOCK, size - at), offset=at * 8)
            yield from parts

        return again

    def _shared(self, rank: np.ndarray, active) -> Callable[[], Iterator[np.ndarray]]:
        """Those whose rank isn't theirs alone, in order of rank."""

        def blocks():
            last = None
            for r, _, i in self._sorted((rank[i], np.zeros(len(i), np.uint64), i) for i in active()):
                yield i, np.append(last is None or last != r[0], r[1:] != r[:-1])
                last = r[-1]

        return self._kept(_with_equals(blocks()))

    def _refine(self, rank: np.ndarray, active, key_of) -> Callable[[], Iterator[np.ndarray]]:
        """Split the groups of equal rank by a key; a rank is the number of smaller ones. Returns who shares one still."""

        def blocks():
            at, last, name, group = 0, None, 0, 0  # name, group: the places where the last row's begin
            for old, key, i in self._sorted((rank[i], key_of(i), i) for i in active() if len(i)):
                n = at + np.arange(len(i))
                new_group = np.append(last is None or last[0] != old[0], old[1:] != old[:-1])
                new_name = new_group | np.append(last is None or last[1] != key[0], key[1:] != key[:-1])
                names = np.maximum.accumulate(np.where(new_name, n, name))
                groups = np.maximum.accumulate(np.where(new_group, n, group))
                rank[i] = old + names - groups
                at, last, name, group = at + len(i), (old[-1], key[-1]), int(names[-1]), int(groups[-1])
                yield i, new_name

        return self._kept(_with_equals(blocks()))

    def _shared_prefixes(self, seeds: np.ndarray) -> np.ndarray:
        lcp = self._array("seed-lcp", len(seeds), np.uint8)
        for lo in range(1, len(seeds), BLOCK):
            a, b = seeds[lo - 1:lo + BLOCK - 1], seeds[lo:lo + BLOCK]
            a, got, open_ = a[:len(b)], np.zeros(len(b), np.int64), np.arange(len(b))
            for word in range(0, DEPTH, 8):
                differ = self.words[a[open_] + word] ^ self.words[b[open_] + word]
                apart = differ != 0
                low = differ[apart] & (~differ[apart] + np.uint64(1))
                got[open_[apart]] = word + (np.bitwise_count(low - np.uint64(1)) >> 3)
                open_ = open_[~apart]
                if not len(open_):
                    break
            got[open_] = DEPTH
            lcp[lo:lo + len(b)] = np.minimum(got, DEPTH)
        return lcp

    # induction

    def _run(self, at: int) -> int:
        """Length of the run of one byte at a place, up to DEPTH."""
        part = self.text[at:at + DEPTH]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _induce(self, suffix, lcp, carry, wanted, push) -> None:
        """Put the wanted left neighbours of a block into their queues; ``carry``: least value since each queue's last arrival."""
        left = suffix - 1
        byte = self.text[np.maximum(left, 0)]
        take = np.flatnonzero((left >= 0) & wanted(byte))
        kind = byte[take]
        order = np.argsort(kind, kind="stable")
        take, kind = take[order], kind[order]
        cuts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
        rest = np.minimum(carry, lcp.min())
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(take)).tolist(), strict=False):
            at, d = take[a:b], int(kind[a])
            least = np.minimum.reduceat(lcp[:at[-1] + 1], np.append(0, at[:-1] + 1))
            least[0] = min(least[0], carry[d])
            push(d, left[at], (np.minimum(least, DEPTH - 1) + 1).astype(np.uint8))
            after = lcp[at[-1] + 1:]
            rest[d] = after.min() if len(after) else 255
        carry[:] = rest

    def _bucket(self, c: int, queue: BucketQueues, waves: BucketQueues, see, carry, wanted) -> int | None:
        """All that arrives at byte ``c``, the arrivals from the bucket itself in waves; returns the last suffix."""
        last, wave = None, 0
        while True:
            more = False
            for suffix, lcp in queue.blocks(c) if wave == 0 else waves.blocks(wave % 2):
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                see(suffix, lcp)
                last = int(suffix[-1])

                def push(d, s, p):
                    nonlocal more
                    if d == c:
                        more = True
                        waves.push((wave + 1) % 2, s, p)
                    else:
                        queue.push(d, s, p)

                self._induce(suffix, lcp, carry, wanted, push)
            queue.drop(c) if wave == 0 else waves.drop(wave % 2)
            if not more:
                return last
            wave += 1

    def _ascend(self, seeds: np.ndarray, seed_lcp: np.ndarray) -> BucketQueues:
        """All L suffixes, ascending, per first byte."""
        queue, done, waves = (BucketQueues(self.folder, x, self.memory) for x in ("l", "l-done", "l-wave"))
        carry = np.full(256, 255, np.uint8)
        queue.push(int(self.text[-1]), np.array([self.n - 1]), np.zeros(1, np.uint8))
        starts = np.zeros(257, np.int64)
        for lo in range(0, len(seeds), BLOCK):
            starts[1:] += np.bincount(self.text[seeds[lo:lo + BLOCK]], minlength=256)
        starts = np.cumsum(starts)
        for c in range(256):
            last = self._bucket(c, queue, waves, lambda s, p, c=c: done.push(c, s, p), carry, lambda byte, c=c: byte >= c)
            for lo in range(starts[c], starts[c + 1], BLOCK):
                hi = min(lo + BLOCK, starts[c + 1])
                suffix, lcp = np.asarray(seeds[lo:hi]), np.array(seed_lcp[lo:hi])
                if lo == starts[c]:
                    lcp[0] = 0 if last is None else min(self._run(last), self._run(int(suffix[0])))
                self._induce(suffix, lcp, carry, lambda byte, c=c: byte > c, queue.push)
        return done

    def _descend(self, l_suffixes: BucketQueues, visit: Visit) -> None:
        """All suffixes, descending: the S suffixes of each first byte, then its L suffixes."""
        queue, waves = (BucketQueues(self.folder, x, self.memory) for x in ("s", "s-wave"))
        carry = np.full(256, 255, np.uint8)
        for c in range(255, -1, -1):
            last = self._bucket(c, queue, waves, visit, carry, lambda byte, c=c: byte <= c)
            shared = None  # of the next block's first suffix with the one before
            for suffix, own in l_suffixes.backwards(c):
                if shared is None:
                    shared = 0 if last is None else min(self._run(last), self._run(int(suffix[0])))
                lcp = np.append(np.uint8(shared), own[:-1])
                shared = int(own[-1])
                visit(suffix, lcp)
                self._induce(suffix, lcp, carry, lambda byte, c=c: byte < c, queue.push)
            l_suffixes.drop(c)


class RepeatMarks:
    """Visitor: marks all but the first of the valid suffixes that share ``DEPTH`` bytes."""

    def __init__(self, valid: np.ndarray, marked: np.ndarray):
        self.valid, self.marked, self.first = valid, marked, -1  # first: of the group that is still open

    def __call__(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        group = np.cumsum(lcp < DEPTH)
        if group[0]:
            self.first = -1
        here = self.valid[suffix]
        suffix, group = suffix[here], group[here]
        if not len(suffix):
            self.first = -1 if lcp.min() < DEPTH else self.first
            return
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(suffix, cuts)
        open_before = self.first >= 0 and group[0] == 0
        if open_before:
            self.marked[max(self.first, least[0])] = True
            least[0] = min(least[0], self.first)
        self.marked[suffix[suffix != np.repeat(least, np.diff(np.append(cuts, len(suffix))))]] = True
        self.first = int(least[-1]) if group[-1] == int((lcp < DEPTH).sum()) else -1
