"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a row x is ``w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The last sum is
computed in linear time as half of ``|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, keep_rows, learnable, map_slices

BUCKETS = 4096
TRAIN_ROWS = 6000
STATS = ("log_chars", "log_words", "mean_word", "distinct_words", "upper", "letters", "digits", "symbols", "spaces",
         "non_ascii", "log_lines", "symbol_words", "stored_chars")

# classes of bytes: lower, upper, digit, space, line feed, sentence marks, other ASCII, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[ord(c) for c in ".,;:'\"?"]], _CLASS[128:] = 3, 4, 5, 7
N_CLASSES = 8


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the bounds of each text in them."""
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


class Features:
    """Rows of features in compressed form: bounds per row, word bucket and value, and dense statistics."""

    def __init__(self, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray):
        self.bounds, self.bucket, self.value, self.stats = bounds, bucket, value, stats

    @classmethod
    def of(cls, texts: pa.Array, stored_chars: pa.Array) -> Features:
        n = len(texts)
        data, bounds = _bytes_of(texts)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        kinds = np.bincount(row * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        parts = pc.split_pattern(plain, " ")
        flat = parts.flatten()
        words = flat.dictionary_encode()
        code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        counts = np.diff(parts.offsets.to_numpy())
        word_row = np.repeat(np.arange(n), counts)
        real = np.array([bool(w) for w in names], bool)[code] if names else np.zeros(0, bool)
        code, word_row = code[real], word_row[real]
        n_words = np.bincount(word_row, minlength=n)
        pairs, times = np.unique(word_row * max(1, len(names)) + code, return_counts=True)
        pair_row, pair_code = pairs // max(1, len(names)), pairs % max(1, len(names))
        # a word that ends in a symbol other than sentence marks
        ends = np.array([bool(w) and not (w[-1].isalnum() or w[-1] in ".,;:'\"?") for w in names], float)
        odd = np.bincount(word_row, weights=ends[code], minlength=n) if len(code) else np.zeros(n)
        hashed = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in names), np.int64, len(names))
        cells, at = np.unique(pair_row * BUCKETS + hashed[pair_code], return_inverse=True) if len(pairs) else (pairs, pairs)
        tf = np.sqrt(np.bincount(at, weights=times, minlength=len(cells))) if len(cells) else np.zeros(0)
        cell_row = cells // BUCKETS
        norm = np.sqrt(np.bincount(cell_row, weights=tf * tf, minlength=n))
        chars = np.maximum(1, kinds.sum(1))
        stats = np.column_stack([
            np.log1p(chars), np.log1p(n_words), np.log1p(chars / np.maximum(1, n_words)),
            np.bincount(pair_row, minlength=n) / np.maximum(1, n_words),
            kinds[:, 1] / np.maximum(1, kinds[:, 0] + kinds[:, 1]), (kinds[:, 0] + kinds[:, 1]) / chars, kinds[:, 2] / chars,
            kinds[:, 6] / chars, kinds[:, 3] / chars, kinds[:, 7] / chars, np.log1p(kinds[:, 4]), odd / np.maximum(1, n_words),
            np.log1p(np.maximum(0, pc.fill_null(stored_chars, 0).to_numpy(zero_copy_only=False).astype(float))),
        ])
        return cls(np.searchsorted(cell_row, np.arange(n + 1)), cells % BUCKETS, (tf / norm[cell_row]).astype(np.float32), stats)

    def take(self, rows: np.ndarray) -> Features:
        counts = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], counts) + np.arange(bounds[-1])
        return Features(bounds, self.bucket[at], self.value[at], self.stats[rows])


class FactorisationMachine:
    """Binary FM on ``Features``; statistics are standardised and clipped, and interact with the words too."""

    RANK, CLIP, EPOCHS, BATCH, RATE, DECAY = 8, 4.0, 12, 64, 0.02, 1e-5

    def __init__(self, seed: int = 7):
        rng, n = np.random.default_rng(seed), BUCKETS + len(STATS)
        self.bias, self.weight = 0.0, np.zeros(n)
        self.factors = rng.normal(0, 0.02, (n, self.RANK))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def _dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -self.CLIP, self.CLIP) / 2

    def _forward(self, x: Features):
        n, row = len(x.stats), np.repeat(np.arange(len(x.stats)), np.diff(x.bounds))
        dense, w, v = self._dense(x.stats), self.weight, self.factors
        lin = np.bincount(row, weights=w[x.bucket] * x.value, minlength=n) + dense @ w[BUCKETS:]
        vx = v[x.bucket] * x.value[:, None]
        both = np.empty((n, self.RANK))
        squares = np.bincount(row, weights=(vx * vx).sum(1), minlength=n)
        for f in range(self.RANK):
            both[:, f] = np.bincount(row, weights=vx[:, f], minlength=n)
        both += dense @ v[BUCKETS:]
        squares += (dense * dense) @ (v[BUCKETS:] ** 2).sum(1)
        z = self.bias + lin + 0.5 * ((both * both).sum(1) - squares)
        return z, row, dense, both

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x)[0], -30, 30)))

    def fit(self, x: Features, labels: np.ndarray, seed: int = 11) -> FactorisationMachine:
        """Adam on the logistic loss. Without rows the score is 0.5; with one class it is near that class."""
        if not len(labels):
            self.factors[:] = 0
            return self
        self.mean, self.scale = x.stats.mean(0), np.maximum(x.stats.std(0), 1e-3)
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        rng, step = np.random.default_rng(seed), 0
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), self.weight, self.factors)]
        for epoch in range(self.EPOCHS):
            rate = self.RATE * (1 - epoch / self.EPOCHS)
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), self.BATCH):
                b = x.take(order[lo:lo + self.BATCH])
                z, row, dense, both = self._forward(b)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[order[lo:lo + self.BATCH]]) / len(z)
                gw, gv = self.DECAY * self.weight, self.DECAY * self.factors
                e = error[row] * b.value
                np.add.at(gw, b.bucket, e)
                np.add.at(gv, b.bucket, e[:, None] * (both[row] - self.factors[b.bucket] * b.value[:, None]))
                gw[BUCKETS:] += dense.T @ error
                gv[BUCKETS:] += dense.T @ (both * error[:, None]) - self.factors[BUCKETS:] * ((dense ** 2).T @ error)[:, None]
                step += 1
                bias = np.array([self.bias])
                for p, g, (m, s) in zip((bias, self.weight, self.factors), (np.array([error.sum()]), gw, gv), state, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
                self.bias = float(bias[0])
        return self


def _inputs(docs: DataFrame) -> DataFrame:
    """Text and the stored length; the length of the text stands in for a missing or null ``n_chars``."""
    text = F.coalesce("text", F.lit(""))
    stored = F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")) if "n_chars" in docs.columns else F.length(text).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), stored.alias("stored_chars"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, only_learnable: bool = True) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled documents (a documented bound: the labels of smallest id hash).

    Only features, at most ``BUCKETS`` numbers per row, reach the driver. Of several
    labels of a document the larger counts; of several texts the smallest. Null labels and ids are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(learnable()) if only_learnable else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct("text", "stored_chars")).alias("x")).select("label", "x.text", "x.stored_chars")

    def make():
        def step(batch):
            x = Features.of(batch.column("text"), batch.column("stored_chars"))
            cut = lambda a, kind: pa.ListArray.from_arrays(pa.array(x.bounds, pa.int32()), pa.array(a, kind))
            return pa.record_batch([batch.column("label"), cut(x.bucket, pa.int32()), cut(x.value, pa.float32()),
                                    pa.array(list(x.stats), pa.list_(pa.float64()))], ["label", "bucket", "value", "stats"])

        return step

    got = map_slices(rows, make, "label int, bucket array<int>, value array<float>, stats array<double>").toArrow()
    # in an order that doesn't depend on tasks, so the same rows always give the same model
    got = got.take(np.array(sorted(range(got.num_rows), key=lambda i: zlib.crc32(str(got["stats"][i].as_py()).encode())), np.int64))
    counts = pc.list_value_length(got["bucket"]).to_numpy()
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0)
    x = Features(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat("bucket").astype(np.int64), flat("value"),
                 flat("stats").reshape(-1, len(STATS)))
    return FactorisationMachine().fit(x, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score of every row (repeated rows stay; null and empty texts get the score of an empty text)."""

    def make():
        def step(batch):
            x = Features.of(batch.column("text"), batch.column("stored_chars"))
            return pa.record_batch([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

        return step

    return map_slices(_inputs(docs), make, "doc_id long, score double", rows=1024, size=1 << 20)



def keep(docs: DataFrame, model: FactorisationMachine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""

    def make():
        def step(batch):
            text = filled(batch)
            stored = batch.column("n_chars").cast(pa.int64()) if "n_chars" in batch.schema.names else pa.nulls(len(text), pa.int64())
            stored = pc.coalesce(stored, pc.utf8_length(text).cast(pa.int64()))
            return pa.array(model.score(Features.of(text, stored)) >= least)

        return step

    return keep_rows(docs, make, size=1 << 20)
