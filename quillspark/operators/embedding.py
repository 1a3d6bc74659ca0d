"""Turn texts into vectors: a built-in feature-hashing embedder or any user model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_RE, is_blank, terms, token_count, truncate_tokens

DIM = 64
# what one request to a model may hold
MAX_ITEMS = 1024
MAX_TOKENS = 250_000
MAX_ITEM_TOKENS = 8191
MAX_KNOWN_TERMS = 200_000  # that a worker remembers

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_slots(text: Column | str, dim: int = DIM) -> Column:
    """Signed slot numbers of a text's terms: ``slot + 1``, negative for a negative sign.

    The slot comes from the first eight hex digits of the term's MD5, the sign
    from the ninth, so any engine can recompute the vectors.
    """

    def slot(term: Column) -> Column:
        digest = F.md5(term.cast("binary"))
        index = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim + 1).cast("int")
        return F.when(F.substring(digest, 9, 1) >= "8", -index).otherwise(index)

    return F.transform(terms(text), slot)


def hashed_embedding(text: Column | str, dim: int = DIM) -> Column:
    """Feature-hashed term counts as ``array<float>`` (not normalised)."""

    @F.arrow_udf("array<float>")
    def counts(listed: pa.Array) -> pa.Array:
        coded = listed.flatten().dictionary_encode()
        slot = _term_slots(coded.dictionary.to_pylist(), dim)[coded.indices.to_numpy(zero_copy_only=False)]
        rows = np.repeat(np.arange(len(listed)), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))
        out = np.bincount(rows * dim + np.abs(slot) - 1, np.sign(slot), len(listed) * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(listed) + 1) * dim, pa.int32()), pa.array(out))

    return counts(terms(text))


_SLOTS: dict[int, dict[str, int]] = {}  # of a worker: terms whose slots it knows


def _term_slots(words: list[str], dim: int) -> np.ndarray:
    """The numbers of ``hashed_slots`` for distinct terms, each computed once while it is remembered."""
    known = _SLOTS.setdefault(dim, {})
    if len(known) > MAX_KNOWN_TERMS:
        known.clear()
    for word in words:
        if word not in known:
            digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
            number = int(digest[:8], 16) % dim + 1
            known[word] = -number if digest[8] >= "8" else number
    return np.array([known[word] for word in words], np.int64)


def request_bounds(tokens: np.ndarray, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """Consecutive ranges of texts, each as long as both limits allow; a text over the token limit is a range of its own."""
    ends = np.cumsum(tokens)
    bounds, lo = [], 0
    while lo < len(tokens):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + max_items, max(lo + 1, int(np.searchsorted(ends, before + max_tokens, side="right"))))
        bounds.append((lo, hi))
        lo = hi
    return bounds


def embed(df: DataFrame, text_col: str = "content", out_col: str = "embedding", dim: int = DIM,
          embedder: Embedder | None = None, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS,
          max_item_tokens: int = MAX_ITEM_TOKENS, token_re: str = TOKEN_RE) -> DataFrame:
    """Add an embedding column.

    Without ``embedder`` the built-in hashing embedder is used. A user model gets
    lists of texts and must answer one vector of ``dim`` numbers per text, in
    order; blank texts and wrong counts or lengths are errors. A list holds at most
    ``max_items`` texts and ``max_tokens`` tokens; a longer text is cut after ``max_item_tokens``.
    """
    if embedder is None:
        return df.withColumn(out_col, hashed_embedding(text_col, dim))

    model = embedder

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = []
            for lo, hi in request_bounds(batch["n"].to_numpy(), max_items, max_tokens):
                texts = batch["text"].iloc[lo:hi].tolist()
                answer = model(texts)
                if len(answer) != len(texts):
                    raise ValueError(f"embedder answered {len(answer)} vectors for {len(texts)} texts")
                if any(len(v) != dim for v in answer):
                    raise ValueError(f"embedder answered a vector that is not {dim} long")
                vectors += [np.asarray(v, dtype=np.float32) for v in answer]
            yield pd.Series(vectors, index=batch.index, dtype=object)

    checked = F.when(is_blank(text_col), F.raise_error(F.lit("cannot embed a blank text"))).otherwise(F.col(text_col))
    count = token_count(F.col(text_col), token_re)
    # most texts are short enough: only others are cut
    held = F.when(count > max_item_tokens, truncate_tokens(F.col(text_col), max_item_tokens, token_re)).otherwise(checked)
    return df.withColumn(out_col, call(F.struct(held.alias("text"), F.least(count, F.lit(max_item_tokens)).alias("n"))))


def check_vectors(df: DataFrame, out_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """Fail the job when a stored vector is missing or has the wrong length."""
    ok = F.coalesce(F.size(out_col) == dim, F.lit(False))
    return df.where(ok | F.assert_true(ok, F.lit(f"embedding is not {dim} long")).isNotNull())
