"""Byte-level BPE with tiktoken: encode whole texts, decode ids to raw bytes."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts

PIECE_CHARS = 1 << 16
LONG_RUN = 1 << 14


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local rank file (base64 token, rank per line), without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# Every match of the split pattern ends where a space or line feed follows a character
# that is no white space, and where a digit follows a letter or a letter a digit.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text into pieces of at least ``size`` characters, only where no match can cross."""
    pieces, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        pieces.append(text[start:cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


# What the split pattern takes for white space (Python's own class differs), in runs that its engine can't walk.
_RUN = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def _encode(encoding, text: str) -> list[int]:
    """Ids of a text. Of a very long run of white space, all but the last character (all of it at the text's end) is one match: it goes
    to the merges at once, past the split pattern."""
    if len(text) <= PIECE_CHARS:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in safe_pieces(text[at:run.start()]):
            ids += encoding.encode_ordinary(piece)
        ids += encoding._encode_single_piece(run.group()[:end - run.start()].encode())
        at = end
    for piece in safe_pieces(text[at:]):
        ids += encoding.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the BPE ids of each whole text.

    One row per input row (repeated rows and ids stay); a null or empty text has no
    ids; very long texts are encoded piece by piece between safe cuts, with the same
    ids. Only ``doc_id`` and ``text`` are read. ``path`` must be readable where tasks run.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def make():
        encoding = load_encoding(path, pattern)

        def step(batch):
            ids = [_encode(encoding, t) for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return map_slices(texts(docs), make, "doc_id long, ids array<int>", rows=1024, size=4 << 20)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded binary: the raw bytes of each row's ids (null ids: no bytes).

    Bytes, not text: ids that stop inside a character stay exact.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches):
        encoding = load_encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [encoding.decode_bytes(i or []) for i in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())],
                                      ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
