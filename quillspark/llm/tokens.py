"""Encode whole texts with a ``tokenizers`` file, each distinct word once per task."""

from __future__ import annotations

import os
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 300_000
LONGEST_CACHED = 64
# words on which the short way must agree with the tokenizer, or it isn't taken
PROBES = ("a", "the", "tokenizer", "onethtionand", "é", "ñandúes", "straße", "шла", "語", "i", "re", "ll", "x" * 40)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of many texts from a tokenizer that drops white space and never joins words across it.

    Such a tokenizer gives a text the ids of its space-separated words one after the
    other, so every distinct word is encoded once and looked up after that. Only the
    space and the line feed are used as cuts; all other characters stay inside words.
    The memory of known words is emptied when it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.direct = all(self._letters(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.slots = np.zeros(1 << 14, np.uint32), 0, 0

    def _store(self, rows: list[list[int]]) -> int:
        """Append id rows; returns the slot of the first one."""
        first, counts = self.slots, np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter((i for row in rows for i in row), np.uint32, int(counts.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(rows) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[first:first + len(rows)] = self.used + np.cumsum(counts) - counts
        self.lengths[first:first + len(rows)] = counts
        self.used, self.slots = self.used + len(ids), first + len(rows)
        return first

    def _letters(self, word: str) -> list[int]:
        """Ids of a word that the tokenizer leaves in one piece and as it is."""
        piece = word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0]
        return [token.id for token in self.model.tokenize(piece)]

    def _one_piece(self, word: str) -> bool:
        return word.isalpha() and (word.islower() if word.isascii() else word == word.lower() and is_normalized("NFC", word))

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Words of lower-case letters go to the model at once, as no other step changes them; all others through every step."""
        rows = [self._letters(w) if self.direct and self._one_piece(w) else None for w in words]
        rest = [w for w, ids in zip(words, rows, strict=True) if ids is None]
        encoded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [next(encoded).ids if ids is None else ids for ids in rows]

    def _full(self) -> bool:
        return len(self.known) > CACHED_WORDS

    def _slots(self, words: list[str]) -> np.ndarray:
        if self._full():
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            first = self._store(self._encode_words(new))
            known.update(zip(new, range(first, first + len(new)), strict=True))
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:  # long words are not kept: their number of bytes has no bound
            if len(w) > LONGEST_CACHED:
                del known[w]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (uint32), and the bounds of each text in them."""
        plain = pc.replace_substring(texts, "\n", " ")
        if self.lowers and not any(pc.any(pc.match_substring(plain, s, ignore_case=True)).as_py() for s in self.specials):
            plain = pc.ascii_lower(plain)  # as the tokenizer will; only its special tokens are looked for before that
        # marks at a word's end are a piece of their own: "end." and "end" then share a word
        plain = pc.replace_substring_regex(plain, r"([A-Za-z0-9])([.,&*%$#!|]+)(\s|$)", r"\1 \2\3")
        parts = pc.split_pattern(plain, " ")
        words = parts.flatten().dictionary_encode()
        slot = self._slots(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        counts = self.lengths[slot]
        ends = np.cumsum(counts)
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[slot] - (ends - counts), counts) + np.arange(total)
        return self.flat[at], bounds


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder: tasks that follow each other in a worker share its known words."""
    return WordEncoder(path)
