"""Encode whole texts with a byte-level ``tokenizers`` file, each distinct word once per worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import WordEncoder, tokenizer_path

# Where the pre-tokenizer starts a new match whatever stands around: at a space after a visible character, at a mark (no
# apostrophe: it may belong to what follows) after a letter or digit, and around a line feed between visible characters.
_ODD_SPACE = r"[^!-~\pL] "
_BEFORE_SPACE = r"([!-~\pL]) "
_BEFORE_MARK = r"([A-Za-z0-9])([!-&(-/:-@\[-`{-~])"
_LINE_FEED = r"([!-~])\n([!-~])"
_MARKS = ("\x1f", "\x1e", "\x1d", "\ue000", "\uf8ff")
REMEMBERED = 600_000  # words of a worker's memory
# words on which the way round must agree with the tokenizer, or it isn't taken
PROBES = (" the", "word", " tokenizer", " onethtionand", "é", " ñandúes", " straße", " шла", " 語", "Él", " " + "x" * 40)


class ByteWordEncoder(WordEncoder):
    """Ids of many texts from a byte-level tokenizer whose pre-tokenizer is the usual one.

    Texts are cut where its matches always end, so the ids of the parts, one after the other, are those of the
    text. Distinct parts are encoded once and remembered up to a number of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the way round is for a tokenizer that changes nothing before it splits and has this byte alphabet
        whole = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES]
        self.cuts = self.tokenizer.normalizer is None and [self._direct(w) for w in PROBES] == whole
        self._forget()

    def _full(self) -> bool:
        return len(self.known) > REMEMBERED

    def _direct(self, word: str) -> list[int]:
        """Ids of letters, a space before them or not: one match, so the model gets their bytes at once."""
        if word.isascii():
            shown = _SPACE + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(_SHOWN)
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        if not self.cuts:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        rows = [self._direct(w) if (w[1:] if w[:1] == " " else w).isalpha() else None for w in words]
        rest = [w for w, ids in zip(words, rows, strict=True) if ids is None]
        encoded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [next(encoded).ids if ids is None else ids for ids in rows]

    def _cut(self, texts: pa.Array, mark: str) -> pa.Array:
        """The texts with ``mark`` at safe cuts. Where every space follows a visible character, all spaces are cuts."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        if pc.any(odd).as_py():
            careful = pc.replace_substring_regex(texts.filter(odd), _BEFORE_SPACE, rf"\1{mark} ")
            cut = pc.replace_with_mask(pc.replace_substring(texts, " ", mark + " "), odd, careful)
        else:
            cut = pc.replace_substring(texts, " ", mark + " ")
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials):
            return cut  # no cut inside a special token
        cut = pc.replace_substring_regex(cut, _BEFORE_MARK, rf"\1{mark}\2")
        return pc.replace_substring_regex(cut, _LINE_FEED, f"\\1{mark}\n{mark}\\2")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (uint32), and the bounds of each text in them."""
        mark = next((m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if not self.cuts or mark is None:
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            return np.fromiter((i for r in rows for i in r), np.uint32, int(bounds[-1])), bounds
        parts = pc.split_pattern(self._cut(texts, mark), mark)
        words = parts.flatten().dictionary_encode()
        slot = self._slots(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        counts = self.lengths[slot]
        ends = np.cumsum(counts)
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[slot] - (ends - counts), counts) + np.arange(total)
        return self.flat[at], bounds


def _shown_bytes() -> dict[int, str]:
    """The visible character that stands for each byte in the tokenizer's model: itself, or the next free one from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_SHOWN = _shown_bytes()
_SPACE = _SHOWN[0x20]


@lru_cache(maxsize=1)
def byte_word_encoder(path: str) -> ByteWordEncoder:
    """The worker's encoder: tasks that follow each other in a worker share its known words."""
    return ByteWordEncoder(path)


def byte_tokenizer_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")
