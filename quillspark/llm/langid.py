"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads the lower-cased bytes of a word, a run between spaces and line feeds,
forwards and backwards and gives every position a probability per language. A document's
probabilities are the mean over all its letter positions. As the state starts anew with
each word, a word has the same positions wherever it stands, so each distinct word is run
once per task; words longer than ``PIECE`` bytes run in pieces of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, keep_rows, learnable, map_slices, texts

HIDDEN = 16
PIECE = 24
MAX_LANGUAGES = 64
TRAIN_DOCS = 400  # per language, in the mean
TRAIN_WORDS = 60_000
CACHED_WORDS = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_LETTER = np.zeros(256, np.float32)
_LETTER[ord("a"):ord("z") + 1], _LETTER[ord("A"):ord("Z") + 1], _LETTER[128:] = 1, 1, 1


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGRU:
    """Two GRUs, one per direction, and a softmax over both states at each position."""

    STEPS, BATCH, RATE = 500, 384, 0.012

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        self.h, f = hidden, np.float32
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(f)  # byte -> update, reset, candidate
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(f)
            self.p["c" + d] = np.zeros(3 * h, f)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, n_out)).astype(f)
        self.p["ob"] = np.zeros(n_out, f)

    def _direction(self, d: str, seq: np.ndarray, keep: bool):
        """States at each of the positions of ``seq`` (rows x time, in reading order)."""
        h, u = self.h, self.p["u" + d]
        x, bias = self.p["x" + d], self.p["c" + d]
        state, states, saved = np.zeros((len(seq), h), np.float32), [], []
        for t in range(seq.shape[1]):
            a = x[seq[:, t]] + bias
            g = state @ u
            zr = _sigmoid(a[:, :2 * h] + g[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h:] + r * g[:, 2 * h:])
            new = n + z * (state - n)
            if keep:
                saved.append((state, z, r, n, g[:, 2 * h:]))
            state = new
            states.append(state)
        return states, saved

    def _outputs(self, seq: np.ndarray, keep: bool = False):
        fwd, saved_f = self._direction("f", seq, keep)
        bwd, saved_b = self._direction("b", seq[:, ::-1], keep)
        both = np.stack([np.concatenate([f, b], 1) for f, b in zip(fwd, bwd[::-1], strict=True)], 1)
        logits = both @ self.p["o"] + self.p["ob"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True), both, saved_f, saved_b

    def positions(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities (rows x time x languages) of byte sequences of one length."""
        return self._outputs(seq)[0]

    def _back(self, d: str, seq: np.ndarray, saved, dstates, grads) -> None:
        h, u = self.h, self.p["u" + d]
        gx, gu, gc = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros(3 * h, np.float32)
        dstate = np.zeros_like(dstates[0])
        for t in range(seq.shape[1] - 1, -1, -1):
            dstate = dstate + dstates[t]
            state, z, r, n, gn = saved[t]
            dz = dstate * (state - n) * z * (1 - z)
            dn = dstate * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], 1)
            da = np.concatenate([dz, dr, dn], 1)
            np.add.at(gx, seq[:, t], da)
            gc += da.sum(0)
            gu += state.T @ dg
            dstate = dstate * z + dg @ u.T
        grads["x" + d], grads["u" + d], grads["c" + d] = gx, gu, gc

    def gradients(self, seq: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions, and its gradients by backpropagation through time."""
        probs, both, saved_f, saved_b = self._outputs(seq, keep=True)
        rows, time = seq.shape
        picked = np.take_along_axis(probs, target[:, None, None].repeat(time, 1), 2)
        loss = float(-np.log(np.maximum(picked, 1e-9)).mean())
        d = probs.copy()
        d[np.arange(rows), :, target] -= 1
        d /= rows * time
        grads = {"o": np.einsum("rth,rtc->hc", both, d), "ob": d.sum((0, 1))}
        dboth = d @ self.p["o"].T
        h = self.h
        self._back("f", seq, saved_f, [dboth[:, t, :h] for t in range(time)], grads)
        self._back("b", seq[:, ::-1], saved_b, [dboth[:, t, h:] for t in range(time - 1, -1, -1)], grads)
        return loss, grads

    def fit(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, seed: int = 5) -> ByteGRU:
        """Adam over batches of words of one length, drawn by their weight."""
        rng = np.random.default_rng(seed)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        lengths = sorted(groups)
        data = {n: (np.frombuffer(b"".join(words[i] for i in groups[n]), np.uint8).reshape(-1, n), target[groups[n]],
                    weight[groups[n]] / weight[groups[n]].sum()) for n in lengths}
        share = np.array([weight[groups[n]].sum() * n ** 0.5 for n in lengths])
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, self.STEPS + 1):
            seq, goal, odds = data[lengths[rng.choice(len(lengths), p=share / share.sum())]]
            pick = rng.choice(len(goal), self.BATCH, p=odds)
            _, grads = self.gradients(seq[pick], goal[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = self.RATE * (1 - 0.9 * step / self.STEPS)
            for k, g in grads.items():
                g, (m, s) = g * min(1.0, 1.0 / max(norm, 1e-6)), state[k]
                m += 0.1 * (g - m)
                s += 0.005 * (g * g - s)
                self.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.995 ** step)) + 1e-7)).astype(np.float32)
        return self


class LanguageModel:
    """A fitted network and its languages, in the order of its outputs."""

    def __init__(self, languages: list[str], net: ByteGRU | None):
        self.languages, self.net = languages, net

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per word: the summed probabilities of its letter positions, and their number at the end."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            raw = word.encode()
            for lo in range(0, len(raw), PIECE):
                piece = raw[lo:lo + PIECE]
                groups.setdefault(len(piece), []).append((i, piece))
        for n, group in groups.items():
            for lo in range(0, len(group), 8192):
                part = group[lo:lo + 8192]
                seq = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, n)
                letters = _LETTER[seq]
                sums = (self.net.positions(seq) * letters[..., None]).sum(1)
                np.add.at(out, [i for i, _ in part], np.column_stack([sums, letters.sum(1)]))
        return out

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """Runs (start byte, end byte, language) that cover every letter position of the text."""
        runs: list[tuple[int, int, str]] = []
        raw, at = text.encode(), 0
        for word in raw.replace(b"\n", b" ").split(b" "):
            for lo in range(0, len(word), PIECE):
                piece = np.frombuffer(word[lo:lo + PIECE].lower(), np.uint8)[None]
                best = self.net.positions(piece)[0].argmax(1)
                for i, k in enumerate(best):
                    if not _LETTER[piece[0, i]]:
                        continue
                    where, name = at + lo + i, self.languages[k]
                    if runs and runs[-1][2] == name and not _LETTER[np.frombuffer(raw[runs[-1][1]:where], np.uint8)].any():
                        runs[-1] = (runs[-1][0], where + 1, name)
                    else:
                        runs.append((where, where + 1, name))
            at += len(word) + 1
        return runs


def train(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS,
          only_learnable: bool = True) -> LanguageModel:
    """Fit on the words of a bounded sample: about ``docs_per_language`` documents of each of the (at most
    ``MAX_LANGUAGES`` commonest) languages, and of those ``max_words`` distinct words, drawn by
    their counts. Both draws follow hashes, so the same table gives the same model.
    No learnable row gives a model without languages.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(learnable()) if only_learnable else known
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    languages = sorted(r["lang"] for r in sizes.collect())
    if not languages:
        return LanguageModel([], None)
    unit = lambda *c: (F.xxhash64(*c) / F.lit(2.0 ** 64)) + F.lit(0.5)
    few = known.join(F.broadcast(sizes), "lang").where(unit("doc_id") * F.col("count") < docs_per_language)
    words = few.select("lang", F.explode(F.split(F.translate("text", UPPER, UPPER.lower()), "[ \n]+")).alias("word")).where("word != ''")
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    drawn = counted.withColumn("key", -F.log(F.greatest(unit("lang", "word"), F.lit(1e-12))) / F.sqrt("n"))
    rows = drawn.orderBy("key", "lang", "word").limit(max_words).select("lang", F.substring("word", 1, PIECE).alias("word"), "n").toPandas()
    index = {name: i for i, name in enumerate(languages)}
    target = rows["lang"].map(index).to_numpy(np.int64)
    share = np.bincount(target, weights=np.sqrt(rows["n"]), minlength=len(languages))  # no language outweighs the others
    weight = np.sqrt(rows["n"].to_numpy(float)) / np.maximum(share, 1e-9)[target]
    return LanguageModel(languages, ByteGRU(len(languages)).fit([w.encode()[:PIECE] for w in rows["word"]], target, weight))


class Predictor:
    """The worker's side of a model: whole texts to languages, each distinct word run once while it is remembered."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.sums = np.zeros((0, len(model.languages) + 1), np.float32)

    def _sums(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known, self.sums = {}, self.sums[:0]
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            known.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.model.word_sums(new)])
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:  # very long words are not kept: their number of bytes has no bound
            if len(w) > 4 * PIECE:
                del known[w]
        return self.sums[found]

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        languages, n = self.model.languages, len(texts)
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        parts = pc.split_pattern(plain, " ")
        words = parts.flatten().dictionary_encode()
        pooled = np.zeros((n, len(languages) + 1))
        if languages and len(words):
            sums = self._sums(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(n), np.diff(parts.offsets.to_numpy()))
            for c in range(pooled.shape[1]):
                pooled[:, c] = np.bincount(row, weights=sums[:, c], minlength=n)
        letters = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False) & (pooled[:, -1] > 0)
        probs = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
        best = probs.argmax(1) if languages else np.zeros(n, int)
        names = [languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, np.minimum(1, probs.max(1, initial=0)), 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row: the language of the largest pooled probability, and that.

    ``und`` with score 0 for a null text, a text without a letter, or a model without
    languages. Ties go to the first language by name. Repeated rows stay.
    """

    def make():
        predictor = Predictor(model)

        def step(batch):
            names, score = predictor(batch.column("text"))
            return pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return map_slices(texts(docs), make, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, in a language the model knows: not ``und``, and a score of at least ``least``."""

    def make():
        predictor = Predictor(model)

        def step(batch):
            names, score = predictor(filled(batch))
            return pa.array((np.array(names) != "und") & (score >= least))

        return step

    return keep_rows(docs, make)
