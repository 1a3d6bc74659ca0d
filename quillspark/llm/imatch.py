"""I-Match document fingerprints, with DataFrame operations only.

A lexicon holds the terms whose inverse document frequency lies in a band. The distinct
lexicon terms of a document are hashed once as a whole and once per randomised subset of the
lexicon; an edit spares the subsets that none of its terms is in. Subsets come in several
sizes, so that short and long documents both have subsets with a few of their terms.

A set of terms is hashed as the XOR of its terms' 64-bit hashes. That has the same value in any order
of the terms, so the sorted list need not be gathered again after the terms have met the lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import texts

# The band: terms of at least LOW and at most HIGH of all documents, and of two at least.
LOW, HIGH = 0.002, 0.2
# Besides all terms: eight subsets of each share 2^-s of the terms.
SIZES, PER_SIZE = (1, 2, 4, 6, 8), 8
TERM_BREAK = r"[^\p{L}\p{N}]+"
# As terms of LOW of all documents are at most (mean distinct terms / LOW), the lexicon does not grow
# with the corpus. Where documents are so long that it still has more terms, no broadcast is asked for.
BROADCAST_TERMS = 500_000
BLOCKS = 512
_MARK = 0  # a code that each text has, so that a text without lexicon terms keeps its row


def term_codes(text: Column) -> Column:
    """Sorted 64-bit codes of the distinct terms: lower-cased runs of letters and digits."""
    found = F.array_remove(F.split(F.lower(text), TERM_BREAK), "")
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.xxhash64(t))))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """code, h, r<size>: the terms within the band, counted over all documents, with their random numbers."""
    counts = docs.select(F.explode(term_codes(F.col("text"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    n = docs.select("doc_id").count()
    band = counts.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)) & (F.col("code") != _MARK)).select("code")
    band = band.unionByName(docs.sparkSession.createDataFrame([(_MARK,)], "code long"))
    drawn = band.select("code", F.xxhash64("code", F.lit(99)).alias("h"), *[F.xxhash64("code", F.lit(s)).alias(f"r{s}") for s in SIZES])
    return settle(drawn, "lexicon")


def _subset_hashes() -> list[Column]:
    """XOR of the hashes of all terms, and of each subset: terms whose s bits from bit i * s on are all zero."""
    term = F.col("code") != _MARK
    out = [F.bit_xor(F.when(term, F.col("h"))).alias("x0")]
    for s in SIZES:
        for i in range(PER_SIZE):
            bits = ((1 << s) - 1) << i * s
            bits -= (1 << 64) if bits >> 63 else 0
            inside = term & (F.col(f"r{s}").bitwiseAND(F.lit(bits)) == 0)
            out.append(F.bit_xor(F.when(inside, F.col("h"))).alias(f"x{len(out)}"))
    return out


def signatures(rows: DataFrame, keys: list[str], codes: Column, lex: DataFrame) -> DataFrame:
    """keys, kind, sig array<int>: the hashes of each kind of term codes of each row; 0 for an empty subset.

    ``codes`` is an array of (kind, whole, codes): ``whole`` stands for the terms of a text without lexicon terms.
    """
    small = lex.count() <= BROADCAST_TERMS
    kinds = rows.select(*keys, F.explode(codes).alias("x")).select(
        *keys, "x.kind", "x.whole", F.explode(F.concat(F.array(F.lit(_MARK).cast("long")), F.col("x.codes"))).alias("code"))
    found = kinds.join(F.broadcast(lex) if small else lex, "code").groupBy(*keys, "kind", "whole").agg(*_subset_hashes())
    n = 1 + len(SIZES) * PER_SIZE
    folded = [F.coalesce(F.col(f"x{i}").bitwiseAND(F.lit(0x3FFFFFFF)).cast("int") + 1, F.lit(0)) for i in range(1, n)]
    first = F.coalesce(F.col("x0"), F.when(F.col("whole") != 0, F.col("whole"))).bitwiseAND(F.lit(0x3FFFFFFF)).cast("int") + 1
    return found.select(*keys, "kind", F.array(F.coalesce(first, F.lit(0)), *folded).alias("sig"))


def _kind(name: int, codes: str) -> Column:
    whole = F.when(F.size(codes) > 0, F.xxhash64(F.col(codes))).otherwise(F.lit(0).cast("long"))
    return F.struct(F.lit(name).alias("kind"), whole.alias("whole"), F.col(codes).alias("codes"))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the parts that are non-empty in either; 1 for equal fingerprints."""
    some = F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: (x["a"] != 0) | (x["b"] != 0))
    same = F.filter(some, lambda x: x["a"] == x["b"])
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.size(same) / F.greatest(F.size(some), F.lit(1)))


def as_hex(sig: str) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, fingerprint (hex digits, eight per hash) of every document; a null text counts as empty.

    Texts without a term in the band are hashed by all their terms; texts without terms have only zeros.
    Rows that repeat both id and text are one document.
    """
    rows = texts(docs)
    coded = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), term_codes(F.col("text")).alias("codes"))
    found = signatures(coded, ["doc_id", "text_hash"], F.array(_kind(0, "codes")), lexicon(rows, low, high))
    return found.select("doc_id", as_hex("sig").alias("fingerprint"))


def with_next(rows: DataFrame, columns: tuple[str, ...], blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with next_<column>: the values of the next row by (doc_id, text), after the last the first.

    The rows are cut into ranges of about equal numbers, each ordered on its own; a range also
    gets a copy of the next range's first row. Null ids come first; rows that repeat
    an id follow each other by text, and of rows with the same id and text one is left. ``block`` names the range.
    """
    rows = rows.withColumn("__k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    cuts = rows.agg(F.percentile_approx("__k", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("__k"))) if cuts else F.lit(0)
    rows = rows.withColumn("block", block)
    # at most ``blocks`` numbers: each range's smallest key
    firsts = sorted((r["block"], r["k"]) for r in rows.groupBy("block").agg(F.min("__k").alias("k")).collect())
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("__k")
    target = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    copies = rows.join(F.broadcast(rows.sparkSession.createDataFrame(target, "__k long, __to int")), "__k")
    one = copies.groupBy("__to").agg(F.min(F.struct("text", *[c for c in rows.columns if c != "text"])).alias("x"))
    copies = one.select("x.*", "__to").withColumn("block", F.col("__to")).drop("__to").withColumn("__copy", F.lit(True))
    order = Window.partitionBy("block").orderBy("__copy", "__k", "text")
    both = rows.withColumn("__copy", F.lit(False)).unionByName(copies)
    follows = F.struct(*[F.lead(c).over(order).alias(c) for c in ("__k", "text", "__copy")])
    led = both.select("*", follows.alias("__next"), *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    again = (F.col("__next.__k") == F.col("__k")) & (F.col("__next.text") == F.col("text")) & ~F.col("__next.__copy")
    return led.where(~F.col("__copy") & ~F.coalesce(again, F.lit(False))).drop("__k", "__copy", "__next")


def compare_edits(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Edited: the last floor(n_chars / 4) code points are replaced by the first as many (or
    all) of the next document. doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A single document is its own next one. Rows that repeat both id and
    text are one document, with one row; null texts count as empty.
    """
    rows = texts(docs)
    lex = lexicon(rows, low, high)
    both = with_next(rows.withColumn("text_hash", F.xxhash64("text")), ("doc_id", "text_hash", "text"))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    coded = both.select("block", "doc_id", "text_hash", "next_doc_id", "next_text_hash", n.cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        term_codes(F.col("text")).alias("codes"), term_codes(F.col("edited")).alias("edited_codes"))
    keys = ["block", "doc_id", "text_hash", "next_doc_id", "next_text_hash", "n_chars", "edited_sha256"]
    sigs = settle(signatures(coded, keys, F.array(_kind(0, "codes"), _kind(1, "edited_codes")), lex), "signatures")
    own = sigs.where("kind = 0")
    edited = sigs.where("kind = 1").select("doc_id", "text_hash", F.col("sig").alias("edited_sig"))
    after = own.select("doc_id", "text_hash", F.col("sig").alias("next_sig"))
    rows = own.alias("o").join(edited.alias("e"), F.expr("o.doc_id <=> e.doc_id AND o.text_hash = e.text_hash")).join(
        after.alias("n"), F.expr("o.next_doc_id <=> n.doc_id AND o.next_text_hash = n.text_hash"))
    return rows.select("o.doc_id", "n_chars", "edited_sha256", as_hex("sig").alias("fingerprint"), as_hex("edited_sig").alias("edited_fingerprint"),
                       likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
