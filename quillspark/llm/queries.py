"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from ..session import apply_safe_conf
from . import ann, byte_bpe, imatch, langid, license_scan, packing, quality, ranked, simhash, suffix_dedup, tiers, token_output, whitening
from .common import learnable, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            apply_safe_conf(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_licenses(spark, sf_dir):
    """License phrases and notices in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op2_repeats(spark, sf_dir):
    """All documents without the bytes of 100-byte strings that start earlier too."""
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_token_shards(spark, sf_dir):
    """Ids of all documents in binary shards, read back by key."""
    return token_output.read_shards(token_output.write_shards(table(spark, sf_dir, "documents"), end_id=1))


@query()
def op4_quality(spark, sf_dir):
    """Quality score of all documents by a factorisation machine."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op5_simhash(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_byte_bpe(spark, sf_dir):
    """Byte-level BPE of all documents, decoded again."""
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"))))


@query()
def op8_language(spark, sf_dir):
    """Language of all documents by a bidirectional byte GRU."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")


@query()
def op7_best_fit(spark, sf_dir):
    """All documents' pieces in sequences of at most 2048 tokens."""
    placed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), end_id=0))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "sequence_id", F.col("offset").cast("long").alias("offset"), "certified")


@query()
def op9_imatch(spark, sf_dir):
    """I-Match fingerprints of all documents, of their edited texts and their next documents'."""
    return imatch.compare_edits(table(spark, sf_dir, "documents"))


@query()
def op10_neighbours(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query()
def op13_whitening(spark, sf_dir):
    """Whitened components of all vectors, with what they explain."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op12_tiers(spark, sf_dir):
    """All documents in full sequences of several lengths, dealt to steps."""
    placed = tiers.deal_steps(tiers.pack(table(spark, sf_dir, "documents"), end_id=1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_TERM}') AS ts FROM documents),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM n),
m AS (SELECT r, doc_id, 50 + ((50 * n * cn) // cl) AS m FROM n, c),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * cn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_TERM}')) AS t FROM benchmark),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (r) WHERE score > 0)
WHERE rank <= 50""")
def op11_ranked(spark, sf_dir):
    """The 50 best documents of each benchmark text."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
