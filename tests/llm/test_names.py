"""Documents without an id whose texts share their 32-bit hash stay apart."""

from pyspark.sql import functions as F

from quillspark.llm import near_copies, simhash, suffix_dedup


def test_texts_of_one_short_hash(spark):
    word = F.sha2(F.col("id").cast("string"), 512)
    # every other text repeats itself
    many = spark.range(400_000, numPartitions=4).select(F.concat(word, F.lit(" end "), F.when(F.col("id") % 2 == 0, word).otherwise(F.lit("of it"))).alias("text"))
    both = many.groupBy(F.hash("text").alias("h")).agg(F.sort_array(F.collect_list("text")).alias("texts")).where("size(texts) = 2")
    pair = both.where("length(texts[0]) != length(texts[1])").orderBy("h").first()["texts"]
    docs = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == sorted(pair)
    assert sorted(r["text"] for r in near_copies.keep_one(docs).collect()) == sorted(pair)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(138, 0), (261, 128)]
    assert sorted(len(r["text"]) for r in suffix_dedup.shorten(docs).collect()) == [133, 138]
