"""File streams made from a table: parts in order, each in several files."""

from pyspark.sql import functions as F
from quillspark.plans import streams
from quillspark.streaming.sync import drain


def test_parts_are_several_files_in_order(spark):
    df = spark.range(600).select((F.col("id") % 20).cast("string").alias("message_id"), F.floor(F.col("id") / 20).alias("seq"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = streams._as_stream(df, F.floor(F.col("seq") / 10).cast("int"), "log", "message_id")
        out = drain(stream.withColumn("file", F.input_file_name()), "log-out").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r["message_id"], r["seq"]) for r in out) == sorted((str(i % 20), i // 20) for i in range(600))
    files = {}
    for r in out:
        files.setdefault((r["message_id"], r["seq"] // 10), set()).add(r["file"])
    assert all(len(f) == 1 for f in files.values())  # a message's rows of a part
    assert len(set().union(*files.values())) > streams.PARTS  # a part is no longer one file
