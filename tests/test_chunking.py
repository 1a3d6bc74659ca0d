import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import token_count
from quillspark.operators.chunking import chunk_documents, line_chunks, request_batches


def chunks(spark, body, **kw):
    df = spark.createDataFrame([("d", body)], "document_id string, body string")
    return chunk_documents(df, **kw).orderBy("chunk_index").collect()


def test_blank_bodies_and_bare_headings_give_no_chunks(spark):
    assert chunks(spark, "") == [] and chunks(spark, " \n\t ") == [] and chunks(spark, "# A\n\n## B\n") == []


def test_headings_paragraphs_and_anchors(spark):
    got = chunks(spark, "lead\n\n# Top heading\nfirst\nline\n\nsecond\n## Sub ##\nstays text\n## C#\nsharp\n### Deep\nend\n# Top heading\nlast")
    assert [(c["section_path"], c["anchor"]) for c in got] == [
        ([], None), (["Top heading"], "top-heading-1"), (["Top heading", "Deep"], "deep"), (["Top heading"], "top-heading-1")]
    # A closed heading and one ending in `#` are sections, yet stay paragraph text here.
    assert got[1]["content"] == "Top heading\nfirst\nline\nsecond\n## Sub ##\nstays text\n## C#\nsharp"
    assert [c["chunk_index"] for c in got] == [0, 1, 2, 3]
    assert [c["chunk_id"] for c in got] == ["d-0", "d-1", "d-2", "d-3"]


def test_token_limit_and_whole_text(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    paragraphs, at = [], 0
    while at < len(words):
        n = rng.randint(1, 700)
        paragraphs.append(" ".join(words[at:at + n]))
        at += n
    df = spark.createDataFrame([("d", "# Heading of it\n" + "\n\n".join(paragraphs))], "document_id string, body string")
    out = chunk_documents(df, max_tokens=128).withColumn("n", token_count("content")).orderBy("chunk_index").collect()
    assert max(r["n"] for r in out) <= 128 and len(out) > 20
    assert " ".join(r["content"].removeprefix("Heading of it\n").replace("\n", " ") for r in out).split() == words
    assert all(0 <= r["char_start"] <= r["char_end"] for r in out)


def test_heading_longer_than_half_the_limit_is_left_out(spark):
    title = " ".join(["word"] * 80)
    got = chunks(spark, f"# {title}\nbody text", max_tokens=100)
    assert got[0]["content"] == "body text" and got[0]["section_path"] == [title]


def test_long_headings_kept_on_request(spark):
    title = " ".join(f"w{i}" for i in range(300))
    got = chunks(spark, f"# {title}\n" + " ".join(f"b{i}" for i in range(150)), max_tokens=100, keep_headings=True)
    assert " ".join(c["content"] for c in got).split() == title.split() + [f"b{i}" for i in range(150)]
    assert all(c["section_path"] == [title] for c in got)


def test_control_characters_make_no_headings(spark):
    got = chunks(spark, "# Real\ntext\n\n\x011\x01Invented\n\nmore")
    assert [(c["section_path"], c["content"]) for c in got] == [(["Real"], "Real\ntext\n\x011\x01Invented\nmore")]


def test_offsets(spark):
    body = "alpha beta\n\n# A rather long heading\n\nunder it\n\n# Other\nshort"
    got = chunks(spark, body)
    assert body[got[0]["char_start"]:got[0]["char_end"]] == "alpha beta"
    # The heading stands before the text with one line break: found by its first line.
    assert body[got[1]["char_start"]:].startswith("A rather long heading")
    # `Other\nshort` is found exactly.
    assert body[got[2]["char_start"]:got[2]["char_end"]] == "Other\nshort"


def test_line_chunks(spark):
    df = spark.createDataFrame([("d", " a \n\n\tb\n")], "document_id string, body string")
    assert [tuple(r) for r in line_chunks(df).orderBy("chunk_index").collect()] == [("d-0", "d", 0, "a"), ("d-1", "d", 1, "b")]


@pytest.mark.parametrize("texts,kw,batches", [
    (["a", "b", "c", "d", "e"], {"max_items": 2}, [0, 0, 1, 1, 2]),
    (["a b c", "d e", "f", "g h i j"], {"max_tokens": 5}, [0, 0, 1, 1]),
    (["a b c d e f g", "h"], {"max_tokens": 3, "max_item_tokens": 4}, [0, 1]),
    ([], {}, []),
])
def test_request_batches(spark, texts, kw, batches):
    df = spark.createDataFrame([("g", texts)], "g string, content array<string>")
    rows = request_batches(df, "g", "pos", **kw).orderBy("pos").collect()
    assert [r["batch_id"] for r in rows] == batches
    if "max_item_tokens" in kw:
        assert rows[0]["text"] == "a b c d" and rows[0]["tokens"] == 4


def test_chunking_needs_no_shuffle(spark):
    df = spark.createDataFrame([("d", "# A\nb")], "document_id string, body string")
    plan = chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert df.select(F.lit(1)).count() == 1
