"""What a user's model gets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators.embedding import embed, request_bounds


def test_request_bounds():
    assert request_bounds(np.array([1, 1, 1, 1, 1]), 2, 100) == [(0, 2), (2, 4), (4, 5)]
    assert request_bounds(np.array([5, 5, 5, 11, 1]), 10, 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert request_bounds(np.array([], int)) == []


def test_a_model_sees_requests_within_the_limits(spark):
    """The model answers what it saw: number of texts, their tokens, those of this text, and its first number."""

    def model(texts):
        sizes = [len(t.split()) for t in texts]
        return [[len(texts), sum(sizes), n, int(t.split()[0][1:])] for n, t in zip(sizes, texts, strict=True)]

    words = F.expr("concat_ws(' ', transform(sequence(1, 1 + cast(id as int) % 17 * (case when id % 500 = 3 then 800 else 4 end)), i -> concat('w', id)))")
    docs = spark.range(6000, numPartitions=2).select("id", words.alias("content"))
    got = embed(docs, dim=4, embedder=model, max_items=300, max_tokens=2500, max_item_tokens=2000).collect()
    assert len(got) == 6000
    for r in got:
        items, tokens, own, number = r["embedding"]
        assert items <= 300 and tokens <= 2500 and number == r["id"] and own == min(2000, len(r["content"].split()))
    assert max(r["embedding"][1] for r in got) > 2000 and max(len(r["content"].split()) for r in got) > 2000


def test_errors(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, content string")
    for model in (lambda texts: [[0.0] * 4] * (len(texts) + 1), lambda texts: [[0.0] * 3 for _ in texts]):
        with pytest.raises(Exception, match="embedder answered"):
            embed(docs, dim=4, embedder=model).collect()
    with pytest.raises(Exception, match="blank"):
        embed(spark.createDataFrame([(1, " ")], "id int, content string"), dim=4, embedder=lambda t: [[0.0] * 4 for _ in t]).collect()
    assert embed(docs.limit(0), dim=4, embedder=lambda t: []).collect() == []


def test_slots_are_hashed_once_per_term(spark):
    from quillspark.operators.embedding import embed, hashed_slots

    rows = [(1, "one two Two three"), (2, ""), (3, "Straße one 12 one"), (4, "two")]
    df = spark.createDataFrame(rows, "id int, content string")
    out = embed(df, dim=8)
    assert "md5" not in out._jdf.queryExecution().toString()  # not per occurrence in an expression
    got = {r["id"]: list(r["embedding"]) for r in out.collect()}
    for r in df.select("id", hashed_slots("content", 8).alias("s")).collect():
        want = [0.0] * 8
        for s in r["s"]:
            want[abs(s) - 1] += 1 if s > 0 else -1
        assert got[r["id"]] == want
