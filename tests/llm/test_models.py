"""Classifiers: gradients against differences, held-out accuracy, rows without content."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import langid, quality
from quillspark.llm.common import learnable

SF = "/root/testdata/sf0.01"


def test_pairwise_sum_is_the_sum_over_pairs():
    x = quality.Features.of(pa.array(["a b b c, D", "", "one &&& two"]), pa.array([10, None, 11], pa.int64()))
    model = quality.FactorisationMachine()
    rng = np.random.default_rng(0)
    model.weight, model.factors = rng.normal(size=model.weight.shape), rng.normal(size=model.factors.shape)
    z = model._forward(x)[0]
    for r in range(3):
        full = np.zeros(len(model.weight))
        a, b = x.bounds[r:r + 2]
        full[x.bucket[a:b]] = x.value[a:b]
        full[quality.BUCKETS:] = model._dense(x.stats)[r]
        on = np.flatnonzero(full)
        pairs = sum(full[i] * full[j] * model.factors[i] @ model.factors[j] for n, i in enumerate(on) for j in on[n + 1:])
        assert z[r] == pytest.approx(model.bias + model.weight @ full + pairs)


def test_slices_don_t_change_features():
    texts = pa.array(["x y", "", "b b b\nc !! D1 é", "z"])
    whole, part = quality.Features.of(texts, pa.nulls(4, pa.int64())), quality.Features.of(texts.slice(2, 1), pa.nulls(1, pa.int64()))
    assert np.allclose(whole.take(np.array([2])).stats, part.stats) and whole.take(np.array([2])).bucket.tolist() == part.bucket.tolist()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(~learnable()).toPandas()
    assert len(scored) > 100 and ((scored["score"] >= 0.5) == (scored["quality"] == 1)).mean() > 0.97


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(9, 1, 0), (9, 0, 0), (14, 0, 1), (None, 1, 1), (11, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels, only_learnable=False)
    got = quality.score(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5, 6)}
    assert len(empty) == 1
    assert quality.keep(odd_docs, model, 0.0).columns == odd_docs.columns and quality.keep(odd_docs, model, 0.0).count() == len(odd_rows)
    kept = {r["doc_id"] for r in quality.keep(odd_docs.where("doc_id < 18"), model).collect()}
    assert kept == {r["doc_id"] for r in got if r["doc_id"] and r["doc_id"] < 18 and r["score"] >= 0.5}
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0))).collect() == []
    blank = quality.train(odd_docs, labels.limit(0))
    assert {r["score"] for r in quality.score(odd_docs, blank).collect()} == {0.5}


def test_backpropagation_through_time():
    net = langid.ByteGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    seq, target = rng.integers(97, 103, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(seq, target)
    for name, value in net.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        kept, losses = value[at], []
        for step in (1e-4, -1e-4):
            value[at] = kept + step
            losses.append(net.gradients(seq, target)[0])
        value[at] = kept
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2, abs=1e-6), name


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_on_held_out_rows(spark, language_model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").where(~learnable()).toPandas()
    assert len(got) > 200 and (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_language_of_odd_rows(odd_docs, odd_rows, no_docs, language_model):
    got = langid.predict(odd_docs, language_model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] in (5, 6, 7, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in language_model.languages and 0 < r["score"] <= 1
    kept = langid.keep(odd_docs, language_model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows) - 4
    nothing = langid.train(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, language_model).collect() == []


def test_every_letter_position_is_labelled(language_model):
    text = "the straße, 12 ñ!"
    runs = language_model.label(text)
    raw = text.encode()
    covered = {i for a, b, _ in runs for i in range(a, b)}
    assert {i for i, c in enumerate(raw) if chr(c).isalpha() and c < 128 or c >= 128} <= covered
    assert all(a < b for a, b, _ in runs) and all(x[1] <= y[0] for x, y in zip(runs, runs[1:]))


def test_the_memory_of_words_changes_nothing(language_model, monkeypatch):
    texts = pa.array(["der die das und", "the and of that", "x" * 400, "the und"])
    want = langid.Predictor(language_model)(texts)
    monkeypatch.setattr(langid, "CACHED_WORDS", 1)
    small = langid.Predictor(language_model)
    for _ in range(2):
        got = small(texts)
        assert got[0] == want[0] and np.allclose(got[1], want[1])
