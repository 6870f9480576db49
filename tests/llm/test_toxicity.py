"""Toxicity: gradients, planted cases and held-out quality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import toxicity

TABLES = "/root/testdata/sf0.1"


def planted(n=1500, seed=1):
    chance = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        said = [" ".join(chance.choices(words, k=8)) for _ in range(chance.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            at = chance.randrange(len(said))
            said[at] += chance.choice([" vile", " nasty", " horrid"])
        docs.append((i, ". ".join(said)))
        labels.append((i, int(bad)))
    return docs, labels


def test_planted_words(spark):
    docs, labels = planted()
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(model.weights.get(w, 0) > 2 for w in (b"vile", b"nasty", b"horrid"))
    assert model.score(b"word1 word2. You VILE thing! word3") > 0.5 > model.score(b"word1 word2. word3. " * 30)
    text = "Wörd1 word2. So vile, this.\nword3"
    assert [text[s:e] for s, e, _ in model.locate(text)] == [" So vile, this."]
    spans = toxicity.offending(model, spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()
    assert [len(r.offending) for r in spans] == [1, 0, 0]
    assert model.score(None) == model.score(b"") == model.score(b" ..\n") == 0


def test_gradient_goes_down():
    rng = np.random.default_rng(0)
    labels = np.array([1.0] * 20 + [0.0] * 80)
    lengths = np.ones(100, dtype=np.int64)
    words = np.where(labels > 0, 0, rng.integers(1, 4, 100))
    bias, weights = toxicity.fit(labels, np.full(100, 3.0), np.arange(100), np.ones(100), lengths, words, 4)
    assert weights[0] + bias > 0 > bias


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (2, 1)], [(None, 1), (2, 0)]])
def test_no_usable_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not model.weights
    assert toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 3


def test_sample_is_bounded(spark):
    docs, labels = planted(200)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, *labels, (0, 0)], "doc_id long, toxic int")
    assert toxicity.train(*frames, sample=10) is not None
    # the sample is that of the smallest hashes, whatever the labels' order
    again = toxicity.train(frames[0], frames[1].orderBy(F.rand(3)), sample=100)
    assert again.weights == toxicity.train(*frames, sample=100).weights


def test_sentences_with_equal_words_count_as_often():
    """Fitting on repeated sentences and on one with a number is the same."""
    labels, calm = np.array([1.0, 0.0, 0.0]), np.array([2.0, 3.0, 1.0])
    one = toxicity.fit(labels, calm, np.array([0, 1, 2]), np.array([3.0, 1.0, 2.0]), np.array([1, 1, 2]), np.array([0, 1, 1, 2]), 3)
    many = toxicity.fit(labels, calm, np.array([0, 0, 0, 1, 2, 2]), np.ones(6), np.array([1, 1, 1, 1, 2, 2]), np.array([0, 0, 0, 1, 1, 2, 1, 2]), 3)
    assert np.allclose(one[1], many[1]) and one[0] == pytest.approx(many[0])


def plain_score(model, text):
    import re

    strong, faint = [0.0], [0.0]
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = set(re.findall(rb"[a-z0-9'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), sentence.encode())))
        if words:
            z = model.bias + sum(model.weights.get(w, 0.0) for w in words)
            p = 1 / (1 + np.exp(-z))
            (strong if p >= toxicity.FLOOR and z > model.bias else faint).append(p)
    return 1 - np.prod(1 - np.array(strong)) * (1 - max(faint))


def test_query_against_plain_version(spark):
    """Every score of a whole table, by a noisy-or in plain Python."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.query(spark, folder).collect()
    assert len(found) == len(texts) and model.weights
    for r in found:
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5)


def test_ties_long_texts_extra_columns_and_empty_tables(spark, tmp_path):
    docs, labels = planted(300)
    docs = [*docs, (900, "word1 vile. " + "word2 word3. " * 200_000), (901, "word2 word3. " * 200_000), (902, None), (902, None), (None, "vile vile. vile")]
    frame = spark.createDataFrame([(*d, "mine", 1) for d in docs], "doc_id long, text string, offending string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = toxicity.drop_toxic(frame, marks)
    assert kept.columns == frame.columns
    rows = {(r.doc_id, r.offending, r.score) for r in kept.collect()}
    assert (901, "mine", 1) in rows and (900, "mine", 1) not in rows and (902, "mine", 1) in rows and all(i is not None for i, _, _ in rows)
    assert kept.where("doc_id = 902").count() == 2
    model = toxicity.train(frame.select("doc_id", "text"), marks)
    spans = toxicity.offending(model, frame.where("doc_id = 900")).first()
    assert spans.offending == "mine" and [(s.start, s.end) for s in spans.offending_] == [(0, 11)]
    for name, kind in (("documents", "doc_id long, text string"), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert toxicity.query(spark, str(tmp_path)).count() == 0


def test_held_out_quality(spark):
    found = toxicity.query(spark, TABLES)
    assert found.count() == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col("toxic").cast("int").alias("toxic")).toPandas()
    bad, good = held[held.toxic == 1], held[held.toxic == 0]
    auc = np.mean([(g < b) + 0.5 * (g == b) for b in bad.score for g in good.score.sample(200, random_state=0)])
    assert auc > 0.8 and good.predicted.mean() < 0.05 and bad.predicted.mean() > 0.6
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
