"""Language identification: n-gram counts against plain Python, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import langid
from quillsift.llm.shared import crc_mod

TABLES = "/root/testdata/sf0.01"


def plain_counts(text):
    counts, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f"_{word}_"
            counts.update(word)
            for n in (2, 3):
                counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
            word = ""
    packed = {}
    for gram, n in counts.items():
        code = 0
        for c in gram:
            code = code << 21 | ord(c)
        packed[code] = n
    return packed


@pytest.mark.parametrize("dense", [langid.DENSE, 100])
@pytest.mark.parametrize("text", ["", "a", "Ab cd", "_ 3 _", "é1b ñ", "日本語 テキスト!", " x\n\nyz ", "a" * 5000, "the cat's hat 12 the"])
def test_gram_counts(monkeypatch, text, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    grams, counts = langid.gram_counts(text)
    assert dict(zip(grams.tolist(), counts.tolist())) == plain_counts(text)


def test_ranking_is_by_count_then_characters():
    assert langid.ranked(np.array([2, 5, 2, 9]), np.array([40, 10, 30, 20]), 3).tolist() == [3, 1, 2]


def test_out_of_place(spark):
    profiles = {"x": langid.gram_counts("aa aa ab")[0].tolist(), "y": langid.gram_counts("zz yy")[0].tolist()}
    identify = langid.Identifier(profiles)
    assert identify("aa")[0] == "x" and identify("ZZ y")[0] == "y"
    assert identify(None) == identify("") == identify("12 --") == identify("½² _") == ("und", 0.0)
    assert langid.Identifier({})("abc") == ("und", 0.0)


def test_held_out_accuracy(spark):
    found = langid.query(spark, TABLES)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert found.count() == docs.count()
    right = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    assert found.where(F.col("held_out") != (crc_mod(F.col("doc_id"), 4) == 2)).count() == 0


def test_training_leaves_out(spark):
    rows = [("aaa bbb", "x"), (None, "x"), ("ccc", None), ("zzz", "y")]
    profiles = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(profiles) == {"x", "y"} and ord("c") not in profiles["x"]
    assert langid.train(spark.createDataFrame([], "text string, lang string")) == {}


def plain_prediction(profiles, text):
    """Out-of-place distances by dictionaries."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts = plain_counts(text)
    top = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
    apart = {lang: sum(abs(ranks[g] - i) if g in ranks else langid.PROFILE for i, g in enumerate(top)) for lang, ranks in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (langid.PROFILE * len(top))


def test_query_against_plain_version(spark):
    """Every prediction of a whole table, with profiles learned in plain Python too."""
    import zlib

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    learned = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(plain_counts(r.text))
    profiles = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE])} for lang, c in learned.items()}
    assert {lang: {g: i for i, g in enumerate(top)} for lang, top in langid.train(spark.createDataFrame([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2], "text string, lang string")).items()} == profiles
    texts = {r.doc_id: r.text for r in rows}
    found = langid.query(spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        lang, score = plain_prediction(profiles, texts[r.doc_id])
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-12))


def test_long_texts_are_cut_between_words(monkeypatch, spark):
    monkeypatch.setattr(langid, "CHUNK", 64)
    texts = ["", "ab " * 100, "x" * 500, "é1ñ " * 40 + "y" * 200 + " zz", "word, " * 11 + "longer"]
    for text in texts:
        pieces = list(langid.whole_words(text))
        assert "".join(pieces) == text and sum((Counter(plain_counts(p)) for p in pieces), Counter()) == Counter(plain_counts(text))
    long = "der die das und " * 200_000
    model = langid.Identifier({"de": langid.gram_counts("der die das und")[0].tolist()})
    assert model(long)[0] == "de"


def test_ties_repeated_rows_extra_columns_and_empty_tables(spark, tmp_path):
    rows = [(0, "aaa", "x", "c"), (4, "aaa", "w", "c"), (4, "aaa", "w", "c"), (7, None, "x", "c"), (None, "aaa", None, "c"), (8, "12", "x", "c")]
    for name, kept in (("some", rows), ("none", [])):
        spark.createDataFrame(kept, "doc_id long, text string, lang string, found string").write.parquet(str(tmp_path / name / "documents.parquet"))
    found = langid.query(spark, str(tmp_path / "some")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred) for r in found) == [(-1, "w"), (0, "w"), (4, "w"), (4, "w"), (7, "und"), (8, "und")]
    assert langid.query(spark, str(tmp_path / "none")).count() == 0
