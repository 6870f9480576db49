"""Exact dedup against plain Python."""

import hashlib

import pytest

from quillsift.llm import exact_dedup

TABLES = "/root/testdata/sf0.001"


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("share", [exact_dedup.HEAVY_SHARE, 0.2, 0.9])
def test_groups(spark, share):
    rows = [(i, "Hot") for i in range(50)] + [(100 + i, t) for i, t in enumerate(["a", "A", "b", "É", "é", "", None, "x" * 200_000, "X" * 200_000])] + [(None, "hot"), (None, None), (7, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.copy_groups(frame, share=share)
    assert got(found) == plain(rows)
    kept = [r for r in found.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({normal(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("share", [exact_dedup.HEAVY_SHARE, 0.9])
def test_rows_that_stay(spark, share):
    rows = [(i, "Hot", "s", i) for i in range(20)] + [(30, "hot", "s", 1), (30, "hot", "s", 1), (30, "HOT", "t", 2), (None, None, None, None), (None, "", None, None), (5, "x", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept int")
    kept = exact_dedup.drop_copies(frame, share=share)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [30, 5, None]


def test_all_ids_null(spark):
    frame = spark.createDataFrame([(None, "a"), (None, "A")], "doc_id long, text string")
    found = exact_dedup.copy_groups(frame).collect()
    assert [r.keep_id for r in found] == [None, None] and sum(r.kept for r in found) == 1


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.copy_groups(frame).count() == 0 and exact_dedup.drop_copies(frame).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    assert got(exact_dedup.query(spark, TABLES)) == plain(rows)


def test_columns_named_like_helpers(spark):
    names = ["__qs_text_digest", "__QS_best", "__qs_heavy", "__qs_top", "__qs_digest", "x.y"]
    frame = spark.createDataFrame([(i, "Same" if i < 3 else f"t{i}", *([f"mine{i}"] * len(names))) for i in range(6)], ["doc_id", "text", *names])
    for share in (exact_dedup.HEAVY_SHARE, 0.9):
        kept = exact_dedup.drop_copies(frame, share=share)
        assert kept.columns == frame.columns
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in frame.collect() if r.doc_id >= 2}
