"""Mixing against plain Python."""

import pytest
from pyspark.sql import functions as F

from quillsift.llm import mixing

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def check(rows, found):
    sizes, taken, target = {}, {}, {}
    size_of = {}
    for doc_id, text, source in rows:
        n = len("".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")) - "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ").count("")
        sizes[source] = sizes.get(source, 0) + n
        size_of[doc_id] = (n, source)
    want = plain_targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        n, source = size_of[r.doc_id]
        assert r.size == n and r.source_size == sizes[source] and r.target == pytest.approx(want[source], abs=1e-6)
        assert 0 <= r.taken <= 3 * n
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    for source, words in taken.items():
        assert abs(words - target[source]) <= 1
    # complete epochs first: within a source, what is taken differs by one copy at most
    for source in taken:
        rates = [r.taken // r.size for r in found if size_of[r.doc_id][1] == source and r.size]
        assert not rates or max(rates) - min(rates) <= 1


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(1000, "a\x0bb\x0cc d e", "tiny"), (1001, None, "void"), (1002, "", "void"), (1003, "x " * 5000, "s1")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(frame).collect()
    check(rows, found)
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=repr)


def test_better_documents_come_first(spark):
    rows = [(i, "a b c d", "small") for i in range(400)] + [(1000 + i, "a b", "large") for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    found = [r for r in mixing.mix(frame, weight=F.col("good"), weights=(1.0, 3.0)).collect()]
    extra = {parity: sum(r.taken % r.size == 0 and r.taken // r.size for r in found if r.doc_id % 2 == parity) for parity in (0, 1)}
    assert extra[0] > extra[1] * 1.1


def test_documents_of_the_mix(spark):
    rows = [(i, f"{i} " + "w " * (i % 5), f"s{i % 3}", "k") for i in range(200)] + [(3, "3 w w w ", "s0", "k"), (None, "x y", "s1", None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", taken string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    mixed = mixing.mixed_documents(frame, labels)
    assert mixed.columns == frame.columns
    known = set(map(tuple, frame.collect()))
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= known and len(got) > 150
    words = {}
    for r in got:
        words[r[2]] = words.get(r[2], 0) + len((r[1] or "").split())
    targets = plain_targets({s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in {r[2] for r in rows}})
    assert all(abs(words.get(s, 0) - t) <= 10 for s, t in targets.items())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")]])
def test_nothing_to_take(spark, rows):
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(r.taken == 0 and r.target == 0 for r in found)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, mixing.query(spark, TABLES).collect())


def test_columns_named_like_helpers(spark):
    names = ["__qs_key", "__qs_COPY", "__qs_copies", "identity", "x.y"]
    frame = spark.createDataFrame([(i, "a b c", f"s{i % 2}", *([f"mine{i}"] * len(names))) for i in range(40)], ["doc_id", "text", "source", *names])
    mixed = mixing.mixed_documents(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert mixed.columns == frame.columns
    got = {tuple(r) for r in mixed.collect()}
    assert got <= {tuple(r) for r in frame.collect()} and len(got) > 20


def test_rows_without_an_id_have_keys_of_their_own(spark):
    rows = [(None, f"a b {i}", "s") for i in range(50)] + [(None, None, "s")]
    frame = spark.createDataFrame(rows, SCHEMA)
    keys = frame.select(mixing.exponential_key(mixing.identity_of("doc_id", "text"), F.lit(1.0), "mix").alias("k")).distinct().count()
    assert keys == 51
    found = mixing.mix(frame).collect()
    assert len(found) == 51 and sum(r.taken for r in found) == 150
