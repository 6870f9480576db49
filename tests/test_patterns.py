"""Wildcards, class patterns and keyed tables against golden cases and plain Python."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillsift.functions import patterns
from quillsift.functions.patterns import CONTAINS, ENDS, EXACT, STARTS, Wildcard
from quillsift.operators.combine import change_base, combinations_of, generate_keys
from quillsift.operators.index import KeyIndex

FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"


def golden():
    out = []
    for line in FIXTURES.read_text().splitlines():
        m = re.match(r"\| \d+ \| (?:`(.+?)`|\(empty\)) \| `(.*?)` \| (ExactMatch|Contains) \| (\d+) \| (-?\d+) \|", line)
        if m:
            out.append((m[1] or "", m[2], EXACT if m[3] == "ExactMatch" else CONTAINS, int(m[4]), int(m[5])))
    return out


def test_golden_wildcards(spark):
    cases = golden()
    assert len(cases) == 102
    frame = spark.createDataFrame([(c[1],) for c in cases], "s string").coalesce(1)
    row = frame.distinct()
    texts = {r.s for r in row.collect()}
    columns = {f"m{i}": Wildcard(p, o).match(F.col("s")) for i, (p, _, o, _, _) in enumerate(cases)}
    columns |= {f"b{i}": Wildcard(p, o).is_match(F.col("s")) for i, (p, _, o, _, _) in enumerate(cases)}
    got = {r.s: r for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", *[c.alias(n) for n, c in columns.items()]).collect()}
    for i, (_, text, _, index, length) in enumerate(cases):
        m = got[text][f"m{i}"]
        assert (m["index"], m["length"]) == (index, length) and got[text][f"b{i}"] == (length >= 0)


def test_wildcard_parts():
    w = Wildcard("a*??*b?c_%!", STARTS)
    assert w.literal_runs() == ["a", "b", "c_%!"] and w.head() == "a"
    assert w.like() == "a%__b_c!_!%!!%"
    assert Wildcard("*a.b*", EXACT).to_regex() == r"^.*?a\.b.*$"
    assert Wildcard("it's?", CONTAINS).to_regex(sql=True) == "'it''s.'"
    assert Wildcard("**").everything and not Wildcard("").everything
    with pytest.raises(ValueError):
        Wildcard("a", "anywhere")


def test_matches_do_not_overlap(spark):
    frame = spark.createDataFrame([("aXbaYbab",), ("",), (None,)], "s string")
    rows = [r.m for r in frame.select(Wildcard("a?b", CONTAINS).matches(F.col("s")).alias("m")).collect()]
    assert [(m["index"], m["length"]) for m in rows[0]] == [(0, 3), (3, 3)] and rows[1] == []
    ends = frame.select(Wildcard("b", ENDS).is_match(F.col("s")).alias("m")).collect()
    assert [r.m for r in ends] == [True, False, None]


@pytest.mark.parametrize("bad", ["[a", "a]", "\\x", "[b-a]", "[[a]", "a\\", "[é]"])
def test_bad_class_patterns(bad):
    with pytest.raises(ValueError):
        patterns.parse_classes(bad)


def test_class_patterns():
    assert patterns.parse_classes("[a-c-]x") == [frozenset(b"abc-"), frozenset(b"x")]
    assert patterns.parse_classes(r"[\]\\-]\[") == [frozenset(b"]\\-"), frozenset(b"[")]
    assert patterns.parse_classes("[*][*a]") == [patterns.ANY, frozenset(b"*a")]
    assert patterns.parse_classes("[A-B-D]") == [frozenset(b"ABCD")]
    assert patterns.literal_head(patterns.parse_classes("ab[cd]e")) == "ab"


def test_queries_on_keys(spark):
    chance = random.Random(4)
    keys = sorted({"".join(chance.choice("abé") for _ in range(chance.randint(1, 6))) for _ in range(300)})
    index = KeyIndex(spark.createDataFrame(list(zip(keys, range(len(keys)))), "key string, value int"))

    def got(df):
        return sorted(r["key"] for r in df.select("key").collect())

    assert got(index.starts_with("ab")) == [k for k in keys if k.startswith("ab")] and got(index.starts_with("")) == keys
    assert got(index.wildcard("a?b")) == [k for k in keys if re.fullmatch(rb"a.b", k.encode(), re.S)]
    assert got(index.wildcard("a??", prefix=True)) == [k for k in keys if k.startswith("a")]
    assert got(index.classes("[ab][*]b")) == [k for k in keys if re.fullmatch(rb"[ab].b", k.encode(), re.S)]
    assert got(index.range("ab", "b")) == [k for k in keys if "ab" <= k <= "b"]
    assert got(index.range("ab", "b", False, False)) == [k for k in keys if "ab" < k < "b"]
    assert got(index.range_tree("aa", "bb")) == [k for k in keys if re.match(rb"[ab][ab]", k.encode())]
    with pytest.raises(ValueError):
        index.range("b", "a")
    assert got(index.leafs_in_path("abab")) == [k for k in keys if "abab".startswith(k)]
    for missing, extra in ((1, 1), (2, 0), (0, 3)):
        want = {}
        for k in keys:
            b = k.encode()
            cost = sum(x not in y for x, y in zip(b, (b"a", b"ab", b"b"))) + max(3 - len(b), 0) * missing + max(len(b) - 3, 0) * extra
            if cost <= 2:
                want[k] = cost
        assert {r["key"]: r["cost"] for r in index.near("a[ab]b", 2, missing, extra).collect()} == want
    probes = spark.createDataFrame([("a",), ("ba",), ("zz",)], "prefix string")
    assert {(r["prefix"], r["key"]) for r in index.starts_with_any(probes).collect()} == {(p, k) for p in ("a", "ba") for k in keys if k.startswith(p)}
    spans = [("a", "ab"), ("ab", "b"), ("b", "éa"), ("", "a"), ("z", "a")]
    bounds = spark.createDataFrame(spans, "start string, end string")
    assert sorted((r["start"], r["key"]) for r in index.ranges(bounds).collect()) == sorted((a, k) for a, b in spans for k in keys if a <= k <= b)


def test_shortest_unique(spark):
    keys = ["banana", "bandana", "bank", "beer", "brooklyn", "bee"]
    got = {r["key"]: r["unique_prefix"] for r in KeyIndex(spark.createDataFrame([(k,) for k in keys], "key string"), value=None).shortest_unique().collect()}
    assert got == {"banana": "bana", "bandana": "band", "bank": "bank", "beer": "beer", "bee": "bee", "brooklyn": "br"}


def test_mutations(spark, tmp_path):
    base = KeyIndex(spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"), check=True)
    more = spark.createDataFrame([("b", 9), ("c", 3)], "key string, value int")
    with pytest.raises(ValueError):
        base.add(more)
    with pytest.raises(ValueError):
        base.add(spark.createDataFrame([("", 9)], "key string, value int"))
    with pytest.raises(ValueError):
        KeyIndex(spark.createDataFrame([("a", 1), ("a", 2)], "key string, value int"), check=True)
    rows = lambda i: sorted(map(tuple, i.df.collect()))
    assert rows(base.try_add(more)[0]) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(base.upsert(more)) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(base.remove(more)) == [("a", 1)] and rows(base.clear()) == []
    assert rows(base.update(F.col("key") == "a", F.lit(5))) == [("a", 5), ("b", 2)]
    assert base["a"] == 1 and list(base) == [("a", 1), ("b", 2)]
    with pytest.raises(KeyError):
        base["z"]
    saved = base.save(str(tmp_path / "one"))
    assert rows(saved) == rows(base) == rows(saved.optimize(str(tmp_path / "two")))
    with pytest.raises(Exception, match="already exists"):
        base.save(str(tmp_path / "one"))


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "keys")
    KeyIndex(spark.createDataFrame(list(generate_keys(500)), "key string, value int")).save(path)
    index = KeyIndex(spark.read.parquet(path))

    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "StringStartsWith(key,ab)" in plan(index.starts_with("ab"))
    assert "StringStartsWith(key,ab)" in plan(index.wildcard("ab?d"))
    assert "GreaterThanOrEqual(key,a)" in plan(index.range("a", "b"))
    assert "In(key" in plan(index.leafs_in_path("abc"))
    assert "value" not in plan(index.starts_with("ab").select("key")).split("ReadSchema")[1].splitlines()[0]


def test_combinations_and_keys(spark):
    assert [tuple(r) for r in combinations_of(spark, a=[1, 2], b=["x", "y"]).collect()] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert change_base(27, "abcdefghijklmnopqrstuvwxyz") == "bb" and change_base(0, "ab") == "a"
    keys = dict(generate_keys(2000))
    assert len(keys) == 2000 and set(keys.values()) == set(range(2000))


def test_clean(spark):
    from quillsift.sources import snapshots

    before = spark.conf.get("spark.checkpoint.dir", None)
    table = snapshots.materialize(spark.range(3).toDF("n"), "numbers")
    assert table.count() == 3
    assert snapshots.shared_folder(spark).startswith(before or "file://")
    assert before is None or spark.conf.get("spark.checkpoint.dir") == before


def test_discard(spark):
    from quillsift.sources import snapshots

    kept, gone = (snapshots.materialize(spark.range(3).toDF("n"), name) for name in ("kept", "gone"))
    snapshots.discard(gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_shared_folder_must_be_set_on_a_cluster(spark):
    """A session without the setting: fine on one machine, an error on several, where executors have disks of their own."""
    from types import SimpleNamespace

    from quillsift.sources import snapshots

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert snapshots.shared_folder(session("local[4]")) == snapshots.shared_folder(session("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        snapshots.shared_folder(session("spark://somewhere:7077"))


def test_many_matches(spark):
    """Spans of thousands of matches, beyond one piece of a running state."""
    text = "ab-" * 5000 + "é" + "ab" * 700
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(Wildcard("ab", CONTAINS).matches(F.col("t")).alias("m")).collect()
    assert [(s["index"], s["length"]) for s in found[0].m] == [(m.start(), 2) for m in re.finditer("ab", text)]
    assert found[1].m == [] and not found[2].m
