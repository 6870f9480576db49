"""Each operator as a query over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import characters, fuzzy, fuzzy_udf, patterns, strings
from ..operators import cache, combine, ordered, suggest, topk
from ..operators.index import KeyIndex
from ..operators.ngram import NGramIndex
from ..shipping import shipped
from . import sqltext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = shipped(f)
        if sql:
            ORACLES[name] = sql
        return f

    return add


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _customers(spark, sf_dir) -> KeyIndex:
    return KeyIndex(Tables(spark, sf_dir).customer, "c_name", "c_custkey")


def _parts(spark, sf_dir) -> KeyIndex:
    return KeyIndex(Tables(spark, sf_dir).part, "p_name", "p_partkey")


def _names(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).part.select(F.col("p_name").alias("v")).distinct()


def _kv(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("k"), F.col("value").alias("v"))


NAMES = "(select distinct p_name from part)"

# ---- scans

@query("a01_load", "select c_name k, c_custkey v, c_nationkey n from customer")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select(F.col("c_name").alias("k"), F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("n"))


@query("a01b_create", "select c_name k, c_custkey v from customer")
def _(spark, sf_dir):

    from ..sources.snapshots import shared_folder

    return _kv(_customers(spark, sf_dir).save(f"{shared_folder(spark)}/{uuid4().hex}/customers").df)


@query("a02_keys", "select c_name k from customer")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).keys().select(F.col("key").alias("k"))


@query("a03_values", "select c_custkey v from customer")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).values().select(F.col("value").alias("v"))


@query("a04_items", "select c_name k, c_custkey v from customer")
def _(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).items())


@query("a42_count", "select least(count(*), 2147483647) n, count(*) l from customer")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).count().select(F.col("count").alias("n"), F.col("long_count").alias("l"))


@query("a44_prefix_counts", f"select left(p_name, n) k, count(*) c from {NAMES}, range(1, 30) t(n) where n <= length(p_name) group by 1")
def _(spark, sf_dir):
    return KeyIndex(_names(spark, sf_dir), "v", None).prefix_counts().select(F.col("prefix").alias("k"), F.col("keys").alias("c"))


@query("a44o_visits", f"with p as (select distinct left(p_name, n) k from {NAMES}, range(1, 100) t(n) where n <= length(p_name)) select k, row_number() over (order by k) - 1 d, row_number() over (order by length(k), k) - 1 b from p")
def _(spark, sf_dir):
    found = KeyIndex(_names(spark, sf_dir), "v", None).visits()
    return found.select(F.col("prefix").alias("k"), F.col("depth_first").alias("d"), F.col("breadth_first").alias("b"))


@query("k02_append", "select c_name k from customer union all select s_name k from supplier")
def _(spark, sf_dir):
    from ..sources.snapshots import append

    t = Tables(spark, sf_dir)
    return append(t.customer.select(F.col("c_name").alias("k")), t.supplier.select(F.col("s_name").alias("k")))


# ---- lookups

@query("a05_get", "select c_name k, c_custkey v from customer where c_name = 'Customer#000000007'")
def _(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).get("Customer#000000007"))


@query("a14_try_get_value", "select q.k, c.c_custkey v, c.c_custkey is not null found from (values ('Customer#000000007'),('absent')) q(k) left join customer c on c.c_name = q.k")
def _(spark, sf_dir):
    probes = spark.createDataFrame([("Customer#000000007",), ("absent",)], "k string")
    return _customers(spark, sf_dir).try_get(probes, "k").select("k", F.col("value").alias("v"), "found")


@query("a15_contains_key", "select c_name k from customer where c_custkey in (select o_custkey from orders)")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return KeyIndex(t.orders, "o_custkey", None).contains_key(t.customer, "c_custkey").select(F.col("c_name").alias("k"))


@query("a16_contains_pair", "select c_name k, c_custkey v from customer where c_custkey % 2 = 0")
def _(spark, sf_dir):
    probes = Tables(spark, sf_dir).customer.select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-1).alias("value"))
    return _kv(_customers(spark, sf_dir).contains(probes))


@query("a06_minimum_key", "select min(c_name) k from customer")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).minimum().select(F.col("key").alias("k"))


@query("a07_maximum_key", "select max(c_name) k from customer")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).maximum().select(F.col("key").alias("k"))


def _path_index(spark, sf_dir) -> KeyIndex:
    heads = _names(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("v")), lambda n: F.substring(F.col("v"), F.lit(1), n))).alias("key"))
    return KeyIndex(heads.distinct().withColumn("value", F.length("key")))


@query("a35_leafs_in_path", "select distinct left(p_name, n) k from part, range(1, 100) t(n) where starts_with('blue gear', left(p_name, n))")
def _(spark, sf_dir):
    return _path_index(spark, sf_dir).leafs_in_path("blue gear").select(F.col("key").alias("k"))


@query("a36_leafs_in_path", "select distinct length(left(p_name, n)) v from part, range(1, 100) t(n) where starts_with('blue gear', left(p_name, n))")
def _(spark, sf_dir):
    return _path_index(spark, sf_dir).leafs_in_path("blue gear").select(F.col("value").cast("long").alias("v"))


@query("a37_leafs_in_paths", f"select distinct p.p_name p, left(q.p_name, n) k, length(left(q.p_name, n)) v from {NAMES} p, {NAMES} q, range(1, 100) t(n) where starts_with(p.p_name, left(q.p_name, n))")
def _(spark, sf_dir):
    return _path_index(spark, sf_dir).leafs_in_paths(_names(spark, sf_dir), "v").select(F.col("v").alias("p"), F.col("key").alias("k"), F.col("value").cast("long").alias("v"))


_LCP = "len(list_filter(range(1, length(k) + 1), lambda i: starts_with(coalesce({0}, ''), left(k, i))))"


@query("a39_shortest_unique", f"with k as (select distinct p_name k from part), n as (select k, lag(k) over (order by k) p, lead(k) over (order by k) x from k) select k, left(k, least(length(k), 1 + greatest({_LCP.format('p')}, {_LCP.format('x')}))::int) u from n")
def _(spark, sf_dir):
    return KeyIndex(_names(spark, sf_dir), "v", None).shortest_unique().select(F.col("key").alias("k"), F.col("unique_prefix").alias("u"))


# ---- mutations

@query("a08_add", "select c_name k, c_custkey v from customer union all select s_name, s_suppkey from supplier")
def _(spark, sf_dir):
    new = Tables(spark, sf_dir).supplier.select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("value"))
    return _kv(_customers(spark, sf_dir).add(new).df)


@query("a09_add_range", "select n_name k, n_nationkey v from nation union all select r_name, r_regionkey from region")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    index = KeyIndex(t.nation, "n_name", "n_nationkey", check=True)
    return _kv(index.add_range(t.region.select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("value"))).df)


@query("a11_remove_keys", "select s_name k, s_suppkey v from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gone = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_name").alias("key"))
    return _kv(KeyIndex(t.supplier, "s_name", "s_suppkey").remove_range(gone).df)


@query("a10_remove_range", "select c_name k, c_custkey v from customer where c_nationkey <> 3")
def _(spark, sf_dir):
    gone = Tables(spark, sf_dir).customer.where("c_nationkey = 3").select(F.col("c_name").alias("key"))
    return _kv(_customers(spark, sf_dir).remove(gone).df)


@query("a12_clear", "select c_name k, c_custkey v from customer where false")
def _(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).clear().df)


@query("a13_try_add", "select s_name k, s_suppkey v from supplier")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.supplier.select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("value")).unionByName(t.customer.select(F.col("c_name").alias("key"), F.lit(0).cast("long").alias("value")))
    return _kv(_customers(spark, sf_dir).try_add(rows)[1])


@query("a17_upsert", "select c_name k, case when c_custkey % 10 = 0 then -c_custkey else c_custkey end v from customer")
def _(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.where("c_custkey % 10 = 0").select(F.col("c_name").alias("key"), (-F.col("c_custkey")).alias("value"))
    return _kv(_customers(spark, sf_dir).upsert(rows).df)


@query("a18_set_value", "select c_name k, case when c_custkey = 7 then 0 else c_custkey end v from customer")
def _(spark, sf_dir):
    row = spark.createDataFrame([("Customer#000000007", 0)], "key string, value long")
    return _kv(_customers(spark, sf_dir).set_value(row).df)


@query("a38_optimize", "select c_name k, c_custkey v from customer")
def _(spark, sf_dir):
    from ..sources.snapshots import shared_folder

    return _kv(_customers(spark, sf_dir).optimize(f"{shared_folder(spark)}/{uuid4().hex}/optimized").df)


# ---- prefixes, patterns, ranges

@query("a19_starts_with", "select c_name k from customer where starts_with(c_name, 'Customer#00000001')")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).starts_with("Customer#00000001").select(F.col("key").alias("k"))


@query("a20_starts_with_values", "select c_custkey v from customer where starts_with(c_name, 'Customer#00000001')")
def _(spark, sf_dir):
    return _customers(spark, sf_dir).starts_with("Customer#00000001").select(F.col("value").alias("v"))


@query("a21_starts_with_items", "select c_name k, c_custkey v from customer where starts_with(c_name, 'Customer#00000001')")
def _(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).starts_with("Customer#00000001"))


@query("a21b_starts_with_any", "select p.x p, c_name k, c_custkey v from customer, (values ('Customer#00000001'), ('Customer#0000000'), ('Customer#000000123'), ('none')) p(x) where starts_with(c_name, p.x)")
def _(spark, sf_dir):
    probes = spark.createDataFrame([("Customer#00000001",), ("Customer#0000000",), ("Customer#000000123",), ("none",)], "p string")
    return _customers(spark, sf_dir).starts_with_any(probes, "p").select("p", F.col("key").alias("k"), F.col("value").alias("v"))


@query("a22_wildcard", "select p_name k from part where p_name like 'blue ____'")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).wildcard("blue ????").select(F.col("key").alias("k"))


@query("a23_wildcard_values", "select p_partkey v from part where p_name like 'blue ____'")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).wildcard("blue ????").select(F.col("value").alias("v"))


@query("a24_wildcard_items", "select p_name k, p_partkey v from part where p_name like 'blue ____'")
def _(spark, sf_dir):
    return _kv(_parts(spark, sf_dir).wildcard("blue ????"))


@query("a24s_wildcard_prefix", "select p_name k, p_partkey v from part where p_name like 'b_ue%'")
def _(spark, sf_dir):
    return _kv(_parts(spark, sf_dir).wildcard("b?ue", prefix=True))


def _brands(spark, sf_dir) -> KeyIndex:
    return KeyIndex(Tables(spark, sf_dir).part, "p_brand", "p_partkey")


@query("a25_regexp", "select p_brand k from part where regexp_full_match(p_brand, 'Brand#[1-3]')")
def _(spark, sf_dir):
    return _brands(spark, sf_dir).classes("Brand#[1-3]").select(F.col("key").alias("k"))


@query("a26_regexp_values", "select p_partkey v from part where regexp_full_match(p_brand, 'Brand#[1-3]')")
def _(spark, sf_dir):
    return _brands(spark, sf_dir).classes("Brand#[1-3]").select(F.col("value").alias("v"))


@query("a27_regexp_items", "select p_brand k, p_partkey v from part where regexp_full_match(p_brand, 'Brand#[1-3]')")
def _(spark, sf_dir):
    return _kv(_brands(spark, sf_dir).classes("Brand#[1-3]"))


_COST = "len(list_filter(range(1, least(length(p_name), 9) + 1), lambda i: substr(p_name, i, 1) <> substr('blue gear', i, 1))) + abs(length(p_name) - 9)"


@query("a28_near_keys", f"select distinct p_name k from part where {_COST} <= 4")
def _(spark, sf_dir):
    return KeyIndex(_names(spark, sf_dir), "v", None).near("blue gear", 4).select(F.col("key").alias("k"))


@query("a29_near_values", f"select p_partkey v from part where {_COST} <= 4")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).near("blue gear", 4).select(F.col("value").alias("v"))


@query("a30_near_neighbors", f"select distinct p_name k, {_COST} h from part where {_COST} <= 4")
def _(spark, sf_dir):
    return KeyIndex(_names(spark, sf_dir), "v", None).near("blue gear", 4).select(F.col("key").alias("k"), F.col("cost").cast("long").alias("h"))


@query("a31_range", "select p_name k from part where p_name between 'blue gear' and 'cold bolt'")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).range("blue gear", "cold bolt").select(F.col("key").alias("k"))


@query("a32_range_values", "select p_partkey v from part where p_name between 'blue gear' and 'cold bolt'")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).range("blue gear", "cold bolt").select(F.col("value").alias("v"))


@query("a33_range_items", "select p_name k, p_partkey v from part where p_name between 'blue gear' and 'cold bolt'")
def _(spark, sf_dir):
    return _kv(_parts(spark, sf_dir).range("blue gear", "cold bolt"))


@query("a34_range_tree", "select p_name k, p_partkey v from part where regexp_matches(p_name, '(?s)^[b-c][l-o][l-u]')")
def _(spark, sf_dir):
    return _kv(_parts(spark, sf_dir).range_tree("bll", "cou"))


@query("a43_filter_cost", "select p_name k, p_partkey v, 2 - abs(length(p_name) - 10) l from part where abs(length(p_name) - 10) <= 2")
def _(spark, sf_dir):
    found = _parts(spark, sf_dir).filter_cost(lambda keys: (keys.str.len() - 10).abs(), 2)
    return found.select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("left_over").alias("l"))


# ---- wildcard matcher

def _pages(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).pages


@query("b01_compiled", "select page_id from pages where url like 'http_://%-%'")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).where(patterns.Wildcard("http?://*-*").is_match(F.col("url"))).select("page_id")


@query("b02_is_match", "select page_id from pages where url like '%://%.example.org/%'")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).where(patterns.Wildcard("*://*.example.org/*").is_match(F.col("url"))).select("page_id")


@query("b03_match", "select page_id, strpos(url, regexp_extract(url, '(?s)e.*g')) - 1 i, length(regexp_extract(url, '(?s)e.*g')) n from pages where regexp_matches(url, '(?s)e.*g')")
def _(spark, sf_dir):
    found = _pages(spark, sf_dir).select("page_id", patterns.Wildcard("e*g", patterns.CONTAINS).match(F.col("url")).alias("m"))
    return found.where("m.length >= 0").select("page_id", F.col("m.index").cast("long").alias("i"), F.col("m.length").cast("long").alias("n"))


@query("b04_matches", "select page_id, len(regexp_extract_all(url, '(?s)e.')) n from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.size(patterns.Wildcard("e?", patterns.CONTAINS).matches(F.col("url"))).cast("long").alias("n"))


@query("b05_to_regex", "select page_id from pages where regexp_matches(url, '^http.*?e.a')")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).where(F.regexp_like("url", F.lit(patterns.Wildcard("http*e?a", patterns.STARTS).to_regex()))).select("page_id")


@query("b06_sql_regex", f"select page_id from pages where regexp_matches(url, {patterns.Wildcard('http*e?a', patterns.STARTS).to_regex(sql=True)})")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).where(f"url rlike r{patterns.Wildcard('http*e?a', patterns.STARTS).to_regex(sql=True)}").select("page_id")


@query("b07_search_options", "select page_id, url like 'https%' s, url like '%html' e, contains(url, 'example') c, url = 'x' x from pages")
def _(spark, sf_dir):
    url = F.col("url")
    options = {"s": ("https", patterns.STARTS), "e": ("html", patterns.ENDS), "c": ("example", patterns.CONTAINS), "x": ("x", patterns.EXACT)}
    return _pages(spark, sf_dir).select("page_id", *[patterns.Wildcard(p, o).is_match(url).alias(name) for name, (p, o) in options.items()])


# ---- n-grams

_TOKENS = "(select distinct w from (select unnest(string_split_regex(lower(text), '[^a-z]+')) w from documents) where w <> '')"

def _ngrams(spark, sf_dir) -> NGramIndex:
    return NGramIndex.build(_names(spark, sf_dir), "v", 2, 3)


_GRAMS = f"select p_name v, substr(p_name, i::int + 1, n::int) g, i from {NAMES}, range(2, 4) a(n), range(0, 40) b(i) where i + n <= length(p_name)"


@query("c02_items", f"select p_name v from {NAMES}")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).items.select(F.col("value").alias("v"))


@query("c03_ngrams", _GRAMS)
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).postings.select(F.col("value").alias("v"), F.col("gram").alias("g"), F.col("start").cast("long").alias("i"))


@query("c04_remove", f"select v, count(*) n from ({_GRAMS}) where not starts_with(v, 'blue') group by 1")
def _(spark, sf_dir):
    left = _ngrams(spark, sf_dir).remove(_names(spark, sf_dir).where(F.col("v").startswith("blue")), "v")
    return left.postings.groupBy(F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("c05_contains", "select p_partkey k from part where p_name in (select p_name from part)")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).contains(Tables(spark, sf_dir).part, "p_name").select(F.col("p_partkey").alias("k"))


@query("c06_search_contains", "select distinct p_name v from part where p_name like '%l_ _i%'")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).search("l? ?i").select(F.col("value").alias("v"))


@query("c06x_search_exact", "select distinct p_name v from part where p_name like 'b%gear'")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).search("b*gear", patterns.EXACT).select(F.col("value").alias("v"))


@query("c06b_search_all", f"select q.x p, p_name v from {NAMES}, (values ('lue'), ('ear'), ('o'), ('old b'), ('zz')) q(x) where contains(p_name, q.x)")
def _(spark, sf_dir):
    probes = spark.createDataFrame([("lue",), ("ear",), ("o",), ("old b",), ("zz",)], "pattern string")
    return _ngrams(spark, sf_dir).search_all(probes).select(F.col("pattern").alias("p"), F.col("value").alias("v"))


@query("c10_search_rarest", f"select w from {_TOKENS} where contains(w, 'ation') and contains(w, 'the')")
def _(spark, sf_dir):
    index = NGramIndex.build(_tokens(spark, sf_dir), "w", 3, 3)
    return index.search("the*ation", most=2).unionByName(index.search("ation*the", most=2)).select(F.col("value").alias("w")).distinct()


@query("c08_ngram_stats", f"select length(g) n, count(*) c, count(distinct g) u from ({_GRAMS}) group by 1")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).stats().select(F.col("n").cast("long").alias("n"), F.col("postings").alias("c"), F.col("grams").alias("u"))


@query("c08l_lengths", f"select length(p_name) n, count(*) c from {NAMES} group by 1")
def _(spark, sf_dir):
    return _ngrams(spark, sf_dir).lengths().select(F.col("length").cast("long").alias("n"), F.col("items").alias("c"))




@query("c06d_search_tokens", f"select w from {_TOKENS} where w like '%tion_e%'")
def _(spark, sf_dir):
    return NGramIndex.build(_tokens(spark, sf_dir), "w", 2, 3).search("tion?e").select(F.col("value").alias("w"))


# ---- fuzzy functions

def _pairs(spark, sf_dir) -> DataFrame:
    """All pairs of the 64 part names, which are the result of these queries."""
    names = _names(spark, sf_dir)
    return combine.combinations(names.select(F.col("v").alias("x")), names.select(F.col("v").alias("y"))).where("x < y")


_PAIRS = "(select a.p_name x, b.p_name y from (select distinct p_name from part) a join (select distinct p_name from part) b on a.p_name < b.p_name)"
_BIGRAMS = "select p_name w, substr(p_name, i::int, 2) g, count(*) c from (select distinct p_name from part), range(1, 60) r(i) where i < length(p_name) group by all"


@query("e01_dice_pairs", f"with b as ({_BIGRAMS}), c as (select a.w x, b.w y, sum(least(a.c, b.c)) n from b a join b on a.g = b.g and a.w < b.w group by all) select x, y, round(2.0 * n / (length(x) + length(y) - 2), 6) s from c")
def _(spark, sf_dir):
    return fuzzy.dice_pairs(_names(spark, sf_dir), "v").select("x", "y", F.round("score", 6).alias("s"))


@query("e01s_dice", f"with b as ({_BIGRAMS}), c as (select a.w x, b.w y, sum(least(a.c, b.c)) n from b a join b on a.g = b.g and a.w < b.w group by all) select p.x, p.y, round(2.0 * coalesce(n, 0) / (length(p.x) + length(p.y) - 2), 6) s from {_PAIRS} p left join c using (x, y)")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy.dice(F.col("x"), F.col("y")), 6).alias("s"))


_FILTERED = _BIGRAMS.replace("where i < length(p_name)", "where i < length(p_name) and regexp_full_match(substr(p_name, i::int, 2), '[a-zA-Z0-9]{2}')")


@query("e02_dice_filtered", f"with b as ({_FILTERED}), t as (select w, sum(c) n from b group by 1), c as (select a.w x, b.w y, sum(least(a.c, b.c)) n from b a join b on a.g = b.g and a.w < b.w group by all) select p.x, p.y, round(2.0 * coalesce(c.n, 0) / (tx.n + ty.n), 6) s from {_PAIRS} p left join c using (x, y) join t tx on tx.w = p.x join t ty on ty.w = p.y")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy.dice(F.col("x"), F.col("y"), fuzzy.ALPHANUMERIC), 6).alias("s"))


@query("e03_levenshtein_pairs", f"select x, y, levenshtein(x, y) n from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy.levenshtein(F.col("x"), F.col("y")).cast("long").alias("n"))


@query("e04_levenshtein_slices", f"select x, y, levenshtein(substr(x, 2, 4), substr(y, 3, 5)) n from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy.levenshtein_slice(F.col("x"), 1, 4, F.col("y"), 2, 5).cast("long").alias("n"))


@query("e05_osa_within_1", f"select x, y from {_PAIRS} where levenshtein(x, y) <= 1 or (length(x) = length(y) and len(list_filter(range(1, length(x)), lambda i: concat(left(x, i::int - 1), substr(x, i::int + 1, 1), substr(x, i::int, 1), substr(x, i::int + 2)) = y)) > 0)")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).where(fuzzy.one_edit_or_swap(F.col("x"), F.col("y")))


@query("e05_osa", sqltext.edit_distance(_PAIRS))
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy_udf.osa(F.col("x"), F.col("y")).alias("d"))


@query("e06_levenshtein_max", f"select x, y, least(levenshtein(x, y), 4) n from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy.levenshtein(F.col("x"), F.col("y"), 4).cast("long").alias("n"))


@query("e07_weighted", f"select x, y, 0.5::double * levenshtein(x, y) d from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy_udf.weighted(F.col("x"), F.col("y"), 0.5, 0.5, 0.5).alias("d"))


@query("e08_weighted_slices", f"select x, y, 2.0::double * levenshtein(left(x, 4), left(y, 4)) d from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy_udf.weighted_slice(F.col("x"), 0, 4, F.col("y"), 0, 4, insert=2, delete=2, substitute=2.0).alias("d"))


_UNEVEN = {"insert": 2.0, "delete": 0.5}


@query("e07a_asymmetric", sqltext.edit_distance(_PAIRS, "1.5", **_UNEVEN, swap=False, corrected=True))
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy_udf.weighted(F.col("x"), F.col("y"), **_UNEVEN, substitute=1.5, corrected=True).alias("d"))


@query("e07k_asymmetric_kept", sqltext.edit_distance(_PAIRS, "1.5", **_UNEVEN, swap=False))
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", fuzzy_udf.weighted(F.col("x"), F.col("y"), **_UNEVEN, substitute=1.5).alias("d"))


_VOWELS = "case when contains('aeiou', @a) and contains('aeiou', @b) then 0.25::double else 1.0::double end"


@query("e03c_cost_function", sqltext.edit_distance(_PAIRS, _VOWELS, swap=False))
def _(spark, sf_dir):
    near = fuzzy_udf.weighted(F.col("x"), F.col("y"), substitute=lambda x, y: 0.25 if x in "aeiou" and y in "aeiou" else 1.0)
    return _pairs(spark, sf_dir).select("x", "y", near.alias("d"))


_SLICES = f"(select distinct substr(x, 2, 6) x, substr(y, 3, 5) y from {_PAIRS})"


@query("e08a_asymmetric_slices", sqltext.edit_distance(_SLICES, _VOWELS, **_UNEVEN, corrected=True))
def _(spark, sf_dir):
    cost = lambda x, y: 0.25 if x in "aeiou" and y in "aeiou" else 1.0
    found = fuzzy_udf.weighted_slice(F.col("x"), 1, 6, F.col("y"), 2, 5, **_UNEVEN, substitute=cost, swap=1, corrected=True)
    return _pairs(spark, sf_dir).select(F.substring("x", 2, 6).alias("x"), F.substring("y", 3, 5).alias("y"), found.alias("d")).distinct()


def _letters(spark) -> DataFrame:
    letters = spark.createDataFrame([(c,) for c in "abcdexyzABCDEXYZ0158;:é"], "c string")
    return combine.combinations(letters.select(F.col("c").alias("a")), letters.select(F.col("c").alias("b")))


_LETTERS = "(select a, b from (select unnest(string_split('abcdexyzABCDEXYZ0158;:é', '')) a) cross join (select unnest(string_split('abcdexyzABCDEXYZ0158;:é', '')) b))"


@query("e09_visual", f"select l.a, l.b, case when l.a = l.b then 1.0::double else round(v, 6) end s from {_LETTERS} l left join {sqltext.values(characters.visual_table())} t(x, y, v) on x = least(l.a, l.b) and y = greatest(l.a, l.b)")
def _(spark, sf_dir):
    return _letters(spark).select("a", "b", F.round(fuzzy.visual_similarity(F.col("a"), F.col("b")), 6).alias("s"))


@query("e10_alike", f"select l.a, l.b, l.a = l.b or v is not null s from {_LETTERS} l left join {sqltext.values({p: 1 for p in characters.alike_pairs()})} t(x, y, v) on x = least(l.a, l.b) and y = greatest(l.a, l.b)")
def _(spark, sf_dir):
    return _letters(spark).select("a", "b", fuzzy.looks_alike(F.col("a"), F.col("b")).alias("s"))


_KEYS = f"{sqltext.values(characters.keyboard_table())} t(x, y, v)"


@query("e11_key_distance", f"select l.a, l.b, round(case when lower(l.a) = lower(l.b) then 0.0::double else coalesce(v, 1.0::double) end, 6) s from {_LETTERS} l left join {_KEYS} on x = least(lower(l.a), lower(l.b)) and y = greatest(lower(l.a), lower(l.b))")
def _(spark, sf_dir):
    return _letters(spark).select("a", "b", F.round(fuzzy.key_distance(F.col("a"), F.col("b")), 6).alias("s"))


_REACH = repr(characters.keyboard_reach())
_TYPED = f"(select p.x, p.y, sum(case when substr(p.x, i::int, 1) = substr(p.y, i::int, 1) then 0.0::double else coalesce(v, 1.0::double) end) + any_value(abs(length(p.x) - length(p.y))) * {_REACH}::double d from {_PAIRS} p join range(1, 60) r(i) on i <= least(length(p.x), length(p.y)) left join {_KEYS} on t.x = least(substr(p.x, i::int, 1), substr(p.y, i::int, 1)) and t.y = greatest(substr(p.x, i::int, 1), substr(p.y, i::int, 1)) group by p.x, p.y)"


@query("e12_keyboard_distance", f"select x, y, round(d, 6) s from {_TYPED}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy.keyboard_distance(F.col("x"), F.col("y")), 6).alias("s"))


@query("e13_keyboard_similarity", f"select x, y, round(1 - d / (greatest(length(x), length(y)) * {_REACH}), 6) s from {_TYPED}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy.keyboard_similarity(F.col("x"), F.col("y")), 6).alias("s"))


@query("e14_key_similarity", f"select l.a, l.b, round(1 - case when lower(l.a) = lower(l.b) then 0.0 else coalesce(v, 1.0) end / {_REACH}, 6) s from {_LETTERS} l left join {_KEYS} on x = least(lower(l.a), lower(l.b)) and y = greatest(lower(l.a), lower(l.b))")
def _(spark, sf_dir):
    return _letters(spark).select("a", "b", F.round(fuzzy.key_similarity(F.col("a"), F.col("b")), 6).alias("s"))


_COMBINED = sqltext.edit_distance(_PAIRS, sqltext.combined_cost())
_DICE = f"with b as ({_BIGRAMS}), c as (select a.w x, b.w y, sum(least(a.c, b.c)) n from b a join b on a.g = b.g and a.w < b.w group by all)"


@query("e15_combined_distance", f"select x, y, round(d, 6) d from ({_COMBINED})")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy_udf.combined_distance(F.col("x"), F.col("y")), 6).alias("d"))


@query("e16_combined_similarity", f"{_DICE} select e.x, e.y, round(2.0::double * coalesce(n, 0) / (length(e.x) + length(e.y) - 2) * (2 - 2 / (1 + exp(-d))), 6) s from ({_COMBINED}) e left join c using (x, y)")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy_udf.combined_similarity(F.col("x"), F.col("y")), 6).alias("s"))


@query("e17_remove_diacritics", "select doc_id, md5(strip_accents(text)) t from documents")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(fuzzy.strip_diacritics(F.col("text"))).alias("t"))


@query("e18_normalize", "select distinct source, lower(strip_accents(trim(source))) u from documents")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("source", fuzzy.normalize(F.col("source")).alias("u")).distinct()


@query("e19_stable_hash", "select distinct p_name k, case when h >= 2147483648 then h - 4294967296 else h end h from (select p_name, list_reduce(list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint), lambda h, c: ((xor(h, c)) * 16777619) & 4294967295, 2166136261::bigint) h from part)")
def _(spark, sf_dir):
    return _names(spark, sf_dir).select(F.col("v").alias("k"), fuzzy.stable_hash(F.col("v")).alias("h"))


@query("e20_softmax", "select vec_id, i::bigint i, round(exp(v[i::int] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) s from (select vec_id, embedding::double[] v from embeddings), range(1, 65) r(i)")
def _(spark, sf_dir):
    scaled = Tables(spark, sf_dir).embeddings.select("vec_id", F.posexplode(fuzzy.softmax(F.col("embedding").cast("array<double>"))))
    return scaled.select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.round("col", 6).alias("s"))


@query("e21_distance_similarity", f"select x, y, round(2 - 2 / (1 + exp(-levenshtein(x, y)::double)), 6) s from {_PAIRS}")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("x", "y", F.round(fuzzy.distance_to_similarity(fuzzy.levenshtein(F.col("x"), F.col("y")).cast("double")), 6).alias("s"))


@query("e22_sigmoid", "select c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) s from customer")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select("c_custkey", F.round(fuzzy.sigmoid(F.col("c_acctbal") / 1000), 6).alias("s"))


@query("e23_min_max_scale", "select vec_id, i::bigint i, round((v[i::int] - list_min(v)) / (list_max(v) - list_min(v)), 6) s from (select vec_id, embedding::double[] v from embeddings), range(1, 65) r(i)")
def _(spark, sf_dir):
    scaled = Tables(spark, sf_dir).embeddings.select("vec_id", F.posexplode(fuzzy.min_max(F.col("embedding").cast("array<double>"))))
    return scaled.select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.round("col", 6).alias("s"))


@query("e24_min_max_matrix", "select c_custkey, round((c_acctbal - lo) / (hi - lo), 6) s from customer, (select min(c_acctbal) lo, max(c_acctbal) hi from customer)")
def _(spark, sf_dir):
    customer = Tables(spark, sf_dir).customer
    extremes = customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))  # one row
    return customer.crossJoin(F.broadcast(extremes)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("s"))


# ---- suggestions

def _tokens(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()


_WORDS = "(select distinct w from (select unnest(string_split_regex(lower(text), '[^a-z]+')) w from documents) where w <> '')"


@query("f02_deletes_d1", f"select distinct w, concat(left(w, i::int - 1), substr(w, i::int + 1)) v from {_WORDS}, range(1, 1000) r(i) where i <= length(w) and length(w) > 1 union select w, w from {_WORDS}")
def _(spark, sf_dir):
    return suggest.Suggestor.build(_tokens(spark, sf_dir), "w", 1).postings.select(F.col("value").alias("w"), F.col("variant").alias("v"))


@query("f03_remove", f"select w from {_WORDS} where w >= 'c'")
def _(spark, sf_dir):
    index = suggest.Suggestor.build(_tokens(spark, sf_dir), "w", 1)
    return index.remove(_tokens(spark, sf_dir).where("w < 'c'"), "w").items().select(F.col("value").alias("w"))


@query("f04_contains", f"select w from {_WORDS} where w >= 'c'")
def _(spark, sf_dir):
    words = _tokens(spark, sf_dir)
    return suggest.Suggestor.build(words, "w", 1).remove(words.where("w < 'c'"), "w").contains(words, "w")


@query("f05_items", f"select w from {_WORDS}")
def _(spark, sf_dir):
    return suggest.Suggestor.build(_tokens(spark, sf_dir), "w", 1).items().select(F.col("value").alias("w"))


# words one edit or one swap apart agree but for one character in length and share a one-character deletion
_FOUND = f"with t as (select w from {_WORDS}), q as (select w q from t), d as (select w, w v from t union select w, concat(left(w, i::int - 1), substr(w, i::int + 1)) from t, range(1, 1000) r(i) where i <= length(w) and length(w) > 1), c as (select distinct q, t.w from q join d e on e.w = q join d t on t.v = e.v), f as (select q, w v, case when q = w then 0 else 1 end n from c where levenshtein(q, w) <= 1 or (length(q) = length(w) and len(list_filter(range(1, length(q)), lambda i: concat(left(q, i::int - 1), substr(q, i::int + 1, 1), substr(q, i::int, 1), substr(q, i::int + 2)) = w)) > 0))"


def _lookup(spark, sf_dir, verbosity):
    words = _tokens(spark, sf_dir)
    found = suggest.Suggestor.build(words, "w", 1).lookup(words, "w", 1, verbosity)
    return found.select(F.col("query").alias("q"), F.col("value").alias("v"), F.col("distance").alias("n"))


@query("f06_suggest_d1", f"{_FOUND} select q, v, n from f")
def _(spark, sf_dir):
    return _lookup(spark, sf_dir, suggest.ALL)


@query("f07_suggest_top", f"{_FOUND}, b as (select q, min(n) m from f group by 1) select q, v, n from f join b using (q) where m > 0 or n = 0")
def _(spark, sf_dir):
    return _lookup(spark, sf_dir, suggest.TOP)


@query("f08_suggest_closest", f"{_FOUND}, b as (select q, min(n) m from f group by 1) select q, v, n from f join b using (q) where n = m")
def _(spark, sf_dir):
    return _lookup(spark, sf_dir, suggest.CLOSEST)


@query("f09_suggest_ranked", f"{_FOUND} select q, v, round(2 - 2 / (1 + exp(-n::double)), 6) s, row_number() over (partition by q order by n, v) r from f")
def _(spark, sf_dir):
    from pyspark.sql import Window

    words = _tokens(spark, sf_dir)
    found = suggest.Suggestor.build(words, "w", 1).lookup(words, "w", 1)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "distance", "value")
    return found.select(F.col("query").alias("q"), F.col("value").alias("v"), F.round("similarity", 6).alias("s"), F.row_number().over(order).cast("long").alias("r"))


# no SQL: all pairs of words take it too long; the tests compare with all pairs of a small vocabulary
@query("f06_suggest_d2")
def _(spark, sf_dir):
    words = _tokens(spark, sf_dir)
    return suggest.Suggestor.build(words, "w", 2).lookup(words, "w", 2).select("query", "value", "distance")


@query("g01_plate_items", "select distinct upper(trim(s_name)) k from supplier")
def _(spark, sf_dir):
    return suggest.PlateIndex.build(Tables(spark, sf_dir).supplier, "s_name", 1).items().select(F.col("value").alias("k"))


_PLATES = "(select a.k x, b.k y from (select distinct upper(trim(s_name)) k from supplier) a join (select distinct upper(trim(s_name)) k from supplier) b on levenshtein(a.k, b.k) <= 2)"


@query("g02_plate_lookup", f"select e.x q, e.y v, e.d::int n, round(c.d, 6) c, round(2 - 2 / (1 + exp(-c.d)), 6) s from ({sqltext.edit_distance(_PLATES)}) e join ({sqltext.edit_distance(_PLATES, sqltext.combined_cost())}) c using (x, y) where e.d <= 1")
def _(spark, sf_dir):
    suppliers = Tables(spark, sf_dir).supplier
    found = suggest.PlateIndex.build(suppliers, "s_name", 1).lookup(suppliers, "s_name", 1, suggest.ALL)
    return found.select(F.col("query").alias("q"), F.col("value").alias("v"), F.col("distance").alias("n"), F.round("combined", 6).alias("c"), F.round("similarity", 6).alias("s"))


@query("g03_normalize_plate", "select distinct c_mktsegment k, upper(trim(strip_accents(c_mktsegment))) p from customer")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select(F.col("c_mktsegment").alias("k"), fuzzy.normalize_plate(F.col("c_mktsegment")).alias("p")).distinct()


# ---- substring positions

@query("h02_index_of", "select page_id, strpos(html, 'the') - 1 i from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", strings.index_of(F.col("html"), "the").cast("long").alias("i"))


@query("h02s_index_of_from", "select page_id, case when strpos(substr(html, 101, 400), 'the') = 0 then -1 else strpos(substr(html, 101, 400), 'the') + 99 end i from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", strings.index_of(F.col("html"), "the", 100, 400).cast("long").alias("i"))


@query("h03_last_index_of", "select page_id, case when strpos(html, 'the') = 0 then -1 else length(html) - 3 - (strpos(reverse(html), 'eht') - 1) end i from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", strings.last_index_of(F.col("html"), "the").cast("long").alias("i"))


@query("h04_index_of_bytes", "select page_id, strpos(url, '.example') - 1 i from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", strings.index_of_bytes(F.encode("url", "UTF-8"), b".example").cast("long").alias("i"))


@query("h05_empty_pattern", "select page_id, 7 i from pages")
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", strings.index_of(F.col("html"), "", 7).alias("i"))


# ---- order

def _events(spark, sf_dir, kind) -> DataFrame:
    return Tables(spark, sf_dir).events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")


def _asof(spark, sf_dir, forward):
    errors = _events(spark, sf_dir, "error")
    bought = _events(spark, sf_dir, "purchase").withColumnRenamed("event_id", "n")
    found = ordered.asof_join(errors, bought, ["user_id"], "ts", "n", forward)
    return found.where("n is not null").select("event_id", "n")


_ASOF = "select e.event_id, p.event_id n from (select * from events where event_type = 'error') e asof join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts {0} p.ts"


@query("i01_ordered_items", "select o_orderkey k, row_number() over (order by o_orderkey) - 1 r from orders")
def _(spark, sf_dir):
    return ordered.ranks(Tables(spark, sf_dir).orders.select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("k"), F.col("rank").alias("r"))


@query("i03_append_ordered", "select o_orderkey k from orders union all select o_orderkey + (select max(o_orderkey) + 1 from orders) from orders where o_orderkey < 100")
def _(spark, sf_dir):
    keys = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("k"))
    top = keys.agg(F.max("k")).first()[0] or 0
    return ordered.append_ordered(keys, keys.where("k < 100").select((F.col("k") + top + 1).alias("k")), "k")


@query("i02_set_operations", "select distinct c_nationkey k from customer union select s_nationkey from supplier except select 3")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base = KeyIndex(t.customer.select(F.col("c_nationkey").alias("key")).distinct().withColumn("value", F.lit(0)))
    more = t.supplier.select(F.col("s_nationkey").alias("key")).distinct().withColumn("value", F.lit(0))
    return base.try_add(more)[0].remove(spark.createDataFrame([(3,)], "key int")).df.select(F.col("key").alias("k"))


@query("i04_lookup", "select o_orderkey k, o_totalprice v from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    probes = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("k")).distinct()
    return KeyIndex(t.orders, "o_orderkey", "o_totalprice").try_get(probes, "k").where("found").select("k", F.col("value").alias("v"))


@query("i05_minimum_item", "select o_orderkey k, o_totalprice v from orders order by o_orderkey limit 1")
def _(spark, sf_dir):
    return topk.peek(Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "k")


@query("i06_binary_search", "select count(*) filter (o_orderkey < 777) r, max(o_orderkey) filter (o_orderkey <= 777) f, min(o_orderkey) filter (o_orderkey >= 777) c, coalesce(bool_or(o_orderkey = 777), false) found from orders")
def _(spark, sf_dir):
    found = ordered.search(Tables(spark, sf_dir).orders, "o_orderkey", F.lit(777))
    return found.select(F.col("rank").alias("r"), F.col("floor").alias("f"), F.col("ceiling").alias("c"), "found")


@query("i09_search_nearby", "select count(*) filter (p_name < 'cold') r, max(p_name) filter (p_name <= 'cold') f, min(p_name) filter (p_name >= 'cold') c, coalesce(bool_or(p_name = 'cold'), false) found from part")
def _(spark, sf_dir):
    found = ordered.search(Tables(spark, sf_dir).part, "p_name", F.lit("cold"))
    return found.select(F.col("rank").alias("r"), F.col("floor").alias("f"), F.col("ceiling").alias("c"), "found")


@query("i07_ceiling", _ASOF.format("<="))
def _(spark, sf_dir):
    return _asof(spark, sf_dir, True)


@query("i07s_ceiling_of", "select min(p_name) k from part where p_name >= 'cold'")
def _(spark, sf_dir):
    return ordered.ceiling(Tables(spark, sf_dir).part.select(F.col("p_name").alias("k")), "k", F.lit("cold"))


@query("i08_floor", _ASOF.format(">="))
def _(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query("i08s_floor_of", "select max(p_name) k from part where p_name <= 'cold'")
def _(spark, sf_dir):
    return ordered.floor(Tables(spark, sf_dir).part.select(F.col("p_name").alias("k")), "k", F.lit("cold"))


@query("i08w_floor_sliced", _ASOF.format(">="))
def _(spark, sf_dir):
    bought = _events(spark, sf_dir, "purchase").withColumnRenamed("event_id", "n")
    found = ordered.asof_join(_events(spark, sf_dir, "error"), bought, ["user_id"], "ts", "n", width=86400.0)
    return found.where("n is not null").select("event_id", "n")


@query("i10_range_exclusive", "select o_orderkey from orders where o_orderdate > timestamp '1997-01-01' and o_orderdate < timestamp '1997-02-01'")
def _(spark, sf_dir):
    index = KeyIndex(Tables(spark, sf_dir).orders, "o_orderdate", "o_orderkey")
    return index.range(datetime(1997, 1, 1), datetime(1997, 2, 1), False, False).select(F.col("value").alias("o_orderkey"))


@query("i10b_range_join", f"select q.a, q.b, p_name k from {NAMES}, (values ('blue', 'blue h'), ('cold', 'large'), ('small a', 'small c')) q(a, b) where p_name between q.a and q.b")
def _(spark, sf_dir):
    probes = spark.createDataFrame([("blue", "blue h"), ("cold", "large"), ("small a", "small c")], "a string, b string")
    return KeyIndex(_names(spark, sf_dir), "v", None).ranges(probes, "a", "b").select("a", "b", F.col("key").alias("k"))


@query("i11_starts_with", "select s_suppkey v from supplier where starts_with(s_name, 'Supplier#00000000')")
def _(spark, sf_dir):
    return KeyIndex(Tables(spark, sf_dir).supplier, "s_name", "s_suppkey").starts_with("Supplier#00000000").select(F.col("value").alias("v"))


@query("i12_neighbours", "select c_name k, lag(c_name) over (order by c_name) p, lead(c_name) over (order by c_name) n from customer")
def _(spark, sf_dir):
    found = ordered.neighbours(Tables(spark, sf_dir).customer.select("c_name"), "c_name")
    return found.select(F.col("c_name").alias("k"), F.col("previous").alias("p"), F.col("next").alias("n"))


@query("i13_update", "select c_name k, case when c_custkey % 7 = 3 then -c_custkey else c_custkey end v from customer")
def _(spark, sf_dir):
    return _kv(_customers(spark, sf_dir).update(F.col("value") % 7 == 3, -F.col("value")).df)


@query("i14_tree_height", "select c_custkey k, round(log2(c_custkey + 1) - 1, 6) a, round(ln(c_custkey + 2) / ln((1 + sqrt(5)) / 2) - 1.3277, 6) b from customer")
def _(spark, sf_dir):
    high = ordered.tree_heights(F.col("c_custkey"))
    return Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("k"), F.round(high["least"], 6).alias("a"), F.round(high["most"], 6).alias("b"))


@query("i16_comparer", "select p_partkey k, p_size s from part order by p_size desc, p_partkey limit 20")
def _(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return topk.dequeue(part, F.desc("s"), 20, "k")


# ---- queues

@query("j01_enqueue", "select p_partkey k, p_retailprice p from part union all select s_suppkey, s_acctbal from supplier")
def _(spark, sf_dir):
    from ..sources.snapshots import append

    t = Tables(spark, sf_dir)
    return append(t.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("p")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("p")))


@query("j07_nodes", "select p_partkey k, p_retailprice p from part")
def _(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("p"))


@query("j02_first", "select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 1")
def _(spark, sf_dir):
    return topk.peek(Tables(spark, sf_dir).part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@query("j03_dequeue_k", "select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 10")
def _(spark, sf_dir):
    return topk.dequeue(Tables(spark, sf_dir).part.select("p_partkey", "p_retailprice"), "p_retailprice", 10, "p_partkey")


@query("j04_stable_dequeue", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) r from part) where r <= 3")
def _(spark, sf_dir):
    return topk.dequeue_each(Tables(spark, sf_dir).part, "p_brand", "p_retailprice", 3, "p_partkey").select("p_brand", "p_partkey")


@query("j05_find_nodes", "select p_partkey from part where p_size = 7")
def _(spark, sf_dir):
    return topk.find(Tables(spark, sf_dir).part, F.col("p_size") == 7).select("p_partkey")


@query("j06_update_priority", "select p_partkey, case when p_size = 7 then 0 else p_retailprice end p from part order by p, p_partkey limit 10")
def _(spark, sf_dir):
    part = topk.set_priority(Tables(spark, sf_dir).part, F.col("p_size") == 7, "p_retailprice", F.lit(0.0))
    return topk.dequeue(part.select("p_partkey", F.col("p_retailprice").alias("p")), "p", 10, "p_partkey")


@query("j08_max_heap", "select p_partkey from part order by p_retailprice desc, p_partkey limit 10")
def _(spark, sf_dir):
    return topk.dequeue(Tables(spark, sf_dir).part, F.desc("p_retailprice"), 10, "p_partkey").select("p_partkey")


# ---- cache

_ORDER = ["ts", "event_id"]
_AT = "struct_pack(t := ts, e := event_id)"
_LAST = f"select user_id k, arg_max(value, {_AT}) v, max({_AT}) o from events group by 1"


@query("l01_mru_keys", f"select k, v from ({_LAST}) order by o desc limit 50")
def _(spark, sf_dir):
    return cache.touched(Tables(spark, sf_dir).events, "user_id", "value", _ORDER, 50).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("l05_get_or_add", f"with c as (select k, v from ({_LAST}) order by o desc limit 50) select c_custkey k, coalesce(v, -1.0) v, v is not null f from customer left join c on c_custkey = k")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    held = cache.touched(t.events, "user_id", "value", _ORDER, 50)
    found = cache.get_or_add(t.customer.select("c_custkey"), held, "c_custkey", F.lit(-1.0))
    return found.select(F.col("c_custkey").alias("k"), F.col("value").alias("v"), F.col("cached").alias("f"))


@query("l07_lru_key", f"select user_id k from events group by 1 order by max({_AT}), 1 limit 1")
def _(spark, sf_dir):
    return cache.least_recent(Tables(spark, sf_dir).events, "user_id", _ORDER).select(F.col("key").alias("k"))


@query("l07m_mru_key", f"select user_id k from events group by 1 order by max({_AT}) desc limit 1")
def _(spark, sf_dir):
    return cache.most_recent(Tables(spark, sf_dir).events, "user_id", _ORDER).select(F.col("key").alias("k"))


@query("l07o_lru_order", f"select user_id k from events group by 1 order by max({_AT})")
def _(spark, sf_dir):
    return cache.recency(Tables(spark, sf_dir).events, "user_id", _ORDER).select(F.col("key").alias("k"))


@query("l10_set_capacity", f"select k, v from ({_LAST}) order by o desc limit 5")
def _(spark, sf_dir):
    return cache.touched(Tables(spark, sf_dir).events, "user_id", "value", _ORDER, 5).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("l11_evicted", f"select k, v from ({_LAST}) order by o desc offset 50")
def _(spark, sf_dir):
    return cache.evicted(Tables(spark, sf_dir).events, "user_id", "value", _ORDER, 50).select(F.col("key").alias("k"), F.col("value").alias("v"))


def _replayed(spark, sf_dir, operations: dict, capacity=1_000_000, places: int | None = 20) -> DataFrame:
    """What the caches of (user_id modulo 4) hold after the events have been carried out as operations, the first places or all."""
    events = Tables(spark, sf_dir).events.where(F.col("event_type").isin(*operations))
    names = F.create_map(*[F.lit(x) for pair in operations.items() for x in pair])
    log = events.select((F.col("user_id") % 4).alias("cache"), F.struct(*_ORDER).alias("seq"), names[F.col("event_type")].alias("operation"), F.col("user_id").alias("key"), "value")
    held = cache.replay(log, capacity)
    if places is not None:
        held = held.where(F.col("place") < places)
    return held.select(F.col("cache").alias("c"), F.col("key").alias("k"), F.col("value").alias("v"), F.col("place").cast("long").alias("p"))


_PLACED = "select user_id % 4 c, user_id k, v, p from (select *, row_number() over (partition by user_id % 4 order by o desc) - 1 p from ({0})) where p < 20"
_PUTS = f"select user_id, arg_max(value, {_AT}) v, max({_AT}) o, min({_AT}) f from events where event_type = 'purchase' group by 1"


@query("l02_try_add", _PLACED.format(f"select user_id, arg_min(value, {_AT}) v, min({_AT}) o from events where event_type = 'view' group by 1"))
def _(spark, sf_dir):
    return _replayed(spark, sf_dir, {"view": "try_add"})


@query("l03_get_bumps", _PLACED.format(f"select p.user_id, any_value(p.v) v, max({_AT}) o from ({_PUTS}) p join events e on e.user_id = p.user_id and event_type in ('purchase', 'click') and {_AT} >= p.f group by 1"))
def _(spark, sf_dir):
    return _replayed(spark, sf_dir, {"purchase": "put", "click": "get"})


@query("l04_contains_key", f"with c as (select k, v from ({_LAST}) order by o desc limit 50) select c_custkey k from customer where c_custkey in (select k from c)")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    held = cache.touched(t.events, "user_id", "value", _ORDER, 50)
    return KeyIndex(held).contains_key(t.customer, "c_custkey").select(F.col("c_custkey").alias("k"))


@query("l08_bump", _PLACED.format(f"select p.user_id, any_value(p.v) v, max({_AT}) o from ({_PUTS}) p join events e on e.user_id = p.user_id and event_type in ('purchase', 'signup') and {_AT} >= p.f group by 1"))
def _(spark, sf_dir):
    return _replayed(spark, sf_dir, {"purchase": "put", "signup": "bump"})


@query("l09_remove", _PLACED.format(f"select * from ({_PUTS}) p where not exists (select 1 from events e where e.user_id = p.user_id and event_type = 'error' and {_AT} > p.o)"))
def _(spark, sf_dir):
    return _replayed(spark, sf_dir, {"purchase": "put", "error": "remove"})


# every held key with its place, where the queries above give the first 20 of each cache
for _name, _operations in {
    "l02_try_add": {"view": "try_add"},
    "l03_get_bumps": {"purchase": "put", "click": "get"},
    "l08_bump": {"purchase": "put", "signup": "bump"},
    "l09_remove": {"purchase": "put", "error": "remove"},
}.items():
    query(f"{_name}_all", ORACLES[_name].removesuffix(" where p < 20"))(lambda spark, sf_dir, operations=_operations: _replayed(spark, sf_dir, operations, places=None))


@query("l12_set_only", f"select k from ({_LAST}) order by o desc limit 50")
def _(spark, sf_dir):
    return cache.touched(Tables(spark, sf_dir).events, "user_id", "value", _ORDER, 50).select(F.col("key").alias("k"))


@query("l06_replay_puts", f"select event_type c, user_id k, v, r - 1 p from (select *, row_number() over (partition by event_type order by o desc) r from (select event_type, user_id, arg_max(value, {_AT}) v, max({_AT}) o from events group by 1, 2)) where r <= 20")
def _(spark, sf_dir):
    log = Tables(spark, sf_dir).events.select(F.col("event_type").alias("cache"), F.struct(*_ORDER).alias("seq"), F.lit("put").alias("operation"), F.col("user_id").alias("key"), "value")
    held = cache.replay(log, 20)
    return held.select(F.col("cache").alias("c"), F.col("key").alias("k"), F.col("value").alias("v"), F.col("place").cast("long").alias("p"))


# ---- diagnostics, combinations

@query("m01_metrics", "select count(*) n, sum(length(p_name))::bigint l, round(avg(length(p_name)), 6) a from (select distinct p_name from part)")
def _(spark, sf_dir):
    found = KeyIndex(_names(spark, sf_dir), "v", None).metrics()
    return found.select(F.col("keys").alias("n"), F.col("key_bytes").alias("l"), F.round("average_key", 6).alias("a"))


@query("m01b_branching", f"with t as (select distinct left(p_name, n) k from {NAMES}, range(1, 30) t(n) where n <= length(p_name)), c as (select left(k, length(k) - 1) p, count(*) c from t group by 1) select length(p) d, c, count(*) n from c group by 1, 2")
def _(spark, sf_dir):
    found = KeyIndex(_names(spark, sf_dir), "v", None).branching()
    return found.select(F.col("depth").cast("long").alias("d"), F.col("children").alias("c"), F.col("nodes").alias("n"))


@query("n01_combinations", "select r_name, n_name from region cross join nation")
def _(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return combine.combinations(t.region.select("r_name"), t.nation.select("n_name"))
