"""Keyed tables: lookups, prefixes, patterns, ranges, mutations. A batch of probes is a join; a mutation is a new table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns
from ..sources import snapshots
from . import ordered


class KeyIndex:
    """A table of unique keys and their values. Queries give DataFrames (key, value); select what is needed."""

    def __init__(self, df: DataFrame, key: str = "key", value: str | None = "value", check: bool = False):
        self.df = df.select(F.col(key).alias("key"), *([F.col(value).alias("value")] if value else []))
        if check and self.df.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("a key is there twice")

    def _with(self, df: DataFrame) -> KeyIndex:
        out = KeyIndex.__new__(KeyIndex)
        out.df = df
        return out

    # scans

    def items(self) -> DataFrame:
        return self.df.orderBy("key")

    def keys(self) -> DataFrame:
        return self.df.select("key").orderBy("key")

    def values(self) -> DataFrame:
        return self.df.orderBy("key").select("value")

    def count(self) -> DataFrame:
        """long_count, and count, which stops at the largest 32-bit number."""
        return self.df.agg(F.count(F.lit(1)).alias("long_count")).select(F.least("long_count", F.lit(2147483647)).alias("count"), "long_count")

    def minimum(self) -> DataFrame:
        """The smallest key; no row if there is none."""
        return self.df.agg(F.min("key").alias("key")).where("key is not null")

    def maximum(self) -> DataFrame:
        return self.df.agg(F.max("key").alias("key")).where("key is not null")

    def __iter__(self):
        """(key, value) in order, a partition at a time."""
        return (tuple(r) for r in self.items().toLocalIterator())

    # lookups

    def get(self, key) -> DataFrame:
        return self.df.where(F.col("key") == F.lit(key))

    def __getitem__(self, key):
        """The value of a key; KeyError if it is not there."""
        row = self.get(key).first()
        if row is None:
            raise KeyError(key)
        return row["value"]

    def try_get(self, probes: DataFrame, on: str = "key") -> DataFrame:
        """Probes with value and found."""
        here = self.df.withColumn("found", F.lit(True))
        return probes.join(here.withColumnRenamed("key", "__key"), F.col(on) == F.col("__key"), "left").drop("__key").withColumn("found", F.coalesce("found", F.lit(False)))

    def contains_key(self, probes: DataFrame, on: str = "key") -> DataFrame:
        """The probes whose key is there."""
        return probes.join(self.df.select(F.col("key").alias("__key")), F.col(on) == F.col("__key"), "left_semi")

    def contains(self, probes: DataFrame) -> DataFrame:
        """The probes (key, value) that are there with that value; null values are equal."""
        here = self.df.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
        return probes.join(here, (F.col("key") == F.col("__key")) & F.col("value").eqNullSafe(F.col("__value")), "left_semi")

    # prefixes

    def starts_with(self, prefix: str) -> DataFrame:
        """Keys that begin with ``prefix``; all for an empty one."""
        return self.df.where(F.col("key").startswith(prefix)) if prefix else self.df

    def starts_with_any(self, probes: DataFrame, on: str = "prefix") -> DataFrame:
        """Probes joined with the keys that begin with them, by equality of prefixes; of the lengths that probes have."""
        sizes = [r[0] for r in probes.select(F.length(on)).distinct().orderBy(1).collect() if r[0] is not None]
        if not sizes:
            return probes.join(self.df, F.lit(False))
        heads = self.df.withColumn("__n", F.explode(F.array(*map(F.lit, sizes)))).where(F.length("key") >= F.col("__n")).withColumn("__head", F.substring(F.col("key"), F.lit(1), F.col("__n")))
        return probes.join(heads, F.col(on) == F.col("__head")).drop("__n", "__head")

    def leafs_in_path(self, path: str) -> DataFrame:
        """Keys that ``path`` begins with, short ones first; a list of equalities, which is pushed down."""
        return self.df.where(F.col("key").isin([path[: i + 1] for i in range(len(path))])).orderBy(F.length("key"))

    def leafs_in_paths(self, probes: DataFrame, on: str = "path") -> DataFrame:
        """Probes joined with the keys that they begin with."""
        heads = probes.withColumn("__head", F.explode(F.transform(F.sequence(F.lit(1), F.length(on)), lambda n: F.substring(F.col(on), F.lit(1), n))))
        return heads.where(F.length(on) > 0).join(self.df, F.col("__head") == F.col("key")).drop("__head")

    def prefix_counts(self) -> DataFrame:
        """Nodes of the keys' trie: each prefix, its depth, and the number of keys below; breadth first."""
        heads = self.df.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
        return heads.groupBy("prefix").agg(F.count(F.lit(1)).alias("keys")).withColumn("depth", F.length("prefix")).orderBy("depth", "prefix")

    def visits(self) -> DataFrame:
        """Trie nodes with their places, from 0, in a walk by depth and in one by breadth."""
        nodes = self.prefix_counts().select("prefix", F.col("depth"))
        deep = ordered.ranks(nodes, "prefix").withColumnRenamed("rank", "depth_first")
        wide = ordered.ranks(deep.withColumn("__order", F.struct("depth", "prefix")), "__order")
        return wide.drop("__order").withColumnRenamed("rank", "breadth_first")

    def paths(self, depth_first: bool = True) -> DataFrame:
        """Trie nodes in visiting order."""
        nodes = self.prefix_counts()
        return nodes.orderBy("prefix") if depth_first else nodes.orderBy("depth", "prefix")

    def shortest_unique(self) -> DataFrame:
        """Each key with the shortest prefix that no other key has; the key itself if it begins another.

        The neighbours in order decide; they are found range by range, see ``ordered.neighbours``.
        """
        from .ordered import neighbours

        near = neighbours(self.df.select("key").distinct(), "key")

        def common(other: Column) -> Column:
            return F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.length("key")), lambda n: other.startswith(F.substring(F.col("key"), F.lit(1), n)))), F.lit(0))

        size = F.least(F.length("key"), 1 + F.greatest(*[F.when(F.col(c).isNull(), 0).otherwise(common(F.col(c))) for c in ("previous", "next")]))
        return near.select("key", F.substring(F.col("key"), F.lit(1), size).alias("unique_prefix"))

    # patterns

    def wildcard(self, pattern: str, wildcard: str = "?", prefix: bool = False) -> DataFrame:
        """Keys that match, where ``wildcard`` is any one byte."""
        classes = patterns.classes_of_wildcard(pattern, wildcard)
        if prefix and not pattern.strip(wildcard):
            return self.df
        return self.df.where(patterns.classes_match(F.col("key"), classes, prefix))

    def classes(self, pattern: str, prefix: bool = False) -> DataFrame:
        """Keys that match a class pattern."""
        return self.df.where(patterns.classes_match(F.col("key"), patterns.parse_classes(pattern), prefix))

    def near(self, pattern: str, distance: int, missing: int = 1, extra: int = 1) -> DataFrame:
        """Keys whose cost against a class pattern is at most ``distance``, with ``cost``; a band of lengths comes first."""
        classes = patterns.parse_classes(pattern)
        size = F.octet_length("key")
        band = F.lit(True)
        if missing > 0:
            band = band & (size >= len(classes) - distance // missing)
        if extra > 0:
            band = band & (size <= len(classes) + distance // extra)
        return self.df.where(band).withColumn("cost", patterns.classes_cost(F.col("key"), classes, missing, extra)).where(F.col("cost") <= distance)

    def filter_cost(self, cost, budget: int) -> DataFrame:
        """Keys for which the user's function from a pandas Series of keys to costs stays within ``budget``; also what is left."""
        @F.pandas_udf(T.LongType())
        def costs(keys: pd.Series) -> pd.Series:
            return pd.Series(cost(keys), dtype="int64")

        return self.df.withColumn("left_over", F.lit(budget) - costs("key")).where("left_over >= 0")

    # ranges

    def range(self, start=None, end=None, include_start: bool = True, include_end: bool = True) -> DataFrame:
        """Keys between bounds; None is open."""
        if start is not None and end is not None and end < start:
            raise ValueError("the range ends before it starts")
        where = F.lit(True)
        if start is not None:
            where = where & (F.col("key") >= start if include_start else F.col("key") > start)
        if end is not None:
            where = where & (F.col("key") <= end if include_end else F.col("key") < end)
        return self.df.where(where)

    def range_tree(self, start: str, end: str) -> DataFrame:
        """Keys whose each byte lies between the bounds' bytes at its place, for as many bytes as both bounds have."""
        places = list(zip(start.encode(), end.encode()))
        if any(a > b for a, b in places):
            raise ValueError("a place of the range ends before it starts")
        return self.df.where(patterns.classes_match(F.col("key"), [frozenset(range(a, b + 1)) for a, b in places], prefix=True))

    def ranges(self, probes: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
        """Probes joined with the string keys in their ranges, by equality of the first byte, for each one in the range."""

        def byte(text: Column) -> Column:
            return F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 1)), 16, 10).cast("int")

        spans = probes.where(F.col(start) <= F.col(end)).withColumn("__byte", F.explode(F.sequence(F.coalesce(byte(F.col(start)), F.lit(0)), F.coalesce(byte(F.col(end)), F.lit(0)))))
        heads = self.df.withColumn("__head", F.coalesce(byte(F.col("key")), F.lit(0)))
        return spans.join(heads, (F.col("__byte") == F.col("__head")) & F.col("key").between(F.col(start), F.col(end))).drop("__byte", "__head")

    # mutations

    def add(self, rows: DataFrame) -> KeyIndex:
        """The table with new rows; ValueError if a key is empty, given twice, or there already."""
        rows = rows.select("key", "value")
        if rows.where("key is null or key = ''").limit(1).count() or rows.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("an empty or repeated key")
        if self.df.join(rows, "key", "left_semi").limit(1).count():
            raise ValueError("a key is there already")
        return self._with(self.df.unionByName(rows))

    def try_add(self, rows: DataFrame) -> tuple[KeyIndex, DataFrame]:
        """The table with the rows whose key was not there, and these rows."""
        new = rows.select("key", "value").dropDuplicates(["key"]).join(self.df, "key", "left_anti")
        return self._with(self.df.unionByName(new)), new

    def remove(self, keys: DataFrame) -> KeyIndex:
        return self._with(self.df.join(keys.select("key"), "key", "left_anti"))

    def upsert(self, rows: DataFrame) -> KeyIndex:
        rows = rows.select("key", "value")
        return self._with(self.df.join(rows, "key", "left_anti").unionByName(rows))

    add_range, remove_range, set_value = add, remove, upsert

    def update(self, where: Column, value: Column) -> KeyIndex:
        return self._with(self.df.withColumn("value", F.when(where, value).otherwise(F.col("value"))))

    def clear(self) -> KeyIndex:
        return self._with(self.df.limit(0))

    def save(self, path: str) -> KeyIndex:
        return self._with(snapshots.create(self.df, path))

    def optimize(self, path: str) -> KeyIndex:
        return self._with(snapshots.optimize(self.df, path))

    # diagnostics

    def metrics(self) -> DataFrame:
        """keys, key_bytes, average and extreme sizes."""
        size = F.octet_length("key")
        return self.df.agg(F.count(F.lit(1)).alias("keys"), F.sum(size).alias("key_bytes"), F.avg(size).alias("average_key"), F.min(size).alias("shortest_key"), F.max(size).alias("longest_key"))

    def branching(self) -> DataFrame:
        """How many trie nodes of each depth have how many children."""
        nodes = self.prefix_counts().select("prefix")
        parents = nodes.select(F.expr("left(prefix, length(prefix) - 1)").alias("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        return parents.groupBy(F.length("parent").alias("depth"), "children").agg(F.count(F.lit(1)).alias("nodes"))


def ordered_items(df: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """Rows in the order of any sort expression, which stands for a comparer."""
    return df.orderBy(key.desc() if descending else key.asc())


