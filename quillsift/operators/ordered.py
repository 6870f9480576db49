"""Order: floors, ceilings, neighbours, as-of joins. Nothing here sorts a whole table in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import ranged


def floor(df: DataFrame, key: str, probe: Column) -> DataFrame:
    """The row with the largest key at most ``probe``; no row if there is none."""
    return _nearest(df.where(F.col(key) <= probe), F.max_by(F.struct(*df.columns), F.col(key)))


def ceiling(df: DataFrame, key: str, probe: Column) -> DataFrame:
    """The row with the smallest key at least ``probe``."""
    return _nearest(df.where(F.col(key) >= probe), F.min_by(F.struct(*df.columns), F.col(key)))


def _nearest(df: DataFrame, best: Column) -> DataFrame:
    return df.agg(best.alias("__row")).where("__row is not null").select("__row.*")


def search(df: DataFrame, key: str, probe: Column) -> DataFrame:
    """found, rank (keys below the probe), floor and ceiling of a probe."""
    return df.agg(
        F.coalesce(F.bool_or(F.col(key) == probe), F.lit(False)).alias("found"),
        F.count(F.when(F.col(key) < probe, 1)).alias("rank"),
        F.max(F.when(F.col(key) <= probe, F.col(key))).alias("floor"),
        F.min(F.when(F.col(key) >= probe, F.col(key))).alias("ceiling"),
    )


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``previous`` and ``next`` key in order.

    The table is dealt into ranges; a range's first and last keys, one row each, link it with the ranges beside it.
    """
    dealt = ranged(df, key)
    within = Window.partitionBy("__range").orderBy(key)
    edges = dealt.groupBy("__range").agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    across = Window.orderBy("__range")  # as many rows as there are ranges
    edges = edges.select("__range", F.lag("__high").over(across).alias("__before"), F.lead("__low").over(across).alias("__after"))
    near = dealt.withColumn("previous", F.lag(key).over(within)).withColumn("next", F.lead(key).over(within)).join(F.broadcast(edges), "__range")
    return near.withColumn("previous", F.coalesce("previous", "__before")).withColumn("next", F.coalesce("next", "__after")).drop("__range", "__before", "__after")


def ranks(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``rank``, their place in order from 0, by counts of whole ranges and places within one."""
    dealt = ranged(df, key)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__base"))
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1)
    return placed.join(F.broadcast(before), "__range").withColumn("rank", F.col("__base") + F.col("__at")).drop("__range", "__base", "__at")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, forward: bool = False, slices: int = 1, width: float | None = None) -> DataFrame:
    """Left rows with ``value`` of the right row of the same ``by`` that is nearest at or before (``forward``: after) ``on``.

    One sort of both sides together, no range join. Ties of ``on`` on the right go to the largest value (``forward``: the
    smallest). ``width``: groups too large for one task are cut into slices of so many units (seconds) of ``on``; the last
    value of each slice, one row each, is carried to the slices after it.
    """
    rows = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1 if not forward else 0).alias("__side"))
    data = right.select(*[F.col(c) if c in (*by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("__value"), F.lit(0 if not forward else 1).alias("__side"))
    both = rows.unionByName(data).withColumn("__left", F.col("__side") == (0 if forward else 1))
    place = F.col(on).cast("timestamp").cast("double") if left.schema[on].dataType.typeName().startswith("timestamp") else F.col(on).cast("double")
    slice_of = F.floor(place / width) if width else F.lit(0)
    both = both.withColumn("__slice", slice_of)
    # at equal keys the data come first when looking back, and last when looking ahead
    order = Window.partitionBy(*by, "__slice").orderBy(on, "__side", "__value")
    if forward:
        found = F.first("__value", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    else:
        found = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("__found", found).where("__left")
    if width:
        pick = F.min(F.struct(on, "__value")) if forward else F.max(F.struct(on, "__value"))
        ends = both.where("not __left").groupBy(*by, "__slice").agg(pick["__value"].alias("__end"))
        seen = both.select(*by, "__slice").distinct().join(ends, [*by, "__slice"], "left")
        along = Window.partitionBy(*by).orderBy("__slice")
        carried = F.first("__end", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("__end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        out = out.join(seen.withColumn("__carried", carried).drop("__end"), [*by, "__slice"], "left").withColumn("__found", F.coalesce("__found", "__carried"))
    return out.select(*left.columns, F.col("__found").alias(value if value not in left.columns else f"{value}_asof"))


def append_ordered(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; ValueError unless every new key is above all old ones."""
    top, low = df.agg(F.max(key)).first()[0], rows.agg(F.min(key)).first()[0]
    if top is not None and low is not None and low <= top:
        raise ValueError("a new key is not above the largest old one")
    return df.unionByName(rows)


def tree_heights(n: Column) -> Column:
    """struct<least, most> height of a balanced binary tree of n nodes."""
    golden = (1 + math.sqrt(5)) / 2
    return F.struct((F.log2(n + 1) - 1).alias("least"), (F.log(n + 2) / math.log(golden) - 1.3277).alias("most"))
