"""Priority queues as sorted reads: the lowest priority comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peek(df: DataFrame, priority: str, *ties: str) -> DataFrame:
    """The row with the lowest priority; no row if there is none."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(priority, *ties)).alias("__row")).where("__row is not null").select("__row.*")


def dequeue(df: DataFrame, priority: str | Column, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the lowest priority, in order; ``ties`` settle equal ones, such as an insertion number."""
    return df.orderBy(priority, *ties).limit(k)


def dequeue_each(df: DataFrame, by: str, priority: str | Column, k: int, *ties: str) -> DataFrame:
    """The ``k`` first rows of each group; each task keeps ``k`` rows of a group before anything is shuffled."""
    order = Window.partitionBy(by).orderBy(priority, *ties)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def find(df: DataFrame, where: Column) -> DataFrame:
    return df.where(where)


def set_priority(df: DataFrame, where: Column, priority: str, value: Column) -> DataFrame:
    return df.withColumn(priority, F.when(where, value).otherwise(F.col(priority)))


def is_heap(priorities: list) -> bool:
    """Whether each parent of a binary heap in an array is at most its children."""
    return all(priorities[(i - 1) // 2] <= p for i, p in enumerate(priorities) if i)
