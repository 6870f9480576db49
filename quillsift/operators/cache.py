"""A bounded cache that evicts what was used least recently, over access logs.

Where each access puts or promotes its key, the cache holds the ``capacity`` keys that were touched last: an aggregation
and a top-k. Logs with operations that do not promote (try_add on a present key), removals or changes of capacity are
replayed in order, one cache at a time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations of a log that is replayed.
OPERATIONS = ("put", "get", "try_add", "get_or_add", "bump", "remove", "clear", "capacity")


def touched(log: DataFrame, key: str, value: str, order: list[str], capacity: int) -> DataFrame:
    """key, value, most recently touched first."""
    at = F.struct(*order)
    last = log.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), at).alias("value"), F.max(at).alias("__at"))
    return last.orderBy(F.desc("__at")).limit(capacity).select("key", "value")


def evicted(log: DataFrame, key: str, value: str, order: list[str], capacity: int) -> DataFrame:
    """The keys that were touched but are no longer held, with the last value of each."""
    kept = touched(log, key, value, order, capacity).select(F.col("key").alias("__kept"))
    every = log.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), F.struct(*order)).alias("value"))
    return every.join(F.broadcast(kept), F.col("key") == F.col("__kept"), "left_anti")


def most_recent(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    return log.agg(F.max_by(F.col(key), F.struct(*order)).alias("key")).where("key is not null")


def least_recent(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The key whose last touch is the oldest."""
    last = log.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(*order)).alias("__at"))
    return last.orderBy("__at", "key").limit(1).select("key")


def recency(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys, least recently touched first."""
    last = log.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(*order)).alias("__at"))
    return last.orderBy("__at").select("key")


def get_or_add(probes: DataFrame, cached: DataFrame, key: str, computed: Column) -> DataFrame:
    """Probes with the cached value, or the computed one where there is none."""
    here = cached.select(F.col("key").alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__found"))
    joined = probes.join(here, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("value", F.when(F.col("__found"), F.col("__value")).otherwise(computed)).withColumn("cached", F.coalesce("__found", F.lit(False))).drop("__key", "__value", "__found")


class Cache:
    """The cache itself, for replays and streams."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.held: OrderedDict = OrderedDict()

    def apply(self, operation: str, key, value) -> list[tuple]:
        """Carries out one operation; gives what was evicted."""
        held = self.held
        if operation in ("put", "get_or_add", "try_add"):
            if key in held:
                if operation == "put":
                    held[key] = value
                if operation != "try_add":
                    held.move_to_end(key)
            else:
                held[key] = value
        elif operation in ("get", "bump"):
            if key in held:
                held.move_to_end(key)
        elif operation == "remove":
            held.pop(key, None)
        elif operation == "clear":
            held.clear()
        elif operation == "capacity":
            self.capacity = int(value)
        else:
            raise ValueError(f"unknown operation {operation}")
        out = []
        while len(held) > self.capacity:
            out.append(held.popitem(last=False))
        return out


def replay(log: DataFrame, capacity: int, cache: str = "cache", order: str = "seq") -> DataFrame:
    """cache, key, value, place (0: most recent) after a log (cache, seq, operation, key, value) has been carried out.

    Each cache's log is dealt to one task and streams through it in order; only the cache is held.
    """
    kind = f"{cache} {log.schema[cache].dataType.simpleString()}, key {log.schema['key'].dataType.simpleString()}, value {log.schema['value'].dataType.simpleString()}, place int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def rows():
            return pd.DataFrame([(now, k, v, i) for i, (k, v) in enumerate(reversed(state.held.items()))], columns=[cache, "key", "value", "place"])

        for batch in batches:
            for name, operation, key, value in zip(batch[cache], batch["operation"], batch["key"], batch["value"]):
                if state is None or name != now:
                    if state is not None:
                        yield rows()
                    now, state = name, Cache(capacity)
                state.apply(operation, key, value)
        if state is not None:
            yield rows()

    dealt = log.select(cache, order, "operation", "key", "value").repartition(cache).sortWithinPartitions(cache, order).drop(order)
    return dealt.mapInPandas(run, kind)
