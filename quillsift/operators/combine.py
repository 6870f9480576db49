"""Combinations of dimensions, and key generators for tests."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def combinations(*dimensions: DataFrame) -> DataFrame:
    """The cartesian product, which is the result itself, of small tables."""
    return functools.reduce(lambda a, b: a.crossJoin(b), dimensions)


def combinations_of(spark: SparkSession, **dimensions: list) -> DataFrame:
    """The cartesian product of lists, the last dimension fastest."""
    frame = spark.range(1).select(*[F.array(*map(F.lit, values)).alias(f"__{name}") for name, values in dimensions.items()])
    for name in dimensions:
        frame = frame.select("*", F.posexplode(f"__{name}").alias(f"__at_{name}", name))
    return frame.orderBy(*[f"__at_{name}" for name in dimensions]).select(*dimensions)


def change_base(number: int, alphabet: str) -> str:
    """A number written with an alphabet."""
    digits = []
    while True:
        number, digit = divmod(number, len(alphabet))
        digits.append(alphabet[digit])
        if not number:
            return "".join(reversed(digits))


def generate_keys(count: int, seed: int = 0) -> Iterator[tuple[str, int]]:
    """(key, number): numbers in base 26, each letter one to three times, keys unique."""
    chance, seen = random.Random(seed), set()
    for i in range(count):
        while True:
            key = "".join(c * chance.randint(1, 3) for c in change_base(i, "abcdefghijklmnopqrstuvwxyz"))
            if key not in seen:
                break
        seen.add(key)
        yield key, i
