"""Spelling and license-plate suggestions through an index of deletions.

A word's variants are what is left after up to ``distance`` deletions, never the empty string. Two words within the
distance share a variant, so queries and words meet at variants: within two edits in ``nearby``, else in an equi-join whose
candidates are verified afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, fuzzy_udf
from . import nearby

ALL, TOP, CLOSEST = "all", "top", "closest"


def deletions(word: Column, distance: int) -> Column:
    """The distinct variants of a word, itself included."""
    found = F.array(word)

    def shorter(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        return F.when(F.length(v) > 1, cut).otherwise(F.array().cast("array<string>"))

    for _ in range(distance):
        found = fuzzy.let(found, lambda all_: F.array_distinct(F.concat(all_, F.flatten(F.transform(all_, shorter)))))
    return found


@dataclass
class Suggestor:
    words: DataFrame  # value, distinct
    distance: int = 2

    @classmethod
    def build(cls, df: DataFrame, column: str, distance: int = 2) -> Suggestor:
        return cls(df.select(F.col(column).alias("value")).where("value is not null and value <> ''").distinct(), distance)

    @property
    def postings(self) -> DataFrame:
        """variant, value."""
        return self.words.select(F.explode(deletions(F.col("value"), self.distance)).alias("variant"), "value")

    def items(self) -> DataFrame:
        return self.words

    def add(self, df: DataFrame, column: str = "value") -> Suggestor:
        new = Suggestor.build(df, column, self.distance).words.join(self.words, "value", "left_anti")
        return Suggestor(self.words.unionByName(new), self.distance)

    def remove(self, df: DataFrame, column: str = "value") -> Suggestor:
        return Suggestor(self.words.join(df.select(F.col(column).alias("value")), "value", "left_anti"), self.distance)

    def contains(self, probes: DataFrame, column: str = "value") -> DataFrame:
        return probes.join(self.items().withColumnRenamed("value", "__value"), F.col(column) == F.col("__value"), "left_semi")

    def candidates(self, queries: DataFrame, column: str, distance: int) -> DataFrame:
        """Distinct (query, value, edits) that share a variant, and whose lengths, edits without swaps and letters allow the distance.

        A swap is two edits at most, and leaves the letters as they are.
        """
        probes = queries.select(F.col(column).alias("query")).distinct().select("query", F.explode(deletions(F.col("query"), distance)).alias("variant"))
        joined = probes.join(self.postings, "variant").where(F.abs(F.length("query") - F.length("value")) <= distance)
        found = joined.select("query", "value", F.levenshtein("query", "value", 2 * distance).alias("edits")).where("edits >= 0")
        letters = [F.split(c, "") for c in ("query", "value")]
        others = [F.size(F.array_except(a, b)) for a, b in (letters, letters[::-1])]
        return found.where((F.col("edits") <= distance) | (F.greatest(*others) <= 2 * distance - F.col("edits"))).distinct()

    def lookup(self, queries: DataFrame, column: str = "query", distance: int = -1, verbosity: str = ALL) -> DataFrame:
        """query, value, distance, similarity.

        Pairs within two edits are found and told apart where variants meet; farther ones are candidates, decided one by one.
        """
        distance = self.distance if distance < 0 else distance
        if distance > self.distance:
            raise ValueError("the index has no deletions of that distance")
        if distance <= nearby.MOST:
            found = nearby.pairs(Suggestor.build(queries, column).words, self.words, distance)
        else:
            pairs = self.candidates(queries, column, distance)
            near = F.when(F.col("edits") <= 1, F.col("edits")).when(fuzzy.one_edit_or_swap(F.col("query"), F.col("value")), 1).otherwise(2)
            far = F.col("edits") > 2
            steps = F.when(far, fuzzy_udf.osa(F.when(far, F.col("query")), F.when(far, F.col("value")), distance + 1).cast("int")).otherwise(near)
            found = pairs.withColumn("distance", steps).drop("edits").where(F.col("distance") <= distance)
        if verbosity in (TOP, CLOSEST):
            best = F.min("distance").over(Window.partitionBy("query"))
            found = found.withColumn("__best", best)
            found = found.where(F.col("distance") == F.col("__best") if verbosity == CLOSEST else (F.col("__best") > 0) | (F.col("distance") == 0)).drop("__best")
        return found.withColumn("similarity", fuzzy.distance_to_similarity(F.col("distance").cast("double")))


def ranked(results: DataFrame) -> DataFrame:
    """Suggestions of each query, the best first."""
    return results.orderBy("query", F.desc("similarity"), "distance", "value")


@dataclass
class PlateIndex:
    """Suggestions on normalised plates, ranked by keyboard and looks."""

    suggestor: Suggestor

    @classmethod
    def build(cls, df: DataFrame, column: str, distance: int = 2) -> PlateIndex:
        return cls(Suggestor.build(df.select(fuzzy.normalize_plate(F.col(column)).alias("value")), "value", distance))

    def items(self) -> DataFrame:
        return self.suggestor.items()

    def contains(self, probes: DataFrame, column: str = "value") -> DataFrame:
        keyed = probes.withColumn("__plate", fuzzy.normalize_plate(F.col(column)))
        return keyed.join(self.items().withColumnRenamed("value", "__value"), F.col("__plate") == F.col("__value"), "left_semi").drop("__plate")

    def add(self, df: DataFrame, column: str = "value") -> PlateIndex:
        return PlateIndex(self.suggestor.add(df.select(fuzzy.normalize_plate(F.col(column)).alias("value"))))

    def remove(self, df: DataFrame, column: str = "value") -> PlateIndex:
        return PlateIndex(self.suggestor.remove(df.select(fuzzy.normalize_plate(F.col(column)).alias("value"))))

    def lookup(self, queries: DataFrame, column: str = "query", distance: int = -1, verbosity: str = ALL) -> DataFrame:
        """query, value, distance, combined (0 is best), similarity of the combined distance."""
        plates = queries.select(fuzzy.normalize_plate(F.col(column)).alias("query"))
        found = self.suggestor.lookup(plates, "query", distance, verbosity).drop("similarity")
        found = found.withColumn("combined", fuzzy_udf.combined_distance(F.col("query"), F.col("value")))
        return found.withColumn("similarity", fuzzy.distance_to_similarity(F.col("combined")))
