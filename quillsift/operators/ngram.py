"""An n-gram index for substring search.

Items and postings are tables; a search takes the longest n-grams of the pattern's literal runs, finds the items that
have all of them by an equi-join and a count, and verifies these with LIKE. Patterns without a run that is long enough
fall back to a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CONTAINS, Wildcard, _ESCAPE


def grams(text: Column, low: int, high: int) -> Column:
    """array<struct<gram, start>> of all n-grams, n from ``low`` to ``high`` or the text's length, long ones first."""
    size = F.length(text)
    longest = F.least(size, F.lit(high))

    def of_size(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(F.substring(text, i + 1, n).alias("gram"), i.alias("start")))

    return F.when(size >= low, F.flatten(F.transform(F.sequence(longest, F.lit(low), F.lit(-1)), of_size))).otherwise(F.array().cast("array<struct<gram:string,start:int>>"))


@dataclass
class NGramIndex:
    items: DataFrame  # value
    postings: DataFrame  # gram, value, start
    low: int = 2
    high: int = 3

    @classmethod
    def build(cls, df: DataFrame, column: str, low: int = 2, high: int = 3) -> NGramIndex:
        if low < 2 or high < low:
            raise ValueError("n-grams have two characters at least, and the most is not below the least")
        items = df.select(F.col(column).alias("value")).where("value is not null and value <> ''").distinct()
        return cls(items, cls._postings(items, low, high), low, high)

    @staticmethod
    def _postings(items: DataFrame, low: int, high: int) -> DataFrame:
        return items.select("value", F.explode(grams(F.col("value"), low, high)).alias("g")).select("g.gram", "value", "g.start")

    def add(self, df: DataFrame, column: str = "value") -> NGramIndex:
        new = df.select(F.col(column).alias("value")).where("value is not null and value <> ''").distinct().join(self.items, "value", "left_anti")
        return NGramIndex(self.items.unionByName(new), self.postings.unionByName(self._postings(new, self.low, self.high)), self.low, self.high)

    def remove(self, df: DataFrame, column: str = "value") -> NGramIndex:
        gone = df.select(F.col(column).alias("value"))
        return NGramIndex(self.items.join(gone, "value", "left_anti"), self.postings.join(gone, "value", "left_anti"), self.low, self.high)

    def clear(self) -> NGramIndex:
        return NGramIndex(self.items.limit(0), self.postings.limit(0), self.low, self.high)

    def contains(self, probes: DataFrame, column: str = "value") -> DataFrame:
        return probes.join(self.items.withColumnRenamed("value", "__value"), F.col(column) == F.col("__value"), "left_semi")

    def query_grams(self, pattern: Wildcard) -> list[str]:
        """Distinct windows over the literal runs, as long as the index has them."""
        found = {}
        for run in pattern.literal_runs():
            n = min(len(run), self.high)
            if n >= self.low:
                found.update(dict.fromkeys(run[i : i + n] for i in range(len(run) - n + 1)))
        return list(found)

    def rarest(self, wanted: list[str], most: int) -> list[str]:
        """The ``most`` n-grams with the fewest postings; one that has none decides alone."""
        found = {r["gram"]: r["count"] for r in self.postings.where(F.col("gram").isin(wanted)).groupBy("gram").count().collect()}
        return sorted(wanted, key=lambda g: (found.get(g, 0), g))[:most]

    def search(self, pattern: str, option: str = CONTAINS, most: int | None = None) -> DataFrame:
        """Items (value) that match a wildcard pattern; ``most``: only so many of the pattern's rarest n-grams are looked up."""
        wildcard = Wildcard(pattern, option)
        wanted = self.query_grams(wildcard)
        if not wanted:
            return self.items.where(wildcard.is_match(F.col("value")))
        if most is not None and len(wanted) > most:
            wanted = self.rarest(wanted, most)
        hits = self.postings.where(F.col("gram").isin(wanted)).groupBy("value").agg(F.count_distinct("gram").alias("n"))
        return hits.where(F.col("n") == len(wanted)).select("value").where(wildcard.is_match(F.col("value")))

    def search_all(self, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
        """(pattern, value) of a table of substrings to find anywhere: postings meet the rarest gram of each, then LIKE decides."""
        probes = patterns.select(F.col(pattern).alias("pattern")).distinct()
        long_enough = F.length("pattern") >= self.low
        size = F.least(F.length("pattern"), F.lit(self.high))
        grams = F.transform(F.sequence(F.lit(1), F.length("pattern") - size + 1), lambda i: F.substring(F.col("pattern"), i, size))
        grams = probes.where(long_enough).select("pattern", F.explode(F.array_distinct(grams)).alias("gram"))
        often = self.postings.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
        rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram"))["gram"]
        probe = grams.join(often, "gram", "left").groupBy("pattern").agg(rarest.alias("gram"))
        like = F.concat(F.lit("%"), F.regexp_replace("pattern", "([%_!])", "!$1"), F.lit("%"))
        hits = probe.join(self.postings.select("gram", "value").distinct(), "gram").where(F.like("value", like, F.lit(_ESCAPE))).select("pattern", "value")
        short = probes.where(~long_enough & (F.length("pattern") > 0))
        letters = self.items.select("value", F.explode(F.array_distinct(F.split("value", ""))).alias("__c"))
        return hits.unionByName(short.join(letters, F.col("pattern") == F.col("__c")).select("pattern", "value"))

    def stats(self) -> DataFrame:
        """n, postings and distinct grams for each length."""
        return self.postings.groupBy(F.length("gram").alias("n")).agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("gram").alias("grams"))

    def lengths(self) -> DataFrame:
        """Items by length."""
        return self.items.groupBy(F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("items"))
