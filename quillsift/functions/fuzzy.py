"""Fuzzy string functions as Columns; those that need Python are in ``fuzzy_udf``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .characters import alike_pairs, keyboard_reach, keyboard_table, ordered, visual_table

ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Latin letters with marks and what is left of them without.
_MARKED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ",
    "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_FROM = "".join(m + m.upper() if len(m.upper()) == len(m) else m for m in _MARKED.values())
_TO = "".join(c * len(m) + c.upper() * len(m) if len(m.upper()) == len(m) else c * len(m) for c, m in _MARKED.items())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def bigrams(text: Column, allowed: str | None = None) -> Column:
    """Pairs of adjacent characters; with ``allowed``, those of two allowed characters."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    if allowed is not None:
        pairs = F.filter(pairs, lambda g: (F.instr(F.lit(allowed), F.substring(g, 1, 1)) > 0) & (F.instr(F.lit(allowed), F.substring(g, 2, 1)) > 0))
    return pairs


def dice(a: Column, b: Column, allowed: str | None = None) -> Column:
    """Twice the common bigrams over all bigrams, as multisets; 0 where there are none."""

    def score(both: Column) -> Column:
        x, y = both["x"], both["y"]
        common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(x, lambda h: h == g)), F.size(F.filter(y, lambda h: h == g))))
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * common / total)

    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(let(F.struct(bigrams(a, allowed).alias("x"), bigrams(b, allowed).alias("y")), score))


def dice_pairs(words: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    """All pairs (x, y, score) of distinct values that share a bigram: bigrams meet in an equi-join, never all pairs."""
    grams = words.select(F.col(column).alias("w")).distinct().select("w", F.explode(bigrams(F.col("w"))).alias("g")).groupBy("w", "g").agg(F.count(F.lit(1)).alias("c"))
    totals = F.size(bigrams(F.col("x"))) + F.size(bigrams(F.col("y")))
    left = grams.select(F.col("w").alias("x"), "g", F.col("c").alias("cx"))
    right = grams.select(F.col("w").alias("y"), "g", F.col("c").alias("cy"))
    common = left.join(right, "g").where("x < y").groupBy("x", "y").agg(F.sum(F.least("cx", "cy")).alias("common"))
    return common.select("x", "y", (2.0 * F.col("common") / totals).alias("score")).where(F.col("score") >= least)


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Unit-cost edit distance; with ``most``, that value from there on."""
    if most is None:
        return F.levenshtein(a, b)
    found = F.levenshtein(a, b, most)
    return F.when(found == -1, F.lit(most)).otherwise(F.least(found, F.lit(most)))


def levenshtein_slice(a: Column, a_start: int, a_length: int, b: Column, b_start: int, b_length: int) -> Column:
    """Edit distance of substrings, counted from 0."""
    return F.levenshtein(F.substring(a, a_start + 1, a_length), F.substring(b, b_start + 1, b_length))


def one_edit_or_swap(a: Column, b: Column) -> Column:
    """Whether the distance with adjacent swaps is at most 1, on the JVM side."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


def _lookup(table: dict[tuple[str, str], float], a: Column, b: Column) -> Column:
    """The value of a pair of characters, null if the table lacks it.

    The table is one constant array, indexed by the characters' places in its alphabet, so a lookup takes no search.
    """
    letters = "".join(sorted({c for pair in table for c in pair}))
    cells = ",".join(repr(table[ordered(p, q)]) if ordered(p, q) in table else "null" for p in letters for q in letters)
    values = F.from_json(F.lit(f"[{cells}]"), "array<double>")  # folded to a literal when the plan is optimised
    row, column = F.instr(F.lit(letters), a), F.instr(F.lit(letters), b)
    return F.when((row > 0) & (column > 0) & (F.length(a) == 1) & (F.length(b) == 1), F.get(values, (row - 1) * len(letters) + column - 1))


def key_distance(a: Column, b: Column, unknown: float = 1.0) -> Column:
    """Distance of two characters on the keyboard."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, F.lit(0.0)).otherwise(F.coalesce(_lookup(keyboard_table(), x, y), F.lit(unknown)))


def keyboard_distance(a: Column, b: Column, unknown: float = 1.0, missing: float = -1, extra: float = -1) -> Column:
    """Sum of key distances place by place, and the difference in length at the given costs; below 0: the largest distance."""
    x, y = F.lower(a), F.lower(b)

    def at(i: Column) -> Column:
        p, q = F.substring(x, i, F.lit(1)), F.substring(y, i, F.lit(1))
        return F.when(p == q, F.lit(0.0)).otherwise(F.coalesce(_lookup(keyboard_table(), p, q), F.lit(unknown)))

    both = F.least(F.length(x), F.length(y))
    total = F.when(both > 0, F.aggregate(F.sequence(F.lit(1), both), F.lit(0.0), lambda s, i: s + at(i))).otherwise(F.lit(0.0))
    longer = F.length(x) - F.length(y)
    reach = keyboard_reach()
    return total + F.when(longer < 0, -longer * F.lit(reach if extra < 0 else extra)).otherwise(longer * F.lit(reach if missing < 0 else missing))


def keyboard_similarity(a: Column, b: Column, unknown: float = 1.0, missing: float = -1, extra: float = -1) -> Column:
    """1 for equal strings, 0 for the worst match."""
    return 1 - keyboard_distance(a, b, unknown, missing, extra) / (F.greatest(F.length(a), F.length(b)) * F.lit(keyboard_reach()))


def key_similarity(a: Column, b: Column, unknown: float = 1.0) -> Column:
    return 1 - key_distance(a, b, unknown) / F.lit(keyboard_reach())


def visual_similarity(a: Column, b: Column) -> Column:
    """Similarity of two letters; null if the pair is not rated."""
    return F.when(a == b, F.lit(1.0)).otherwise(_lookup(visual_table(), a, b))


def looks_alike(a: Column, b: Column) -> Column:
    return (a == b) | _lookup(dict.fromkeys(alike_pairs(), 1.0), a, b).isNotNull()


def table_frame(spark, table: dict[tuple[str, str], float]) -> DataFrame:
    """A character table as (c1, c2, value), to be joined; c1 < c2."""
    return spark.createDataFrame([(*ordered(a, b), float(v)) for (a, b), v in sorted(table.items())], "c1 string, c2 string, value double")


def strip_diacritics(text: Column) -> Column:
    """Letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}+", "")


def normalize(text: Column) -> Column:
    return F.lower(strip_diacritics(F.trim(text)))


def normalize_plate(text: Column) -> Column:
    return F.upper(strip_diacritics(F.trim(text)))


def stable_hash(text: Column) -> Column:
    """FNV-1a with 32 bits over UTF-16 units, signed."""
    units = F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})")
    folded = F.aggregate(F.filter(units, lambda u: u != ""), F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.when(folded >= 2147483648, folded - 4294967296).otherwise(folded)


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest value; an empty array stays empty."""
    powers = let(F.array_max(values), lambda largest: F.transform(values, lambda v: F.exp(v - largest)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda v: v / t)))


def _scaled(v: Column, ends: Column) -> Column:
    return F.when(ends["high"] > ends["low"], (v - ends["low"]) / (ends["high"] - ends["low"])).otherwise(F.lit(0.0))


def _ends(values: Column) -> Column:
    return F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))


def min_max(values: Column) -> Column:
    """An array scaled to 0..1; equal values give 0."""
    return let(_ends(values), lambda ends: F.transform(values, lambda v: _scaled(v, ends)))


def min_max_matrix(rows: Column) -> Column:
    """An array of arrays scaled by its overall extremes."""
    return let(_ends(F.flatten(rows)), lambda ends: F.transform(rows, lambda row: F.transform(row, lambda v: _scaled(v, ends))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def distance_to_similarity(x: Column) -> Column:
    """1 at distance 0, towards 0 for large ones."""
    return 2 - 2 * sigmoid(x)
