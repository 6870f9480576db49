"""Secret scans: three rules by pattern, and sliding-window Shannon entropy for what they miss. SQL functions only.

Rules ``assign``, ``access`` and ``hex`` give the base spans. Where each match of a pattern lies follows from the lengths
of the pieces that the same pattern splits the text into.

``entropy`` looks at candidate strings: runs of at least ``WINDOW`` characters of ``ALPHABET`` with a digit (two where letters have one case) and a letter.
Each has a character class (hex digits, letters of one case and digits, letters and digits, base64 with its signs) with a
bound of its own: ``BOUNDS`` are the entropies that 99 % of random strings of the class and of ``WINDOW`` characters reach.
A window slides over the candidate; each step takes one character out of the window's counts and one in, and adds to
the sum of c * log2(c) what that count's change makes of it; the largest entropy decides. Candidates on the allow-list are suppressed:
UUIDs, digests of integrity attributes, placeholders, and paths or joined words, whose pieces are words or numbers or
words that end in a number. So are those that overlap a base span. Base spans are never suppressed.

Defined results: a null text counts as empty and has no spans; positions are code points, ends exclusive; other columns
are carried along untouched; where one has the name of a result, in any case, the result's name gets an underscore more;
repeated rows get the same spans; an empty table gives no rows. Work is in proportion to a text's length, however long
it or a candidate in it is, or how many matches it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import placed
from .shared import free_names, let, own_columns, running, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs that the rules' own patterns find and that are long enough; shorter runs can't hold a longer match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WINDOW = 20
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 8
#: Bits a character: patterns of the classes, the narrowest first, and the 1 % quantile of their random strings of 20 characters.
BOUNDS = [("^[0-9a-fA-F]+$", 2.9), ("^([0-9a-z]+|[0-9A-Z]+)$", 3.4), ("^[0-9A-Za-z]+$", 3.64), ("", 3.64)]
#: What no word, number or word that ends in a number holds; strings of both cases have two of them at least.
INSIDE = "[0-9][A-Za-z]|[a-z][A-Z]|[A-Z][A-Z][a-z]"
ONE_CASE = "^([^A-Z]+|[^a-z]+)$"
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(256|384|512)-|example|sample|placeholder|xxxx|0123456789|abcdefgh"
#: Weights c * log2(c) are whole numbers of this part of a bit, so that sums don't drift.
UNIT = 1 << 40


def _weights(window: int) -> list[int]:
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of a window of the string, in bits a character; null for shorter strings.

    Characters outside ``ALPHABET`` count as one.
    """
    weight = _weights(window)
    gain = F.array(*[F.lit(b - a) for a, b in zip(weight, weight[1:])])
    slots = len(ALPHABET) + 1
    #: Counts are the characters of a text from ``base`` on, one for each slot; a step changes one of them.
    base = 48
    start = F.struct(F.lit(chr(base) * slots).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("least"))

    def events(places: Column) -> Column:
        """Slots that enter, by ``slots`` larger where the window is full then; negative where a character leaves."""
        entering = F.transform(places, lambda s, i: F.when(i < window - 1, F.array(s)).when(i < window, F.array(s + slots)).otherwise(F.array(-F.get(places, i - window), s + slots)))
        return F.flatten(entering)

    def step(state: Column, event: Column) -> Column:
        def moved(x: Column) -> Column:
            count = F.ascii(F.substring(state["counts"], x["slot"], F.lit(1))) - base
            total = F.when(event > 0, state["total"] + F.get(gain, count)).otherwise(state["total"] - F.get(gain, count - 1))
            counts = F.overlay(state["counts"], F.char(count + base + F.sign(event).cast("int")), x["slot"], F.lit(1))
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(event > slots, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

        return let(F.struct(F.when(event > slots, event - slots).otherwise(F.abs(event)).alias("slot")), moved)

    places = F.transform(F.split(string, ""), lambda c: let(F.instr(F.lit(ALPHABET), c), lambda s: F.when(s == 0, slots).otherwise(s)))
    least = let(places, lambda p: F.aggregate(events(p), start, step, lambda s: s["least"]))
    return F.when(F.length(string) >= window, F.log2(F.lit(float(window))) - least / float(UNIT * window))


def looks_random(string: Column) -> Column:
    """Whether a candidate's class and entropy make it a secret and the allow-list does not speak for it."""

    def judged(s: Column) -> Column:
        letters = F.regexp_like(s, F.lit("[A-Za-z]"))
        one_case = F.regexp_like(s, F.lit(ONE_CASE))
        digits = F.regexp_like(s, F.lit("[0-9]")) & (~one_case | F.regexp_like(s, F.lit("[0-9].*[0-9]")))
        inside = F.regexp_count(s, F.lit(INSIDE)) >= F.when(one_case, 1).otherwise(2)
        bound = F.coalesce(*[F.when(F.regexp_like(s, F.lit(p)), F.lit(b)) for p, b in BOUNDS])
        return F.when(digits & letters & inside & ~F.regexp_like(s, F.lit(ALLOWED)), window_entropy(s) >= bound).otherwise(F.lit(False))

    return let(string, judged)


def _found(text: Column, pattern: str, rank: int, value_group: int | None = None) -> Column:
    """array<struct<start, rank, end, match>>; match: the whole of it, or a group of it."""
    spans = placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group or 0))
    made = let(values, lambda v: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.get(v, i).alias("match"))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,match:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(none)


def _clear_of(candidates: Column, base: Column) -> Column:
    """The candidates that no base span overlaps. Both are walked in order, forwards for ends and backwards for starts."""
    entropy = KINDS.index("entropy")

    def both(spans: Column) -> Column:
        ends = running(spans, F.lit(0), lambda s, x: F.when(x["rank"] < entropy, F.greatest(s, x["end"])).otherwise(s))
        starts = F.reverse(running(F.reverse(spans), F.lit(2**31 - 1), lambda s, x: F.when(x["rank"] < entropy, x["start"]).otherwise(s)))
        flagged = let(ends, lambda e: let(starts, lambda b: F.transform(spans, lambda x, i: F.struct(x.alias("span"), ((F.get(e, i) <= x["start"]) & (F.get(b, i) >= x["end"])).alias("clear")))))
        return F.transform(F.filter(flagged, lambda x: x["clear"] & (x["span"]["rank"] == entropy)), lambda x: x["span"])

    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, candidates)), both)).otherwise(candidates)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


RESULTS = (*(f"n_{k}" for k in KINDS), "base_spans", "spans")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_entropy, base_spans and spans (array<struct<start, rank, end, match>>)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    *found, base, entropy = free_names(docs, *(f"__qs_{k}" for k in KINDS), "__qs_base", "__qs_fresh")
    of = dict(zip(KINDS, found))
    out = docs.withColumns({of[k]: _found(text, p, i, 2 if k == "assign" else None) for i, (k, p) in enumerate(rules.items())})
    out = out.withColumn(of["assign"], F.filter(of["assign"], lambda s: F.length(s["match"]) >= LEAST_VALUE))
    out = out.withColumn(base, F.concat(*[of[k] for k in KINDS[:3]]))
    out = out.withColumn(entropy, F.filter(_clear_of(F.col(of["entropy"]), F.col(base)), lambda s: looks_random(s["match"])))
    results = [*(F.size(of[k]).cast("long") for k in KINDS[:3]), F.size(entropy).cast("long"), F.col(base), F.concat(base, entropy)]
    return out.select(*own_columns(docs), *(r.alias(n) for r, n in zip(results, free_names(docs, *RESULTS))))


def query(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    found = ", ".join(f"regexp_extract_all(t, {quoted(p)}) AS m_{k}, string_split_regex(t, {quoted(p)}) AS p_{k}" for k, p in patterns.items())
    placed_at = ", ".join(
        f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': list_sum(list_transform(p_{k}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda x: length(x))), 0)::BIGINT, 'r': {r}, 'n': length(m_{k}[i]), 'm': m_{k}[i], 'i': i}}) AS s_{k}"
        for r, k in enumerate(KINDS)
    )
    entropy = f"list_max(list_transform(range(1, length(x.m) - {WINDOW} + 2), lambda j: -list_sum(list_transform(list_distinct(string_split(substr(x.m, j::INT, {WINDOW}), '')), lambda c: ({WINDOW} - length(replace(substr(x.m, j::INT, {WINDOW}), c, ''))) / {WINDOW}.0 * log2(({WINDOW} - length(replace(substr(x.m, j::INT, {WINDOW}), c, ''))) / {WINDOW}.0)))))"
    inside = f"len(regexp_extract_all(x.m, {quoted(INSIDE)})) >= CASE WHEN regexp_matches(x.m, {quoted(ONE_CASE)}) THEN 1 ELSE 2 END"
    bound = "CASE " + " ".join(f"WHEN regexp_matches(x.m, {quoted(p)}) THEN {b}" for p, b in BOUNDS) + " END"
    digits = f"regexp_matches(x.m, CASE WHEN regexp_matches(x.m, {quoted(ONE_CASE)}) THEN '[0-9].*[0-9]' ELSE '[0-9]' END)"
    random = f"{digits} AND regexp_matches(x.m, '[A-Za-z]') AND NOT regexp_matches(x.m, {quoted(ALLOWED)}) AND {inside} AND {entropy} >= {bound}"
    text = "array_to_string(list_transform(list_sort(list_transform({0}, lambda x: {{'s': x.s, 'r': x.r, 'e': x.s + x.n}})), lambda x: ['assign', 'access', 'hex', 'entropy'][x.r + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, {quoted(ASSIGN)}, 2) AS v, {found} FROM d),
s AS (SELECT doc_id, v, {placed_at} FROM m),
b AS (SELECT doc_id, list_filter(s_assign, lambda x: length(v[x.i]) >= {LEAST_VALUE}) AS s_assign, s_access, s_hex, s_entropy FROM s),
c AS (SELECT *, list_concat(list_concat(s_assign, s_access), s_hex) AS base FROM b),
e AS (SELECT *, list_filter(s_entropy, lambda x: len(list_filter(base, lambda y: y.s < x.s + x.n AND x.s < y.s + y.n)) = 0 AND {random}) AS fresh FROM c)
SELECT doc_id, len(s_assign) AS n_assign, len(s_access) AS n_access, len(s_hex) AS n_hex, sha256({text.format("base")}) AS base_sha256, {text.format("list_concat(base, fresh)")} AS spans
FROM e
"""


ORACLE = _oracle()
