"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. As many complete epochs of the source as fit into the target come first; the
rest is a weighted sample without replacement: every document gets an exponential key whose rate is its quality weight,
and documents are taken by ascending key until the budget is spent, which cuts at most one document of each source.

A source may hold any share of the rows, so keys are first summed up in ``BUCKETS`` ranges per source (partial sums on
the map side). The prefix sum over these ranges shows the one range in which the budget ends; only the documents of that
range are sorted, all others are decided by their range alone.

Defined results: a null text has no words; null is a source of its own, after all others; a source without words has
target 0; rows that are equal in all that matters share one fate up to their order; rows without an id have the key of
their text; other columns are carried along untouched whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, free_names, materialize, own_columns, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3
BUCKETS = 4096
#: Rates of the keys, by ``labels.quality``: a better document is met earlier.
QUALITY = {1: 2.0, 0: 0.5}


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(identity: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, where u in (0, 1) comes from a digest of the identity, so that reruns agree."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def identity_of(id_col: str, text_col: str) -> Column:
    """The id, or a digest of the text where there is none, lest all rows without an id have one key."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target: the words of all sources, shared by weight, none above ``most`` epochs.

    One row per source. Sorted by cap over weight, the first source whose cap isn't reached by the share that is left
    after all caps before it gives the level, and every target is the lesser of cap and level times weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__qs_n", F.row_number().over(by_name) - 1).withColumn("__qs_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__qs_n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__qs_cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("__qs_cap") / F.col("__qs_w"), "__qs_n")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum("__qs_cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__qs_cap"))) / F.sum("__qs_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("__qs_level", level).withColumn("__qs_pos", F.row_number().over(rising))
    first = F.min(F.when(F.col("__qs_cap") / F.col("__qs_w") >= F.col("__qs_level"), F.struct("__qs_pos", "__qs_level"))).over(everything)
    return levelled.select(*sizes.columns, F.least("__qs_cap", first["__qs_level"] * F.col("__qs_w")).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row. ``weight``: quality, above 0; 1 where not given."""
    quality = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-9))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), exponential_key(identity_of(id_col, text_col), quality, seed).alias("key"))
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    return _taken(materialize(rows, "keys"), weights, most)


def _taken(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    ranges = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = materialize(targets, "targets")
    # at most BUCKETS rows for each source
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    named = targets.select(F.col("source").alias("__qs_source"), "budget")
    ends = ranges.withColumn("before", before).join(named, F.col("source").eqNullSafe(F.col("__qs_source")))
    ends = ends.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
    ends = ends.select(F.col("__qs_source").alias("__qs_end"), F.col("bucket").alias("end"), "before")
    plan = targets.withColumnRenamed("source", "__qs_source").join(ends, F.col("__qs_source").eqNullSafe(F.col("__qs_end")), "left").select("__qs_source", "source_size", "target", "epochs", "budget", F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("before", F.lit(0)).alias("before"))
    placed = rows.join(materialize(plan, "plan"), F.col("source").eqNullSafe(F.col("__qs_source")))
    by_range = placed.where(F.col("bucket") != F.col("end")).withColumn("part", F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("budget") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    by_sort = placed.where(F.col("bucket") == F.col("end")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = by_range.unionByName(by_sort)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``__qs_weight`` from labels.quality; several labels of a document: the best counts."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__qs_label")).agg(F.max("quality").alias("__qs_quality"))
    rate = F.coalesce(*[F.when(F.col("__qs_quality") == q, F.lit(w)) for q, w in QUALITY.items()], F.lit(1.0))
    return docs.join(best, F.col("doc_id") == F.col("__qs_label"), "left").withColumn("__qs_weight", rate).drop("__qs_label", "__qs_quality")


def _keyed(slim: DataFrame, labels: DataFrame, seed: str, keep_id: bool = False) -> DataFrame:
    """The written table of (doc_id, source, size, key, bucket) of slim rows; the key comes from ``identity``."""
    rows = quality_weight(slim, labels).select(*(["doc_id"] if keep_id else [F.col("identity").alias("doc_id")]), "source", "size", exponential_key(F.col("identity"), F.col("__qs_weight"), seed).alias("key"))
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    return materialize(rows, "keys")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", identity_of("doc_id", "text").alias("identity"), "source", words_in(F.col("text")).alias("size"))
    return _taken(_keyed(slim, table(spark, sf_dir, "labels"), "mix", keep_id=True), WEIGHTS, MOST_EPOCHS).drop("source")


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix has them: each row as often as its words are taken, whole; the one document of a source that
    the budget cuts counts as taken if at least half of it fits. Rows without words are in the mix as often as their
    source has complete epochs, and are gone where it has none. The texts are shuffled once, by document.
    """
    key, times, copy = free_names(docs, "__qs_key", "__qs_copies", "__qs_copy")
    # rows equal in every column share one decision, so each of them gets its own copies and no more
    identity = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*own_columns(docs)).cast("string"))
    slim = docs.select("doc_id", identity.alias("identity"), "source", words_in(F.col("text")).alias("size"))
    taken = _taken(_keyed(slim, labels, seed), weights, most)
    share = F.when(F.sum("size") > 0, F.sum("taken") / F.sum("size")).otherwise(F.floor(F.max(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))))
    copies = taken.groupBy(F.col("doc_id").alias(key)).agg(F.round(share).cast("int").alias(times)).where(F.col(times) > 0)
    joined = docs.withColumn(key, identity).join(copies, key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*own_columns(docs))


ORACLE = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
             / CASE l.q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n
    FROM d GROUP BY source
), v AS (
    SELECT *, 3.0 * source_size::DOUBLE AS cap,
           (sum(source_size) OVER ()::DOUBLE - (sum(3.0 * source_size::DOUBLE) OVER (ORDER BY 3.0 * source_size::DOUBLE / w, n) - 3.0 * source_size::DOUBLE)) / sum(w) OVER (ORDER BY 3.0 * source_size::DOUBLE / w DESC, n DESC) AS level,
           row_number() OVER (ORDER BY 3.0 * source_size::DOUBLE / w, n) AS pos
    FROM s
), t AS (
    SELECT source, source_size, least(cap, w * (SELECT arg_min(level, pos) FROM v WHERE cap / w >= level)) AS target FROM v
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
    SELECT doc_id, size, source_size, target, epochs, round(target - epochs * source_size)::BIGINT AS budget,
           sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, budget - before)) AS taken FROM r
"""
