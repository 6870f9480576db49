"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary finds the digests that may hold a large share of all rows. Their exact counts and winners are
verified, and the verified ones (at most ``1 / share`` by arithmetic, whatever the input) are broadcast, so that copies
of frequent texts are settled on the map side and never meet in one task. All other digests, none of which holds more
than ``share`` of the rows, go through an ordinary shuffle of slim rows: an aggregation, and a join that Spark may split.

Texts are compared by SHA-256 of the text with A-Z lower-cased.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays, a null id is smaller
than any other; among rows equal in text and id one stays; an empty table gives an empty result; other columns are
carried along untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, lower_ascii, materialize, own_columns

#: A digest that holds at least this share of the rows is a heavy hitter; so there are at most 1000.
HEAVY_SHARE = 0.001
#: Counters of the Misra-Gries summary: its error, 3.5 / TRACKED of the rows, is far below HEAVY_SHARE.
TRACKED = 16384


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def heavy_winners(digests: DataFrame, order: Column, share: float = HEAVY_SHARE) -> DataFrame:
    """Digests holding at least ``share`` of the rows, with exact count and the largest ``order``: at most 1 / share rows."""
    most = round(1 / share)
    rows = digests.count()
    found = digests.agg(F.expr(f"approx_top_k(__qs_digest, {most}, {TRACKED})").alias("top")).select(F.explode("top").alias("top")).select(F.col("top.item").alias("__qs_digest"))
    return (
        digests.join(F.broadcast(found), "__qs_digest")
        .groupBy("__qs_digest")
        .agg(F.count(F.lit(1)).alias("__qs_size"), F.max(order).alias("__qs_winner"))
        .where(F.col("__qs_size") * most >= rows)
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("__qs_id"), text_digest(F.col(text_col)).alias("__qs_digest"), F.monotonically_increasing_id().alias("__qs_row"))
    rows = materialize(rows, "digests")
    heavy = F.broadcast(heavy_winners(rows, F.struct("__qs_id", "__qs_row"), share))
    of_heavy = rows.join(heavy, "__qs_digest").select(
        F.col("__qs_id").alias(id_col),
        F.col("__qs_winner.__qs_id").alias("keep_id"),
        F.col("__qs_size").alias("group_size"),
        (F.col("__qs_row") == F.col("__qs_winner.__qs_row")).alias("kept"),
        F.col("__qs_digest").alias("text_sha256"),
    )
    rest = rows.join(heavy.select("__qs_digest"), "__qs_digest", "left_anti")
    # written, so that the join has an exchange on either side, and Spark can split a digest that many rows share
    winners = materialize(rest.groupBy("__qs_digest").agg(F.max(F.struct("__qs_id", "__qs_row")).alias("__qs_winner"), F.count(F.lit(1)).alias("__qs_size")), "winners")
    of_rest = rest.join(winners, "__qs_digest").select(
        F.col("__qs_id").alias(id_col),
        F.col("__qs_winner.__qs_id").alias("keep_id"),
        F.col("__qs_size").alias("group_size"),
        (F.col("__qs_row") == F.col("__qs_winner.__qs_row")).alias("kept"),
        F.col("__qs_digest").alias("text_sha256"),
    )
    return of_heavy.unionByName(of_rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = HEAVY_SHARE) -> DataFrame:
    """The rows that stay, with all their columns.

    Which rows go is decided on ids and digests alone. Copies of a heavy hitter go on the map side; the texts are joined
    with the other groups that have copies, one row a group.
    """
    digest, winner, heavy_winner, is_heavy, top, rank = free_names(docs, *(f"__qs_{n}" for n in ("text_digest", "best", "heavy_best", "heavy", "top", "rank")))
    keyed = docs.withColumn(digest, text_digest(F.col(text_col)))
    slim = materialize(keyed.select(F.col(id_col).alias("__qs_id"), F.col(digest).alias("__qs_digest")), "digests")
    heavy = materialize(heavy_winners(slim, F.col("__qs_id"), share), "heavy")
    # a group's largest id, and how many rows have it
    found = slim.groupBy("__qs_digest", "__qs_id").agg(F.count(F.lit(1)).alias("n")).groupBy("__qs_digest").agg(F.max(F.struct("__qs_id", "n")).alias("best"), F.sum("n").alias("size"))
    copied = found.where("size > 1").select(F.col("__qs_digest").alias(digest), F.col("best.__qs_id").alias(winner), F.col("best.n").alias(top))
    copied = materialize(copied, "copied")
    left = keyed.join(F.broadcast(heavy.select(F.col("__qs_digest").alias(digest), F.col("__qs_winner").alias(heavy_winner), F.lit(True).alias(is_heavy))), digest, "left")
    left = left.where(F.col(is_heavy).isNull() | F.col(id_col).eqNullSafe(F.col(heavy_winner)))
    left = left.join(copied, digest, "left").where(F.col(top).isNull() | F.col(id_col).eqNullSafe(F.col(winner)))
    if copied.where(F.col(top) > 1).isEmpty():
        return left.select(*own_columns(docs))
    # rows that are equal in text and id differ in nothing that matters but need one fixed order
    order = Window.partitionBy(digest).orderBy(F.xxhash64(*own_columns(docs)))
    again = left.where(F.col(top) > 1).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return left.where(F.coalesce(F.col(top), F.lit(1)) == 1).select(*own_columns(docs)).union(again.select(*own_columns(docs)))


def query(spark, sf_dir):
    from .shared import table

    return copy_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
