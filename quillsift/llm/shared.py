"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import let, running
from ..sources.snapshots import discard, materialize

__all__ = ["crc_mod", "discard", "free_names", "let", "lower_ascii", "materialize", "own_columns", "running", "table"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Lower-cases A-Z in bytes; ``bytes.split()`` then splits at 0x20 and 0x09-0x0D only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does just that on pure ASCII, and has a fast path there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with as many underscores behind each as keep it apart from the columns of ``docs`` in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
