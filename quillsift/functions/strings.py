"""Exact substring search; positions count from 0, -1 means not found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(text: Column, pattern: str, start: int = 0, count: int | None = None) -> Column:
    """The first position from ``start`` on, within ``count`` characters; an empty pattern is found at ``start``."""
    if pattern == "":
        return F.when(text.isNotNull(), F.lit(start))
    if count is not None:
        text = F.substring(text, 1, start + count)
    return F.locate(pattern, text, start + 1) - 1


def last_index_of(text: Column, pattern: str) -> Column:
    """The last position."""
    if pattern == "":
        return F.length(text)
    backwards = F.locate(pattern[::-1], F.reverse(text))
    return F.when(text.isNull(), None).when(backwards == 0, -1).otherwise(F.length(text) - len(pattern) - backwards + 1)


def index_of_bytes(data: Column, pattern: bytes, start: int = 0) -> Column:
    """The first position in binary data."""
    return index_of(F.decode(data, "ISO-8859-1"), pattern.decode("ISO-8859-1"), start)


def last_index_of_bytes(data: Column, pattern: bytes) -> Column:
    return last_index_of(F.decode(data, "ISO-8859-1"), pattern.decode("ISO-8859-1"))


#: Elements after which a running state moves on to a new piece of its result.
_PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a function in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each element of an array: ``step(state, element)`` from ``zero`` on.

    Arrays grow by copying, so states are gathered in pieces of ``_PIECE``, and the pieces are joined.
    """

    def whole(v: Column) -> Column:
        def piece(out: Column, n: Column) -> Column:
            first = n * _PIECE
            at = F.sequence(first, F.least(first + _PIECE, F.size(v)) - 1)
            states = F.aggregate(at, F.slice(out, F.lit(-1), F.lit(1)), lambda s, i: F.array_append(s, step(F.get(s, F.size(s) - 1), F.get(v, i))))
            return F.concat(out, F.slice(states, F.lit(2), F.lit(_PIECE)))

        pieces = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _PIECE).cast("int"))
        return F.when(F.size(v) > 0, F.slice(F.aggregate(pieces, F.array(zero), piece), F.lit(2), F.size(v))).otherwise(F.slice(F.array(zero), 2, 1))

    return let(values, whole)


def placed(matches: Column, pieces: Column) -> Column:
    """array<struct<start, end>> of a pattern's matches, by the ``pieces`` that it splits the text into; linear in both."""

    def spans(m: Column) -> Column:
        steps = let(pieces, lambda p: F.transform(m, lambda x, i: F.struct(F.length(F.get(p, i)).alias("gap"), F.length(x).alias("size"))))
        first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        return running(steps, first, lambda s, x: F.struct((s["end"] + x["gap"]).alias("start"), (s["end"] + x["gap"] + x["size"]).alias("end")))

    return let(matches, spans)
