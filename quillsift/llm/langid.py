"""Language identification by rank-order profiles.

A language's profile is the ranked list of its ``PROFILE`` most frequent character n-grams (one to ``LONGEST``
characters, words padded with ``_``). A document's own most frequent n-grams are ranked likewise, and the language whose
profile is the least out of place wins: the sum of the rank differences over the document's n-grams, where an n-gram
that the profile lacks counts ``PROFILE``. N-grams of equal count are ranked by their characters, so results do not
depend on the order of the text or of the rows.

Profiles are learned from all training documents, with partial sums per task. What is broadcast is ``PROFILE`` n-grams
for each language, and at most ``LANGUAGES`` languages.

Defined results: null texts and texts without letters get ``und`` and score 0, as do all texts if nothing was learned;
a null lang is not learned from; equal texts get equal results, in repeated rows too; ties between languages go to the
first by name; texts of any length are counted whole, long ones in pieces that are cut between words; other columns have
no part in it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, materialize, table

PROFILE = 400
LONGEST = 3
#: More languages than this are an error, not a broadcast.
LANGUAGES = 2000
#: Characters of training texts that are counted in one go.
CHUNK = 1 << 20
#: Cells of a dense count; alphabets too large for it are counted by sorting.
DENSE = 1 << 21
_BETWEEN = re.compile(r"[\W\d_]+")
_PAD = 95


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text's padded words, packed with 21 bits a character, in ascending order, and their counts."""
    padded = f"_{_BETWEEN.sub('_', text.lower())}_"
    codes = np.frombuffer(padded.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = codes != _PAD
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    present = np.flatnonzero(np.bincount(codes))
    k = len(present)
    place = np.zeros(present[-1] + 1, dtype=np.int64)
    place[present] = np.arange(k)
    at = place[codes]
    grams, counts = [], []
    packed, index, whole, inner = codes, at if k <= DENSE else None, letter, letter
    for n in range(1, LONGEST + 1):
        if n > 1:  # one character more; a pad may stand at either end, but not inside or alone
            index = None if index is None or k**n > DENSE else index[:-1] * k + at[n - 1 :]
            packed = packed[:-1] << 21 | codes[n - 1 :]
            inner = np.ones(len(packed), bool) if n == 2 else inner[:-1] & letter[n - 2 : -1]
            whole = inner & (letter[:-1] | letter[1:]) if n == 2 else inner
        if index is None:
            found, times = np.unique(packed[whole], return_counts=True)
        else:
            cells = np.bincount(index[whole])
            seen = np.flatnonzero(cells)
            times, found, rest = cells[seen], np.zeros(len(seen), np.int64), seen
            for j in range(n):
                found |= present[rest % k] << 21 * j
                rest = rest // k
        grams.append(found)
        counts.append(times)
    return np.concatenate(grams), np.concatenate(counts)


def ranked(counts: np.ndarray, grams: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Indices of the most frequent grams, the most frequent first."""
    if len(counts) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = np.flatnonzero(counts >= least)
    else:
        keep = np.arange(len(counts))
    return keep[np.lexsort((grams[keep], -counts[keep]))][:most]


class Identifier:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.sorted, self.ranks = [], []
        for name in self.names:
            grams = np.array(profiles[name], dtype=np.int64)
            order = np.argsort(grams)
            self.sorted.append(grams[order])
            self.ranks.append(order)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0
        grams, counts = gram_counts(text)
        top = grams[ranked(counts, grams)]
        here = np.arange(len(top))
        out = []
        for known, ranks in zip(self.sorted, self.ranks):
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            out.append(int(np.where(known[at] == top, np.abs(ranks[at] - here), PROFILE).sum()))
        best = int(np.argmin(out))
        return self.names[best], 1 - out[best] / (PROFILE * len(top))


def whole_words(text: str) -> Iterator[str]:
    """The text in pieces of at most ``CHUNK`` characters, cut between words; a longer word is a piece of its own."""
    lo = 0
    while len(text) - lo > CHUNK:
        hi = lo + CHUNK
        while hi > lo and not _BETWEEN.match(text, hi - 1):
            hi -= 1
        if hi == lo:
            after = _BETWEEN.search(text, lo + CHUNK)
            hi = after.start() if after else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[str]] = {}
    size: Counter = Counter()

    def flush(lang):
        grams, counts = gram_counts("_".join(held.pop(lang)))
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in whole_words(text):
                held.setdefault(lang, []).append(piece)
                size[lang] += len(piece)
                if size[lang] >= CHUNK:
                    yield flush(lang)
        if len(held) > 64:  # many languages at once: what is held stays bounded
            for lang in list(held):
                yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def train(docs: DataFrame, most: int = PROFILE) -> dict[str, list[int]]:
    """Ranked n-grams of each non-null lang of all ``docs`` (text, lang)."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    grams = known.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = materialize(grams.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most), "profiles")
    if top.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(profiles: dict[str, list[int]], text: Column) -> Column:
    """struct<lang, score> of each whole text."""

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def identified(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Identifier(profiles)
        for batch in texts:
            yield pd.DataFrame([model(t) for t in batch], columns=["lang", "score"])

    return identified(text)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    profiles = train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), identify(profiles, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
