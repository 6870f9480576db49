"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from the words in it, and the document's score is
their noisy-or: 1 - prod(1 - p), over the sentences of probability ``FLOOR`` or more and the likeliest of the others. Only documents are labelled; the gradient of the documents' likelihood goes through the
noisy-or to the sentences, so the model learns which sentences offend, and ``locate`` shows them.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE`` labelled training documents with the smallest
hash of their id. Its words are all those whose document counts in the sample say something about the label (likelihood
ratio of ``LEAST_RATIO`` or more). Sentences with the same words of a document are one with a number. So what reaches
the driver and what is broadcast come from the sample, whatever the input. Every document is scored, whole.

Defined results: null and empty texts have no sentence and score 0; a null label is none; of several labels of a
document the largest counts; without labels, or with one kind only, no word has a weight; equal texts score equally, so
repeated rows stay or go together; a text may be of any length; other columns are carried along untouched, and where one
is named ``offending`` that result's name gets an underscore more; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, free_names, materialize, own_columns, table

SAMPLE = 20_000
#: A word takes part from this likelihood ratio on (chi-square with one degree of freedom, p = 0.001).
LEAST_RATIO = 10.83
#: Sentences below this probability don't add up, or any text would offend once it is long enough.
FLOOR = 0.05
_FLOOR_LOGIT = float(np.log(FLOOR / (1 - FLOOR)))
ENDS = b".!?\n"
#: Lower-cases A-Z, ends sentences at ENDS, and makes other punctuation white space; bytes from 128 on stay.
_PLAIN = bytes(10 if bytes([b]) in ENDS else b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 39 else 32 for b in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    return [words for s in text.translate(_PLAIN).split(b"\n") if (words := s.split())]


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = frozenset(self.weights)

    def logit(self, words) -> float:
        return self.bias + sum(self.weights[w] for w in self.words.intersection(words))

    def score(self, text: bytes | None) -> float:
        """Of the sentences that are less likely than ``FLOOR``, or have no word that speaks for them, the likeliest counts."""
        total, faint = 0.0, None
        for words in sentences(text or b""):
            z = self.bias if self.words.isdisjoint(words) else self.logit(words)
            if z > self.bias and z >= _FLOOR_LOGIT:
                total -= float(np.logaddexp(0.0, z))
            elif faint is None or z > faint:
                faint = z
        if faint is not None:
            total -= float(np.logaddexp(0.0, faint))
        return float(-np.expm1(total))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) in code points of the sentences that score at least ``least``."""
        found = []
        for m in re.finditer(r"[^.!?\n]+[.!?\n]?", text or ""):
            for words in sentences(m[0].encode()):
                p = float(1 / (1 + np.exp(-self.logit(words))))
                if p >= least:
                    found.append((m.start(), m.end(), p))
        return found


def fit(labels: np.ndarray, calm: np.ndarray, owner: np.ndarray, times: np.ndarray, lengths: np.ndarray, words: np.ndarray, n_words: int, steps: int = 400, rate: float = 0.1, decay: float = 2e-5) -> tuple[float, np.ndarray]:
    """Full-batch Adam on the documents' likelihood; labels may be wrong, so each has a share ``slack`` of doubt.

    calm: sentences of each document without feature words; owner, times, lengths, words: the other sentences, their
    documents, how often each occurs there, and their words, joined together.
    """
    slack = 0.02
    w, b = np.zeros(n_words), -np.log(max(1.0, (calm.sum() + times.sum()) / max(1, labels.sum())))
    first = np.cumsum(lengths) - lengths
    of_word = np.repeat(np.arange(len(lengths)), lengths)
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        z = b + (np.add.reduceat(w[words], first) if len(lengths) else np.zeros(0))
        clear = -calm * np.logaddexp(0.0, b) - np.bincount(owner, times * np.logaddexp(0.0, z), minlength=len(labels))
        none = np.exp(clear)  # the probability that no sentence offends
        p = slack + (1 - 2 * slack) * (1 - none)
        pull = -(1 - 2 * slack) * none * (p - labels) / (p * (1 - p))  # d loss / d clear
        at = -pull[owner] * times / (1 + np.exp(-z))
        grad = np.append(np.bincount(words, at[of_word], minlength=n_words), at.sum() - (pull * calm).sum() / (1 + np.exp(-b))) / len(labels)
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, by label; partial counts leave whenever many words are held."""
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        words = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([held[k][w] for w in words], pa.int64()) for k in (1, 0))], names=["word", "toxic", "clean"])
        for c in held.values():
            c.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[label].update({w for words in sentences(text or b"") for w in words})
        if len(held[0]) + len(held[1]) > 200_000:
            yield flush()
    yield flush()


def _bags(vocabulary: list[bytes]):
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calm, times, lengths, words = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = Counter(tuple(sorted({number[w] for w in s if w in number})) for s in sentences(text or b""))
                calm.append(found.pop((), 0))
                times.append(list(found.values()))
                lengths.append([len(f) for f in found])
                words.append([i for f in found for i in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calm, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (times, lengths, words))], names=["label", "calm", "times", "lengths", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs``: doc_id, text of the rows that may be learned from; ``labels``: doc_id, toxic."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    marked = marked.select("doc_id", (F.col("label") > 0).cast("int").alias("label")).where(crc_mod(F.col("doc_id"), 5) != 0)
    marked = materialize(marked.withColumn("h", F.xxhash64("doc_id")), "marked")
    # hashes are even, so little more than the sample is sorted, however many labels there are
    share = 1.05 * sample / max(1, marked.count())
    few = marked.where(F.col("h") <= int(-(2**63) + share * 2**64)) if share < 1 else marked
    marked = few.orderBy("h", "doc_id").limit(sample).select("doc_id", "label")
    known = docs.join(F.broadcast(marked), "doc_id").select("label", F.col("text").cast("binary").alias("text"))
    known = materialize(known, "labelled")
    counts = known.mapInArrow(_word_counts, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(rows) < 2:
        return Model()
    n1, n0 = float(rows[1]), float(rows[0])

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    ratio = 2 * (term(F.col("toxic"), share * n1) + term(F.col("clean"), share * n0) + term(n1 - F.col("toxic"), (1 - share) * n1) + term(n0 - F.col("clean"), (1 - share) * n0))
    top = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    vocabulary = sorted(bytes(r["word"]) for r in top.select("word").collect())
    bags = known.mapInArrow(_bags(vocabulary), "label int, calm long, times array<long>, lengths array<long>, words array<long>").toPandas()
    times, lengths, words = (np.concatenate([*(np.asarray(x, dtype=np.int64) for x in bags[c]), np.zeros(0, np.int64)]) for c in ("times", "lengths", "words"))
    owner = np.repeat(np.arange(len(bags)), [len(x) for x in bags["lengths"]])
    bias, weights = fit(bags["label"].to_numpy(dtype=float), bags["calm"].to_numpy(dtype=float), owner, times.astype(float), lengths, words, len(vocabulary))
    return Model(bias, {w: float(x) for w, x in zip(vocabulary, weights) if abs(x) > 0.05})


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scores(text.cast("binary"))


def offending(model: Model, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with ``offending``: spans and scores of the sentences that offend."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(kind)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "score": p} for s, e, p in model.locate(t, least)] for t in texts])

    return docs.select(*own_columns(docs), spans("text").alias(free_names(docs, "offending")[0]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below 0.5."""
    model = train(docs.select("doc_id", "text"), labels)
    return docs.where(score_column(model, F.col("text")) < 0.5)
