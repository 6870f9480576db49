"""Packing by concatenating and cutting.

All documents, in input order, form one stream of token ids; windows of ``length`` ids are cut from it. Pass one
tokenises each document once, notes where it starts within its partition and writes the ids to the shared folder. The
totals of the partitions (one row each) are summed up in order, which gives every document its global offset without
sorting or shuffling anything. Pass two cuts each document at the multiples of ``length``; a document that crosses one
gives a boundary record on either side. So every id lies in exactly one piece, and only the last sequence is short.

Ids are those of ``tokenizers`` with the given file. They are computed by ``tiktoken`` from the same vocabulary, read
from the same file, which gives the same ids (tested) several times faster. Texts that hold two white-space characters
in a row, or the beginning of a special token's string, are encoded by ``tokenizers`` itself; for all others the
vocabulary's way of splitting needs no look-ahead. So are all texts if the file is not of the kind for which this holds.

Defined results: a null text counts as empty and has the end id alone; null and repeated doc_ids are kept as they are,
of whatever type; a text of any length is encoded whole; equal texts have equal ids; other columns have no part in it; an
empty table gives no pieces.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, table

LENGTH = 2048
END_ID = 1
_TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])
_PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: How byte-level vocabularies split a text that has no two white-space characters in a row.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_OTHER = re.compile(r"\s\s")


def _byte_alphabet() -> dict[str, int]:
    """The visible characters that stand for bytes in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def follows_ids(vocabulary: dict) -> bool:
    """Whether a tokenizer's file asks for nothing but byte pairs that are merged in the order of their ids, within ``SPLIT``."""
    split, model = vocabulary.get("pre_tokenizer") or {}, vocabulary["model"]
    if vocabulary.get("normalizer") or vocabulary.get("truncation") or vocabulary.get("padding"):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    known, special = model["vocab"], {t["content"] for t in vocabulary["added_tokens"]}
    merged = [known.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    # with byte pairs alone every other token is a single byte
    plain = [t for t in known if t not in special and len(t) == 1]
    return all(a < b for a, b in zip([max((known[t] for t in plain), default=-1), *merged], merged)) and len(plain) == 256 and len(known) == len(plain) + len(merged) + len(special & known.keys())


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in vocabulary["added_tokens"]]
        self.encode = None
        if not follows_ids(vocabulary):
            return
        to_byte = _byte_alphabet()
        ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in vocabulary["model"]["vocab"].items() if token not in self.special}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.encode is None or _OTHER.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encode(text)
        return array.array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenize(path: str, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, starts = [], []
                rows = batch.slice(lo, 256)
                for text in rows.column(1).to_pylist():
                    ids.append(encode(text or "") + end)
                    starts.append(at)
                    at += len(ids[-1]) // 4
                # ids of most vocabularies fit into 16 bits, which halves what is written
                if max(np.frombuffer(x, dtype="<u4").max() for x in ids) < 1 << 16:
                    packed = [b"\x02" + np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() for x in ids]
                else:
                    packed = [b"\x04" + x for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * rows.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "part", "at", "ids"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[list[int]] = [[] for _ in _PIECES.fields]
            for row, (at, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                raw = packed.as_py()
                ids = raw[1:] if raw[0] == 4 else np.frombuffer(raw, dtype="<u2", offset=1).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    rows.append(row)
                    for column, value in zip(out, (start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset)):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", *_PIECES.names])

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_id = slim.schema["doc_id"]
    tokens = materialize(slim.mapInArrow(_tokenize(tokenizer_path, np.array([end_id], dtype="<u4").tobytes()), T.StructType([doc_id, *_TOKENS.fields])), "tokens")
    ids = (F.octet_length("ids") - 1) / F.when(F.hex(F.substring("ids", 1, 1)) == "02", 2).otherwise(4)
    # one row per partition of the input, so one task sums them up
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + ids.cast("long")).alias("total"))
    totals = materialize(totals, "totals")
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    placed = tokens.join(bases, "part").select("doc_id", (F.coalesce("base", F.lit(0)) + F.col("at")).alias("at"), "ids")
    return placed.mapInArrow(_cut(length), T.StructType([doc_id, *_PIECES.fields]))


def padded_length(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequences with their ids and the length that they are padded to: ``length``, but a power of two stays as it is."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.withColumn("padded_to", F.when(power, F.col("filled")).otherwise(F.lit(length)).cast("long"))


def query(spark, sf_dir, tokenizer_path: str | None = None):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
