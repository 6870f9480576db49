"""Packing: ids against the tokenizer itself, pieces against an exact round trip."""

import struct
import zlib

import public_tokenizers
import numpy as np
import pytest
from tokenizers import Tokenizer

from quillsift.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TABLES = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a", "Hello  world", "tab\tx\r\n\r\ny ", "é ñ 日本語 😀", "x <|endoftext|> y", "it's we'll", " lead", "trail \n", "a b c", "\u0000\x85", "1234 5678,9", "w" * 3000, None]


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_ids():
    encode = packing.Encoder(PATH)
    for text, ids in zip(TEXTS, reference(TEXTS)):
        assert list(struct.unpack(f"<{len(ids) - 1}I", encode(text or ""))) == ids[:-1], text


def check(rows, pieces, length):
    ids_of = {}
    for (doc_id, _), ids in zip(rows, reference([t for _, t in rows])):
        ids_of.setdefault(doc_id, []).append(ids)
    spans, filled = {}, {}
    for p in pieces:
        assert 0 < p.length and p.offset + p.length <= length
        spans.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens, p.ids_crc32))
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc_id, parts in spans.items():
        if len(ids_of[doc_id]) == 1:
            (ids,), at = ids_of[doc_id], 0
            for start, n, total, crc in sorted(parts):
                assert start == at and total == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))
                at += n
            assert at == len(ids)
    assert set(spans) == set(ids_of)
    assert sum(n for parts in spans.values() for _, n, _, _ in parts) == sum(len(x) for v in ids_of.values() for x in v)
    assert sorted(filled) == list(range(len(filled)))
    for sequence, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or sequence == len(filled) - 1


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_pieces(spark, length):
    rows = list(enumerate(TEXTS)) + [(None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack(frame, PATH, length)
    check(rows, pieces.collect(), length)
    padded = packing.padded_length(pieces, length).collect()
    assert all(r.padded_to == (r.filled if r.filled & (r.filled - 1) == 0 else length) for r in padded)


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(frame, PATH).collect()) == 6


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    check(rows, packing.query(spark, TABLES).collect(), packing.LENGTH)


def test_ids_of_any_type_extra_columns_and_long_texts(spark):
    rows = [("a", "x y", "mine"), ("b", "word " * 60_000, "mine"), (None, None, "mine")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, sequence_id string")
    pieces = packing.pack(frame, PATH)
    assert pieces.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
    check([r[:2] for r in rows], pieces.collect(), packing.LENGTH)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"merges": 1}])
def test_other_kinds_of_files_are_left_to_their_library(tmp_path, change):
    import json

    file = json.loads(open(PATH, encoding="utf-8").read())
    assert packing.follows_ids(file)
    if "merges" in change:
        merges = file["model"]["merges"]
        merges[1], merges[5] = merges[5], merges[1]
    else:
        file |= change
    assert not packing.follows_ids(file)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    encode = packing.Encoder(str(path))
    assert np.frombuffer(encode("Some Text here"), "<u4").tolist() == encode.tokenizer.encode("Some Text here", add_special_tokens=False).ids
