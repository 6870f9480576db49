"""The pipeline: each stage against what it must do to its own input."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillsift.llm import simhash

TABLES = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        from quillsift.llm.shared import materialize

        seen.append(materialize(stage(spark, seen[-1], TABLES), name.replace(" ", "_")))
    for out in seen[1:-1]:
        assert out.columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in seen]
    for before, after in zip(rows[:3], rows[1:4]):
        assert set(after) <= set(before) and 0 < len(after) <= len(before)
    text = docs.columns.index("text")
    lowered = [r[text].lower() for r in rows[2]]
    assert len(lowered) == len(set(lowered)) == len({r[text].lower() for r in rows[1]})
    sets = [simhash.shingle_set(r[text].encode()) for r in rows[3]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            shared = len(np.intersect1d(a, b))
            assert 5 * shared < 4 * (len(a) + len(b) - shared)
    assert set(rows[4]) <= set(rows[3])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r[text], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r.length for r in seen[-1].collect()) == total


def test_run(spark):
    out = corpus_pipeline.run(spark, TABLES)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TABLES)
        assert out.count() == 0
        if out.columns == docs.columns:
            docs = out
