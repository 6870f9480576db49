"""Chat formatting: exact round trips."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsift.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<:>>", "<|im_end|>", "\\", "<", "[", "/", "s>", "é", "\n", "a", "<<:>", "<\\</s>"]), max_size=8).map("".join)


@settings(deadline=None, max_examples=400)
@given(PIECES)
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(mark in escaped for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<:>>", "<|im_end|>"))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.text("aé😀", max_size=5), min_size=3, max_size=3), max_size=6))
def test_assemble(rows):
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
    joined, lengths = chat.assemble(columns)
    assert joined.to_pylist() == ["".join(r) for r in rows]
    assert [int(sum(n)) for n in zip(*lengths)] == [len("".join(r).encode()) for r in rows]


def test_scatter_in_blocks(monkeypatch):
    monkeypatch.setattr(chat, "SCATTER", 4)
    texts = pa.array(["abc", "", "defghijkl", "m", "no"]).slice(1)
    joined, _ = chat.assemble([texts, pa.array(["1", "2", "3", "4"])])
    assert joined.to_pylist() == ["1", "defghijkl2", "m3", "no4"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "User", "a<<:>>b\n"])
@settings(deadline=None, max_examples=60)
@given(PIECES)
def test_turns_parse(role, text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([role]), pa.array([text])], names=["conv_id", "role", "text"])
    (out,) = chat._formatted(iter([batch]))
    segment = out.column(2)[0].as_py()
    assert chat.parse(segment) == (role, text)
    if role == "assistant":
        start, end = out.column(3)[0].as_py(), out.column(4)[0].as_py()
        assert chat.unescape(segment[start:end]) == text


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in r])
        said = [(role or "", text or "") for _, role, text in turns]
        learned = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), int(t), ["user", "assistant", "system", "tool"][int(rng.integers(4))], f"{c}</s> é {t}" * int(rng.integers(3))) for c in range(30) for t in range(int(rng.integers(1, 9)))]
    rows += [(100, None, "user", "x"), (100, None, "user", None), (100, 0, None, "y"), (100, 0, None, "y"), (None, 1, "assistant", "z"), (None, 0, "user", ""), (101, 0, "assistant", "w " * 300_000)]
    rows += [(102, t, "assistant", f"{t} ") for t in range(3000)]
    found = chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected(rows)
    assert len(found) == 34


def test_extra_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "b")], SCHEMA + ", segment string")
    assert chat.format_turns(frame).first()["segment"] == "<s>[INST]a[/INST]"
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_query_has_its_own_conversation(spark):
    found = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert found[-7].n_turns == 2 and found[-7].loss_chars == len(said) and found[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
