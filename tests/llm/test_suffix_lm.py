"""Language-model scores: the base against plain Python, the model as a distribution, and held-out gain."""

import math
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from quillsift.llm import suffix_lm as lm

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, held_out boolean, text string"


def tokens(text):
    return (text or "").encode().translate(lm.ASCII_LOWER).split()


def check_base(rows, found):
    learned = [tokens(t) for _, h, t in rows if not h]
    counts = Counter(w for d in learned for w in d)
    n, v = sum(counts.values()) + len(learned), len(counts) + (len(learned) > 0)
    z = n + 0.1 * (v + 1)
    want = sorted((i, h, len(tokens(t)) + 1, sum(w in counts for w in tokens(t)) + (len(learned) > 0), n, round(sum(math.log10((counts[w] + 0.1) / z) for w in tokens(t)) + math.log10((len(learned) + 0.1) / z), 5)) for i, h, t in rows)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-4)


@pytest.mark.parametrize("common", [lm.COMMON, 5])
def test_base(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    chance = np.random.default_rng(2)
    rows = [(i, i % 4 == 0, " ".join(f"W{int(x)}" for x in chance.geometric(0.02, int(chance.integers(0, 60))))) for i in range(200)]
    rows += [(500, False, None), (501, True, ""), (502, True, "unseen w1\x0bW1"), (503, False, "long " * 30_000)]
    found = lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    check_base(rows, found)
    assert all(r.score < 0 for r in found)


def test_distribution():
    rng = np.random.default_rng(0)
    symbols = np.concatenate([[lm.START, *rng.choice([2, 3, 4, 5], 400, p=[0.4, 0.3, 0.2, 0.1]), lm.END] for _ in range(40)]).astype("<u2")
    for i in range(2, len(symbols)):  # a dependence on the symbol before the last one
        if symbols[i] > 1 and symbols[i - 2] == 5:
            symbols[i] = 2
    totals = np.bincount(symbols[symbols != lm.START], minlength=lm.CLASSES).astype(np.int64)
    levels = []
    for d in (1, 2, 3):
        for _, context, valid in lm._contexts(symbols, d):
            pass
        levels.append(np.unique(context[valid] << lm.BITS | symbols[valid], return_counts=True))
    tree = lm.grow(totals, levels)
    assert len(tree.contexts[1]) > 0
    every = np.delete(np.arange(lm.CLASSES), lm.START)
    for state in range(len(tree.parent)):
        assert (10 ** tree.given(np.full(len(every), state), every)).sum() == pytest.approx(1, abs=1e-6)
    predicted = symbols != lm.START
    with_context = tree.given(tree.states(symbols), symbols)[predicted].sum()
    assert with_context > tree.root[symbols[predicted]].sum() + 100


def test_longest_suffix():
    tree = lm.SuffixTree([np.array([5]), np.array([5 | 7 << lm.BITS])], [1, 2], np.array([0, 0, 1]), np.zeros(3), np.zeros(0, np.int64), np.zeros(0), np.zeros(lm.CLASSES))
    symbols = np.array([lm.START, 7, 5, 9, 5, 9, lm.END, lm.START, 5, lm.END])
    assert tree.states(symbols).tolist() == [0, 0, 0, 2, 0, 1, 0, 0, 0, 1]


def plain_scores(rows):
    """The scores by a dictionary of all contexts, and how many are retained at each depth."""
    learned = [tokens(t) for _, h, t in rows if not h]
    words = Counter(w for d in learned for w in d)
    classes = lm.Classes([w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: lm.SINGLES]])
    after, within = defaultdict(Counter), Counter({lm.END: len(learned) + 0.1})
    for text in learned:
        seen = [lm.START, *map(classes, text), lm.END]
        for i in range(1, len(seen)):
            for d in range(min(i, lm.DEPTH) + 1):
                after[tuple(seen[i - d : i])][seen[i]] += 1
    for w, n in words.items():
        within[classes(w)] += n if classes(w) < 2 + classes.fixed else n + 0.1
    retained = {()}
    for context, nexts in after.items():
        up, total, up_total = after[context[1:]], nexts.total(), after[context[1:]].total()
        if len(context) == 1 or context and sum(n * math.log(n / total / (up[s] / up_total)) for s, n in nexts.items()) > lm.COST * len(nexts):
            retained |= {context[i:] for i in range(len(context))}

    def given(context, symbol):
        nexts = after[context]
        if not context:
            kinds = max(len(nexts), 1)
            return (nexts[symbol] + kinds / (lm.CLASSES - 1)) / (nexts.total() + kinds)
        return (nexts[symbol] + len(nexts) * given(context[1:], symbol)) / (nexts.total() + len(nexts))

    out = {}
    for i, _, t in rows:
        text = tokens(t)
        seen = [lm.START, *map(classes, text), lm.END]
        out[i] = sum(math.log10((words[w] + 0.1) / (within[classes(w)] + 0.1)) for w in text)
        for k in range(1, len(seen)):
            context = next(c for d in range(min(k, lm.DEPTH), -1, -1) if (c := tuple(seen[k - d : k])) in retained)
            out[i] += math.log10(given(context, seen[k]))
    return out, [sum(len(c) == d for c in retained) for d in range(lm.DEPTH + 1)]


@pytest.mark.parametrize("chunk, part", [(lm.CHUNK, lm.PART), (400, 1000)])
def test_scores_by_all_contexts(spark, monkeypatch, chunk, part):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "PART", part)
    chance = np.random.default_rng(5)
    rows = [(i, i % 5 == 0, " ".join(f"{int(x) * 7919 % 1000}w{int(x)}" for x in chance.zipf(1.3, int(chance.integers(0, 90))) if x < 2000)) for i in range(300)]
    passage = "Far fewer than one in ten thousand positions have these contexts and they count"
    rows += [(500, False, None), (501, True, ""), (502, False, passage), (503, False, f"and {passage}"), (504, True, f"but {passage}"), (505, True, "unseen"), (506, False, "long " * 3000)]
    want, retained = plain_scores(rows)
    found = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert retained[2] > 100 and retained[3] > 100
    assert found == pytest.approx(want, abs=1e-6)


def test_dealt_parts():
    positions = np.random.default_rng(1).zipf(1.5, lm.CLASSES << lm.BITS).clip(max=10_000)
    load = np.bincount(lm.deal(positions, 7), positions, minlength=7)
    assert load.max() - load.min() <= positions.max() and load.sum() == positions.sum()


@pytest.mark.parametrize("rows", [[], [(1, True, "a b")], [(1, True, None), (2, True, "x")]])
def test_nothing_learned(spark, rows):
    found = lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) and all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 for r in found)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, False, "a b"), (None, False, "a b"), (3, True, "a")]
    found = lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 3 and sum(r.doc_id is None and r.n_tokens == 3 for r in found) == 2


def test_query_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    found = lm.query(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == docs
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 10 == 0) for r in found)
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.1


def least_seconds(run):
    """CPU seconds, the least of three runs."""
    out = []
    for _ in range(3):
        began = time.process_time()
        run()
        out.append(time.process_time() - began)
    return min(out)


def test_seconds_of_encoding(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    chance = np.random.default_rng(3)
    texts = [" ".join(f"Word{x}" for x in chance.integers(0, 300_000, 400)).encode() for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.binary())], names=["doc_id", "held_out", "text"])
    counts = Counter(w for t in texts for w in t.lower().split())
    common = dict(counts.most_common(5000))
    classes = lm.Classes(list(common)[: lm.SINGLES])
    plain = least_seconds(lambda: [t.lower().split() for t in texts])
    encode = lm._encode(classes, common, np.ones(lm.CLASSES), 1e6, len(texts), lm.CHUNK)
    assert least_seconds(lambda: list(encode(iter([batch])))) < 12 * plain


def test_words_and_classes():
    chance = np.random.default_rng(4)
    texts = [chance.choice(list(b" \t\n\v\f\r\x00\x1c\x85\xa0abAZ"), int(n)).astype(np.uint8).tobytes() for n in chance.integers(0, 14, 400)] + [b""]
    for some in (texts, [b""], [b" ", b""], [b"", b"A"]):
        words, each = lm._words(some)
        want = [t.translate(lm.ASCII_LOWER).split() for t in some]
        assert words.to_pylist() == [w for t in want for w in t] and each.tolist() == [len(t) for t in want]
        classes = lm.Classes(sorted({w for t in want for w in t})[::3][: lm.SINGLES])
        assert classes.of(words).tolist() == [classes(w) for w in words.to_pylist()]
        assert classes.of(words.slice(1)).tolist() == [classes(w) for w in words.to_pylist()[1:]]


@pytest.mark.parametrize("held", [lm.HELD, 50])
def test_counted_words(monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "SLICE", 200)
    chance = np.random.default_rng(6)
    texts = [" ".join(f"W{x}" for x in chance.zipf(1.4, int(n))).encode() for n in chance.integers(0, 60, 200)] + [b"a " * 1000]
    found = Counter()
    for out in lm._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])] * 2)):
        for word, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            found[word] += n
    assert found == Counter(w for t in texts for w in t.lower().split() for _ in range(2))


def test_order_of_keys():
    for keys in (np.zeros(0, np.int64), np.array([3, 1, 3, 0, 1]), np.array([1 << 62, 5, 1 << 62, 5])):
        order, ordered = lm._sorted(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and ordered.tolist() == sorted(keys.tolist())
