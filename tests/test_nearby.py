"""Pairs within two edits against all pairs in plain Python, and how they are found."""

import random

import pyarrow as pa
import pytest

from quillsift.operators import nearby, suggest
from test_operators import plain_osa, words


def variants(word, distance):
    found = {word}
    for _ in range(distance):
        found |= {v[:i] + v[i + 1 :] for v in found for i in range(len(v)) if len(v) > 1}
    return found


def all_pairs(queries, values, distance):
    shared = {w: variants(w, distance) for w in {*queries, *values}}
    return sorted((q, v, n) for q in queries for v in values if shared[q] & shared[v] and (n := plain_osa(q, v)) <= distance)


def vocabulary(chance, alphabet, longest):
    found = ["".join(chance.choice(alphabet) for _ in range(chance.randint(1, longest))) for _ in range(150)]
    for word in found[::5]:
        letters = list(word)
        for _ in range(2):
            kind, i = chance.randrange(4), chance.randrange(len(letters))
            if kind == 0 and len(letters) > 1:
                del letters[i]
            elif kind == 1:
                letters.insert(i, chance.choice(alphabet))
            elif kind == 2:
                letters[i] = chance.choice(alphabet)
            else:
                letters[i : i + 2] = letters[i : i + 2][::-1]
        found.append("".join(letters))
    return sorted(set(found))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("alphabet, longest", [("ab", 6), ("abc", 20), ("abcdé", 5), ("aé中\U0001f600x\0", 40)])
def test_pairs(alphabet, longest, small, monkeypatch):
    chance = random.Random(f"{alphabet}{small}")
    if small:  # everything is handled in small pieces
        for name, size in (("_HELD", 2), ("_COMPARED", 64), ("_HASHES", 30), ("_PACKED", 50)):
            monkeypatch.setattr(nearby, name, size)
    known = vocabulary(chance, alphabet, longest)
    for queries, values in ((known, known), ([*known[::4], "zzz"], known[: len(known) * 2 // 3])):
        roles = {w: nearby.QUERY * (w in queries) + nearby.VALUE * (w in values) for w in {*queries, *values}}
        batch = pa.RecordBatch.from_arrays([pa.array(list(roles)), pa.array(list(roles.values()), pa.int32())], ["value", "role"])
        for distance in (0, 1, 2):
            parts = chance.choice([1, 3, 400])
            dealt = pa.Table.from_batches(list(nearby._variants(distance, parts)([batch]))).sort_by([("part", "ascending"), ("bucket", "ascending")])
            got = [row for b in nearby._pairs(distance, parts)(dealt.to_batches(max_chunksize=3 if small else 10_000)) for row in zip(*(c.to_pylist() for c in b.columns))]
            assert sorted(got) == all_pairs(queries, values, distance)


def test_lookup_compares_where_variants_meet(spark):
    known = vocabulary(random.Random(3), "abc", 8)
    index = suggest.Suggestor.build(words(spark, [*known, None, "", known[0]]), "w", 2)
    asked = [*known[::3], "zzz", "", None, known[0]]
    for distance in (1, 2):
        found = index.lookup(words(spark, asked, "query"), "query", distance)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "ArrowEvalPython" not in plan  # no pair is shuffled, none is decided by itself
        got = sorted((r["query"], r["value"], r["distance"]) for r in found.collect())
        assert got == all_pairs({*known[::3], "zzz"}, known, distance)
