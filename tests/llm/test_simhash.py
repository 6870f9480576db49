"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash

from quillsift.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget=4):
    at = list(range(len(prints)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= budget) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            at[b] = a
    return [top(i) for i in range(len(prints))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "a b c d e", "é b  C\td\x0be f g a b c d", "x\x1cy z \x85 w v"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 5003}" for i in range(30_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
def test_trie_forest(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    keys = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7), dtype=np.uint64)) for c in centres for _ in range(rng.integers(1, 40))]
    keys = np.unique(np.array([*keys, *rng.integers(0, 1 << 63, 500, dtype=np.uint64)], dtype=np.uint64))
    labels = simhash.trie_forest(keys, np.array([0]), np.array([len(keys)]))
    assert same_partition(labels.tolist(), plain_components(keys.tolist()))


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(12))]))
    frame = spark.createDataFrame([(int(k), int(k)) for k in keys.view(np.int64)], "node long, fp long")
    links = simhash.near_links(frame, hot=hot).collect()
    place = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") for r in links)
    at = list(range(len(keys)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for r in links:
        a, b = sorted((top(place[r.u]), top(place[r.v])))
        at[b] = a
    assert same_partition([top(i) for i in range(len(keys))], plain_components(keys.tolist()))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.query(spark, TABLES).collect()}
    prints = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert len(got) == len(rows)
    for r, p, root in zip(rows, prints, roots):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == least[root]


def test_nulls_ties_and_extra_columns(spark):
    rows = [(5, None, "fp"), (3, "", "u"), (None, " ", "v"), (7, "a b c d", "w"), (7, "a b c d", "w"), (2, "A B c d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 2), (7, 2), (2, 2)], key=str)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0 and simhash.drop_near_copies(docs).count() == 0


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows, copies = [], {}
    for base in range(60):
        text = list(rng.choice(words, 300))
        rows.append((1000 * base, " ".join(text)))
        for k in range(1, int(rng.integers(1, 6))):
            changed = list(text)
            for at in rng.choice(300, int(rng.integers(1, 5)), replace=False):
                changed[at] = str(rng.choice(words))
            rows.append((1000 * base + k, " ".join(changed)))
            copies[1000 * base + k] = 1000 * base
    by_id = dict(rows)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1000 * b for b in range(60)} <= kept
    alike = [i for i, b in copies.items() if len(shingles(by_id[i]) & shingles(by_id[b])) >= 0.85 * len(shingles(by_id[i]) | shingles(by_id[b]))]
    assert len(alike) > 60 and not kept.intersection(alike)


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 10 * len(a & b) >= 8 * len(a | b)


def test_all_pairs_that_are_alike_are_linked(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (5, 12, 14, 20, 24, 40, 60, 240):
        for _ in range(6):
            text = list(rng.choice(words, size))
            more = max(1, round((size - 4) / 4))
            texts += [text, text + list(rng.choice(words, more)), text + list(rng.choice(words, more + 1)), text * 2, text[: size // 2] * 3 + text[size // 2 :]]
            texts.append([*text[: size // 2], "changed", *text[size // 2 + 1 :]])
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    top, pairs = list(range(len(texts))), []
    for j, b in enumerate(texts):
        for i in [i for i in range(j) if alike(texts[i], b)]:
            pairs.append((i, j))
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert len(pairs) > 50 and kept <= set(top)
    rows = docs.select("doc_id", "text").transform(simhash.with_sets).withColumn("node", F.xxhash64("shingles")).collect()
    sets = spark.createDataFrame(list({r.node: (r.node, r.shingles) for r in rows}.values()), "node long, shingles array<long>")
    links = {frozenset((r.u, r.v)) for r in simhash.set_links(sets).collect()}
    playing = {r.node for r in simhash.in_play(sets).collect()}
    exact = {frozenset((rows[i].node, rows[j].node)) for i, j in pairs if rows[i].node != rows[j].node}
    assert links <= exact and set().union(*exact) <= playing
    at = {r.node: r.node for r in rows}
    for u, v in links:
        at = {k: min(at[u], at[v]) if x in (at[u], at[v]) else x for k, x in at.items()}
    assert same_partition([at[r.node] for r in rows], top)


def test_drop_near_copies_against_brute_force(spark):
    """All rows of a table, with a crowd of copies of one text that are not alike each other, and a passage in every text."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(2000)]
    texts = [r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    passage = list(rng.choice(words, 30))
    for size in (12, 40, 120):
        original = list(rng.choice(words, size))
        for _ in range(60):
            copy = list(original)
            for at in rng.choice(size, max(1, size // 50), replace=False):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
        texts.append(" ".join(original))
    texts += [" ".join([*passage, *rng.choice(words, int(n))]) for n in rng.integers(1, 60, 150)]
    sets = [shingles("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if (t or "").split() else set() for t in texts]
    top = list(range(len(texts)))
    links = 0
    for j, b in enumerate(sets):
        for i in range(j):
            if 5 * len(sets[i] & b) >= 4 * len(sets[i] | b):
                links += 1
                if top[i] != top[j]:
                    lo, hi = sorted((top[i], top[j]))
                    top = [lo if t == hi else t for t in top]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert links > 100 and kept == set(top)


def test_clashing_columns(spark):
    names = ["__qs_text", "__qs_id", "__QS_tie", "row", "digest", "node", "x.y"]
    docs = spark.createDataFrame([(i, f"a b c d e f {'g' if i < 2 else i}", *([f"mine{i}"] * len(names))) for i in range(4)], ["doc_id", "text", *names])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect() if r.doc_id != 1}
