"""Nearest neighbours: recall against brute force, and exact scores."""

import numpy as np
import pytest

from quillsift.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, vectors, query, own, k=10):
    d = np.sqrt(((vectors.astype(np.float64) - query.astype(np.float64)) ** 2).sum(axis=1))
    return sorted((float(x), int(i)) for x, i in zip(d, ids) if i != own)[:k]


@pytest.mark.parametrize("n,clusters", [(3000, 1), (3000, 40)])
def test_graph_recall(n, clusters):
    rng = np.random.default_rng(n + clusters)
    centres = rng.normal(size=(clusters, 32)) * 8
    x = (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 32))).astype(np.float32)
    graph = ann.Graph(x)
    queries = x[::15]
    found, _ = graph.search(queries)
    true = np.argsort(((x[None] - queries[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found, true)]) > 0.95
    assert ((graph.edges >= 0).sum(axis=1) <= graph.degree).all()


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("kind", ["plain", "offset", "large", "small", "clusters", "many clusters", "far clusters"])
def test_shard_recall(kind, dtype):
    """Shards of the production size, with vectors for which sums of squares lose all digits in single precision."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(ann.SHARD, 32))
    if kind == "offset":
        x = 100 + 0.01 * x
    elif kind == "large":
        x = 1e20 * x if dtype is np.float32 else 1e250 * x
    elif kind == "small":
        x = 1e-30 * x if dtype is np.float32 else 1e-250 * x
    elif kind != "plain":
        centres = rng.normal(size=(50 if kind == "clusters" else 400, 32))
        x = centres[rng.integers(0, len(centres), len(x))] * (1000 if kind == "far clusters" else 20) + 0.1 * x
    x = x.astype(dtype)
    queries = x[::41]
    found, scores = ann.Shard(x).search(queries)
    scale = 2.0 ** np.frexp(np.abs(x).max())[1]
    wide = x.astype(np.float64) / scale
    hits = []
    for q, row, score in zip(wide[::41], found, scores):
        exact = np.sqrt(((wide - q) ** 2).sum(axis=1))
        best = row[row >= 0][np.argsort(score[row >= 0])[:10]]
        hits.append(len(set(best) & set(np.argsort(exact)[:10])) / 10)
        assert np.allclose(score[row >= 0], exact[row[row >= 0]] * scale, rtol=1e-12)
    assert np.mean(hits) >= 0.9, np.mean(hits)


@pytest.mark.parametrize("n", [1, 2, 5, 33, 34, 60])
def test_small_graphs_are_exact(n):
    x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    found, _ = ann.Graph(x).search(x)
    for i, row in enumerate(found):
        true = np.argsort(((x - x[i]) ** 2).sum(axis=1))[:10]
        assert set(true) <= set(row[row >= 0][: len(true)])


@pytest.mark.parametrize("shard", [ann.SHARD, 200])
def test_search(spark, shard):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[5]  # a hot vector
    rows = [(i, x[i].tolist()) for i in range(600)] + [(5, x[5].tolist()), (700, None), (800, []), (900, [0.0] * 8), (1000, [1.0] * 7 + [None]), (1100, [float("nan")] + [1.0] * 7), (1200, [float("inf")] + [1.0] * 7), (1300, [1.0, 2.0]), (None, x[3].tolist())]
    vectors = ann.usable(spark.createDataFrame(rows, SCHEMA))
    queries = vectors.where("vec_id % 100 = 0")
    found = {}
    for r in ann.search(vectors, queries, shard=shard).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(found) == {0, 100, 200, 300, 400, 500}  # the vector of length 2 has no candidate but itself
    hit = total = 0
    for q, got in found.items():
        want = brute(range(600), x, x[q], q)
        assert sorted(got) == list(range(1, 11)) and [got[r] for r in sorted(got)] == sorted(got.values())
        for score, i in got.values():
            assert i != q and score == pytest.approx(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()), rel=1e-12)
        hit += len({i for _, i in want} & {i for _, i in got.values()})
        total += 10
    assert hit / total > 0.95
    assert [i for _, i in sorted(found[100].values())] == [5, *range(101, 110)]


def test_few_candidates_and_empty_table(spark):
    vectors = ann.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], SCHEMA))
    assert [(r.rank, r.vec_id) for r in ann.search(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_query_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=np.float32)
    found = {}
    for r in ann.query(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len({i for _, i in brute(ids, x, x[ids == q][0], q)} & f) / 10 for q, f in found.items()]
    assert len(found) == sum(i % 100 == 0 for i in ids) and np.mean(hits) >= 0.95
