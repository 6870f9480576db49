"""Approximate nearest neighbours by a robust-pruned directed graph.

Distinct vectors are dealt at random to shards of about ``SHARD`` vectors, however many there are, and each shard has a graph of its own. From a
random graph, two passes let every vector search itself greedily: what the search meets is a candidate neighbour, and
robust pruning keeps the nearest candidate and drops those that are ``alpha`` times nearer to it than to the vector, so
that the kept edges point in diverse directions. Edges are added backwards and pruned alike. A query searches every
shard with a beam of ``BEAM`` vertices; the shards' finds are ranked by exact distance in double precision.

Graphs are built and searched in single precision, on differences of vectors that a power of two brings to the size of
one (double vectors are centred first), so neither a common offset nor large components cost precision.

A shard's vectors are read first, then its queries stream by in batches, so memory is bounded by a shard's size whatever
the number of queries. Every query searches every shard, so the cost is queries times shards. Equal vectors are one vertex with its smallest ids (as many as a result can name), so a vector that
many rows share costs what a single one does.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows
without an id; a row is never its own neighbour, and rows with the query's id count as its own; repeated rows are one;
only vectors of the query's length are its candidates; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table

NEAREST = 10
#: Vectors of a shard, on average.
SHARD = 4096
#: Edges of a vertex, and vertices that a search keeps.
DEGREE, BEAM = 32, 64
ALPHAS = (1.0, 1.2)
ENTRIES = 64
#: Queries that are searched in one go, and at most so many cells of queries times vectors.
BLOCK, CELLS = 512, 1 << 21


def _sorted_by(ids: np.ndarray, distances: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(distances, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(distances, order, 1)


class Graph:
    """Vectors (float32) and their edges; -1 where a vertex has fewer."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 0):
        self.x = vectors
        self.degree, self.beam = degree, beam
        n = len(vectors)
        self.block = max(16, min(BLOCK, CELLS // n))
        rng = np.random.default_rng(seed)
        middle = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
        self.entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), middle))
        self.edges = rng.integers(0, n, (n, min(degree, max(n - 1, 1))))
        self.edges[self.edges == np.arange(n)[:, None]] = -1
        if n <= degree + 1:  # everything is everything's neighbour
            self.edges = np.tile(np.arange(n), (n, 1))
            return
        for alpha in ALPHAS:
            self._improve(alpha)

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of ids; infinite where the id is -1."""
        near = np.maximum(ids, 0)
        apart = self.x[near]
        apart -= queries[:, None]
        return np.where(ids < 0, np.inf, np.einsum("brd,brd->br", apart, apart))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beams of ids and squared distances, nearest first; -1 beyond the last."""
        rows = np.arange(len(queries))
        seen = np.zeros((len(queries), len(self.x)), dtype=bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(queries), 1))
        ids, dist = _sorted_by(ids, self._distances(queries, ids), self.beam)
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            waiting = ~done & np.isfinite(dist)
            active = waiting.any(axis=1)
            if not active.any():
                return ids, dist
            who = rows[active]
            pick = waiting[active].argmax(axis=1)
            done[who, pick] = True
            near = self.edges[ids[who, pick]]
            near = np.where((near >= 0) & ~seen[who[:, None], np.maximum(near, 0)], near, -1)
            a, b = np.nonzero(near >= 0)
            seen[who[a], near[a, b]] = True
            both = np.concatenate([ids[who], near], axis=1)
            far = np.concatenate([dist[who], self._distances(queries[who], near)], axis=1)
            gone = np.concatenate([done[who], np.zeros(near.shape, bool)], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, : self.beam]
            new = [np.take_along_axis(v, order, 1) for v in (both, far, gone)]
            if new[0].shape[1] > ids.shape[1]:
                wide = new[0].shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, wide)), constant_values=-1)
                dist = np.pad(dist, ((0, 0), (0, wide)), constant_values=np.inf)
                done = np.pad(done, ((0, 0), (0, wide)), constant_values=True)
            ids[who], dist[who], done[who] = new

    def _prune(self, of: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """The edges of vertices ``of`` that robust pruning keeps among the candidates."""
        candidates = np.sort(candidates, axis=1)
        repeated = np.zeros(candidates.shape, dtype=bool)
        repeated[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
        candidates = np.where(repeated | (candidates == of[:, None]), -1, candidates)
        candidates, dist = _sorted_by(candidates, self._distances(self.x[of], candidates), self.beam + self.degree)
        alive = np.isfinite(dist)
        kept = np.full((len(of), self.degree), -1, dtype=np.int64)
        rows = np.arange(len(of))
        # seen from the vertex, so that what is subtracted below is as small as the distances themselves
        points = self.x[np.maximum(candidates, 0)] - self.x[of][:, None]
        for r in range(self.degree):
            if not alive.any():
                break
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            chosen = candidates[rows, pick]
            kept[some, r] = chosen[some]
            between = dist - 2 * np.einsum("bcd,bd->bc", points, points[rows, pick], optimize=True) + dist[rows, pick][:, None]
            alive &= ~((alpha * alpha * between <= dist) & some[:, None])
            alive[rows, pick] = False
        return kept

    def _improve(self, alpha: float) -> None:
        n = len(self.x)
        fresh = np.empty((n, self.degree), dtype=np.int64)
        for lo in range(0, n, self.block):
            of = np.arange(lo, min(n, lo + self.block))
            found, _ = self.search(self.x[of])
            fresh[of] = self._prune(of, np.concatenate([found, self.edges[of]], axis=1), alpha)
        # backwards: each vertex also gets the nearest of those that point at it
        source, column = np.nonzero(fresh >= 0)
        target = fresh[source, column]
        order = np.lexsort((column, target))
        source, target = source[order], target[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        back = np.full((n, 2 * self.degree), -1, dtype=np.int64)
        few = rank < back.shape[1]
        back[target[few], rank[few]] = source[few]
        for lo in range(0, n, self.block):
            of = np.arange(lo, min(n, lo + self.block))
            fresh[of] = self._prune(of, np.concatenate([fresh[of], back[of]], axis=1), alpha)
        self.edges = fresh


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Shard:
    """The graph of a shard's vectors; finds are scored in double precision on the vectors as they are."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.vectors = vectors
        self.shift = vectors.mean(axis=0) if vectors.dtype == np.float64 else np.zeros(vectors.shape[1], vectors.dtype)
        # a power of two, so that scaling changes no digit
        self.exponent = int(np.frexp(np.abs(vectors).max())[1])
        self.graph = Graph(self.seen(vectors), degree, beam)

    def seen(self, vectors: np.ndarray) -> np.ndarray:
        return np.ldexp(np.ldexp(vectors, -self.exponent - 1) - np.ldexp(self.shift, -self.exponent - 1), 1).clip(-1e9, 1e9).astype(np.float32)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beams of vertices, -1 beyond the last, and their distances."""
        found, _ = self.graph.search(self.seen(queries))
        near, asked = (np.ldexp(x.astype(np.float64), -self.exponent) for x in (self.vectors[np.maximum(found, 0)], queries))
        return found, np.ldexp(np.sqrt(((near - asked[:, None]) ** 2).sum(axis=2)), self.exponent)


def _serve(nearest: int, degree: int, beam: int):
    """Streams shards: their vectors (no query_id) first, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, graph, ids = None, [], None, None
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            asks = ~np.asarray(batch.column(1).is_null())
            edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                if shards[lo] != shard:
                    shard, parts, graph = shards[lo], [], None
                if not asks[lo]:
                    parts.append(rows)
                    continue
                if graph is None:
                    if not parts:  # no candidates of this length
                        continue
                    graph = Shard(np.concatenate([_vectors(p.column(2)) for p in parts]), degree, beam)
                    ids = [x for p in parts for x in p.column(3).to_pylist()]
                for s in range(0, rows.num_rows, graph.graph.block):
                    part = rows.slice(s, graph.graph.block)
                    found, exact = graph.search(_vectors(part.column(2)))
                    out: list[list] = [[], [], []]
                    for q, row, scores in zip(part.column(1).to_pylist(), found, exact):
                        best = sorted((float(d), i) for v, d in zip(row, scores) if v >= 0 for i in ids[v] if i != q)[:nearest]
                        out[0] += [q] * len(best)
                        out[1] += [i for _, i in best]
                        out[2] += [d for d, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, each once."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(vector_col, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & some)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """The ``nearest`` vectors (vec_id, vector) of each query (vec_id, vector): query_id, rank, vec_id, score."""
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    # a query's own id may be among them, hence one more
    few = vectors.withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= nearest + 1)
    distinct = materialize(few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    lengths = [(r["d"], -(-r["n"] // shard)) for r in distinct.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]
    # shards are numbered through the lengths, of which there is one as a rule
    first, total = [], 0
    for d, n in lengths:
        first.append((d, total, n))
        total += n
    if not first:
        total, first = 1, [(0, 0, 1)]
    plan = vectors.sparkSession.createDataFrame(first, "d int, first int, n int")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(plan), F.size("vector") == F.col("d"))

    kept = placed(distinct).select((F.col("first") + F.pmod(F.xxhash64("vector"), F.col("n"))).cast("int").alias("shard"), F.lit(None).cast("long").alias("query_id"), "vector", "ids")
    asked = placed(queries.distinct()).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("shard"), F.col("vec_id").alias("query_id"), "vector", F.array().cast("array<long>").alias("ids"))
    dealt = kept.unionByName(asked).repartitionById(total, F.col("shard")).sortWithinPartitions("shard", F.col("query_id").asc_nulls_first(), "vector")
    found = dealt.mapInArrow(_serve(nearest, degree, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
