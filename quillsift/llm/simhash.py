"""Near-duplicates by SimHash and a self-join of binary tries.

Documents with equal fingerprints are one vertex. Two vertices within ``budget`` of 64 differing bits agree on at least
one of budget + 1 blocks of bits (pigeonhole), so each block gives a trie that has this block at the top, where no error
is spent; the subtrees below the top are the work units. In a subtree, pairs of nodes are traversed together, level by
level: differing branches add to the errors, and a pair goes once the errors exceed the budget, or if all its vertices
are known to be connected. Pairs of small nodes are compared directly. A unit returns a spanning forest of its links,
never all pairs, so a group of k copies gives fewer than k rows; the components of the forests are those of all links. A
unit with more than ``HOT`` vertices is split by the pigeonhole over its other bits.

``near_groups`` links fingerprints of four-word shingles within four bits. That finds copies with hardly a change: of
texts whose five-word shingles are 0.8 alike, few are so near. ``drop_near_copies`` is for these: it links just the pairs whose
sets of five-word shingles have a Jaccard similarity of 0.8 or more. Texts with one set are one vertex. The tries of the
sets' fingerprints propose pairs, and ``set_links`` proposes all others that can be so alike; each pair is compared set by set.

``set_links`` in three steps, of which none loses a pair:

1. A set's sketch is its smallest hashes, 30 % of them. As a set that is 0.8 alike another misses at most a fifth of it, and
   so does the other, their sketches share a tenth of their members at least. Sets whose sketches share less
   with all others together have no partner and are out of play. Only sketches are shuffled for it.
2. Sets in play are posted under their rarest shingles, so many that two sets 0.8 alike have one in common (prefix filter).
   Of each posting the set with the fewest shingles of its own is the hub; each set is compared with the hub that it meets
   most often. This connects a group of copies by fewer pairs than it has members.
3. Pairs of a posting that are not connected by then are compared, if the shingle comes early enough in both sets for
   their sizes. In one of the two sets of such a pair it comes within the first ninth, so only these sets meet others.

Defined results: a null text counts as empty; texts without words have fingerprint zero and the empty set, which link like any other; a
null doc_id is never the smallest one of its component unless all are null; repeated rows are linked, and rows equal in
doc_id and text stay or go together; other columns are carried along untouched whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import ASCII_LOWER, discard, free_names, materialize, own_columns, table

BUDGET = 4
SHINGLE = 4
SEED = 42
#: Of ``drop_near_copies``: words of a shingle.
SET_SHINGLE = 5
#: Vertices of a unit from which on it is split once more.
HOT = 50_000
#: Rows of consecutive units that are joined in one go, and pairs that are looked at in one go.
CHUNK, PAIRS = 100_000, 1 << 18
#: Node pairs up to this many vertex pairs are compared directly.
SMALL = 64


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(starts), 8192):
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[lo : lo + 8192], ends[lo : lo + 8192])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def shingle_set(text: bytes | None, width: int = SET_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted set of the signed XXH64 of the text's shingles; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed; a bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return fingerprints(text.cast("binary"))


_SET = [T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last, a text, and _SET; few rows at a time."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            found = [shingle_set(t.as_py()) for t in rows.columns[-1]]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            made = [pa.array([xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([set_fingerprint(x) for x in found], pa.int64()), shingles]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *made], names=[*rows.schema.names[:-1], *(f.name for f in _SET)])


def with_sets(rows: DataFrame) -> DataFrame:
    """Rows, whose last column is a text, with digest (128 bits that name its set), fp (the set's fingerprint) and shingles
    (the sorted set) in its place."""
    text = rows.columns[-1]
    return rows.withColumn(text, F.col(text).cast("binary")).mapInArrow(_sets, T.StructType([*rows.schema.fields[:-1], *_SET]))


def blocks_of(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of ``parts`` blocks."""
    edges = [round(bits * i / parts) for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _rotated(column: Column, by: int) -> Column:
    return F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by)) if by else column


class Forest:
    """Joins the tries of ranges [lo, hi) of sorted 64-bit keys; keys within ``budget`` bits are linked.

    labels: the smallest vertex of each component.
    """

    def __init__(self, keys: np.ndarray, budget: int = BUDGET):
        self.keys, self.budget = keys, budget
        self.labels = np.arange(len(keys))
        self.ones: dict[int, np.ndarray] = {}

    def join(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        # what is nearly equal is connected first, which spares the second round most pairs of a dense group
        for near in sorted({min(1, self.budget), self.budget}):
            self._traverse(lo, hi, near)
        return self.labels

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        labels = self.labels
        while len(i):
            a, b = labels[i], labels[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = labels[labels]
                if (up == labels).all():
                    break
                labels[:] = up

    def _compare(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = (i < j) & (self.labels[i] != self.labels[j])
        i, j = i[apart], j[apart]
        near = np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.budget
        self._merge(i[near], j[near])

    def _pairs(self, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> None:
        """Compares the vertices of node pairs, so many at a time."""
        each = (a_hi - a_lo) * (b_hi - b_lo)
        for k in np.flatnonzero(each > PAIRS):  # many vertices that agree in all bits: row by row
            for i in range(a_lo[k], a_hi[k]):
                others = np.arange(b_lo[k], b_hi[k])
                others = others[self.labels[b_lo[k] : b_hi[k]] != self.labels[i]]
                if len(others):
                    self._compare(np.minimum(i, others), np.maximum(i, others))
        few = each <= PAIRS
        a_lo, a_hi, b_lo, b_hi, each = a_lo[few], a_hi[few], b_lo[few], b_hi[few], each[few]
        if not len(each):
            return
        cuts = [0, *np.flatnonzero(np.diff(np.cumsum(each) // PAIRS)) + 1, len(each)]
        for s, e in zip(cuts, cuts[1:]):
            n, wide = each[s:e], (b_hi - b_lo)[s:e]
            pair = np.repeat(np.arange(e - s), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            self._compare(a_lo[s:e][pair] + at // wide[pair], b_lo[s:e][pair] + at % wide[pair])

    def _connected(self, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Node pairs whose vertices all have one label."""
        labels = self.labels
        turns = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
        return (turns[lo] == turns[hi - 1]) & (turns[other] == turns[end - 1]) & (labels[lo] == labels[other])

    def _traverse(self, lo: np.ndarray, hi: np.ndarray, near: int) -> None:
        stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
        while stack:
            bit, *nodes = stack.pop()
            go_on = ~self._connected(*nodes[:4])
            nodes = [x[go_on] for x in nodes]
            a_lo, a_hi, b_lo, b_hi, err = nodes
            small = ((a_hi - a_lo) * (b_hi - b_lo) <= SMALL) | (bit < 0)
            if small.any():
                self._pairs(a_lo[small], a_hi[small], b_lo[small], b_hi[small])
            big = ~small
            if not big.any():
                continue
            a_lo, a_hi, b_lo, b_hi, err = (x[big] for x in nodes)
            if bit not in self.ones:
                self.ones[bit] = np.concatenate(([0], np.cumsum((self.keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
            c = self.ones[bit]
            a_mid, b_mid = a_hi - (c[a_hi] - c[a_lo]), b_hi - (c[b_hi] - c[b_lo])
            cross = a_lo != b_lo
            more = err + 1
            children = [
                (a_lo[cross], a_mid[cross], b_mid[cross], b_hi[cross], more[cross]),
                (a_mid[cross], a_hi[cross], b_lo[cross], b_mid[cross], more[cross]),
                (a_lo[~cross], a_mid[~cross], b_mid[~cross], b_hi[~cross], more[~cross]),
                (a_lo, a_mid, b_lo, b_mid, err),
                (a_mid, a_hi, b_mid, b_hi, err),
            ]
            nodes = [np.concatenate(x) for x in zip(*children)]
            alive = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= near) & ~((nodes[0] == nodes[2]) & (nodes[1] - nodes[0] < 2))
            nodes = [x[alive] for x in nodes]
            for s in range(0, len(nodes[0]), PAIRS):  # the last ones, with the fewest errors, come next
                stack.append((bit - 1, *(x[s : s + PAIRS] for x in nodes)))


def trie_forest(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the components that links within the ranges of sorted keys make."""
    return Forest(keys, budget).join(lo, hi)


_UNIT = ["block", "bucket", "sub", "subbucket"]


def _forest(budget: int):
    """Streams sorted units (the columns of _UNIT, key, node) and gives links (u, v) of their forests, as nodes."""

    def join(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        *units, keys, nodes = (np.concatenate(x) for x in zip(*held))
        keys = keys.view(np.uint64)
        new = np.zeros(len(keys), dtype=bool)
        new[0] = True
        for u in units:
            new[1:] |= u[1:] != u[:-1]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(keys))
        two = hi - lo > 1
        labels = trie_forest(keys, lo[two], hi[two], budget)
        linked = np.flatnonzero(labels != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[labels[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = np.flatnonzero(np.any([u != u[-1] for u in new[: len(_UNIT)]], axis=0))
            if rows >= CHUNK and len(last):  # the last unit may go on in the next batch
                cut = last[-1] + 1
                yield join([*held, [x[:cut] for x in new]])
                held, rows, new = [], 0, [x[cut:] for x in new]
            held.append(new)
            rows += len(new[0])
        if held:
            yield join(held)

    return run


def near_links(vertices: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Distinct vertices (node, fp) -> links (u, v) of nodes that connect just what all links connect."""
    units = []
    for i, (lo, width) in enumerate(blocks_of(64, budget + 1)):
        key = _rotated(F.col("fp"), lo)
        units.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(key, 64 - width).alias("bucket"), key.alias("key")))
    rows = vertices.select("node", F.explode(F.array(*units)).alias("x")).select("x.*", "node")
    crowded = rows.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block", "bucket", F.lit(True).alias("hot"))
    rows = rows.join(crowded, ["block", "bucket"], "left")
    # below the block, any pair that is near agrees on one of budget + 1 groups of its other bits too
    below = max(w for _, w in blocks_of(64, budget + 1))
    groups = [(below + lo, width) for lo, width in blocks_of(64 - below, budget + 1)]
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subbucket")))
    split = F.array(*[F.struct(F.lit(i).alias("sub"), F.shiftrightunsigned(F.shiftleft(F.col("key"), lo), 64 - width).alias("subbucket")) for i, (lo, width) in enumerate(groups)])
    rows = rows.withColumn("y", F.explode(F.when(F.col("hot"), split).otherwise(whole))).select("block", "bucket", "y.sub", "y.subbucket", "key", "node")
    # flipping the sign makes the order of longs that of unsigned numbers
    order = [*_UNIT, F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))]
    dealt = rows.repartition(*_UNIT).sortWithinPartitions(*order)
    return dealt.mapInArrow(_forest(budget), T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def _members(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links."""
    found = components(links)
    return materialize(found.select(F.col("u").alias("node"), "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "members")


def _firsts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with ``first`` -> (node, first): the smallest of the node's component."""
    members = _members(links)
    least = members.join(nodes, "node").groupBy("root").agg(F.min("first").alias("least"))
    linked = members.join(least, "root").select("node", "least")
    # written, so that the join with the rows has an exchange on either side, and Spark can split a node that many rows share
    return materialize(nodes.join(linked, "node", "left").select("node", F.coalesce("least", "first").alias("first")), "components")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v) of nodes those whose sets are 0.8 alike or more."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _missing(size: Column) -> Column:
    """Members of a set that another one 0.8 alike can lack."""
    return F.floor(size / 5)


def _spare(size: Column) -> Column:
    """Members of a sketch beyond those that one common member takes."""
    return F.least(F.ceil(size / 10), size - _missing(size) - 1)


def in_play(sets: DataFrame) -> DataFrame:
    """The nodes (node) of distinct sets (node, shingles) whose sketches share so much with others as one 0.8 alike would."""
    size = F.size("shingles")
    # the empty set is one node and has no partner
    sketches = sets.where(size > 0).select("node", size.alias("size"), F.explode(F.slice("shingles", F.lit(1), (_missing(size) + 1 + _spare(size)).cast("int"))).alias("s"))
    # written, so that the join has an exchange on either side, and Spark can split a shingle that many nodes share
    shared = materialize(sketches.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s"), "shared")
    # a partner has four fifths of the size at least
    least = 1 + _spare(F.ceil(4 * F.col("size") / 5))
    return sketches.join(shared, "s").groupBy("node", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("node")


def _in_size(a: str, b: str) -> Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def set_links(sets: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Nodes with distinct sets (node, shingles) -> links (u, v) that connect just what all pairs 0.8 alike or more connect.

    ``proposed``: pairs (u, v) that are compared with the first ones.
    """
    every = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    often = materialize(every.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_shingles")
    ranked = every.join(often, "s").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("common"))
    # the prefix has one member more than another set can lack; those that no other node has come first and need no posting
    own = F.col("size") - F.size("common")
    posted = (_missing(F.col("size")) + 1 - own).cast("int")
    postings = ranked.withColumn("posted", posted).where("posted > 0").select("node", "size", own.alias("own"), F.posexplode(F.slice("common", F.lit(1), F.col("posted"))).alias("at", "x"))
    # with what is left of the set from the shingle on, a partner can have so many members
    most = F.floor(9 * (F.col("size") - F.col("own") - F.col("at")) / 4) - F.col("size")
    postings = materialize(postings.select(F.col("x.s").alias("s"), "node", "size", "own", most.cast("int").alias("most")), "postings")
    hubs = materialize(postings.groupBy("s").agg(F.min(F.struct((F.col("own") / F.col("size")).alias("share"), F.col("node").alias("u"), F.col("size").alias("hub_size"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "hub.u", "hub.hub_size"), "hubs")
    met = postings.join(hubs, "s").where((F.col("node") != F.col("u")) & _in_size("size", "hub_size")).groupBy("node", "u").agg(F.count(F.lit(1)).alias("n"))
    pairs = met.groupBy(F.col("node").alias("v")).agg(F.max(F.struct("n", "u")).alias("x")).select("x.u", "v")
    if proposed is not None:
        pairs = pairs.unionByName(proposed)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = materialize(_alike(pairs, sets), "first_links")
    # then all pairs that are not connected yet
    labelled = materialize(postings.join(_members(links), "node", "left").select("s", "node", "size", "most", F.coalesce("root", "node").alias("root")), "labelled")
    of_hub = hubs.join(labelled.select("s", F.col("node").alias("u"), F.col("root").alias("hub_root")), ["s", "u"]).select("s", "hub_root")
    sided = materialize(labelled.join(materialize(of_hub, "hub_roots"), "s").withColumn("apart", F.col("root") != F.col("hub_root")).drop("hub_root"), "sided")
    early = F.col("most") >= F.col("size")
    # neither two sets of the hub's component meet, nor two in which the shingle comes late
    a, b, hub_a, late_b = (
        x.select("s", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "most", "root", "apart")])
        for x, side in ((sided.where(F.col("apart") & early), "a"), (sided, "b"), (sided.where(~F.col("apart") & early), "a"), (sided.where(F.col("apart") & ~early), "b"))
    )
    fits = (F.col("root_a") != F.col("root_b")) & _in_size("size_a", "size_b") & (F.col("size_b") <= F.col("most_a")) & (F.col("size_a") <= F.col("most_b"))
    once = ~(F.col("apart_b") & (F.col("most_b") >= F.col("size_b"))) | (F.col("node_a") < F.col("node_b"))
    met = a.join(b, "s").where(fits & once).select("node_a", "node_b").unionByName(hub_a.join(late_b, "s").where(fits).select("node_a", "node_b"))
    met = materialize(met.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct(), "open_pairs")
    return links.unionByName(materialize(_alike(met, sets), "other_links"))


def _by_id(tie: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), tie.alias("tie"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows = materialize(docs.select("doc_id", fingerprint_column(F.col("text")).alias("node")), "fingerprints")
    nodes = materialize(rows.groupBy("node").agg(F.min(_by_id(F.lit(0))).alias("first")), "nodes")
    found = _firsts(nodes, near_links(nodes.select("node", F.col("node").alias("fp"))))
    return rows.join(found, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component stays, that with the smallest doc_id; rows equal in doc_id and text stay or go together."""
    tie = F.xxhash64("text")
    numbered = with_sets(docs.select("doc_id", tie.alias("tie"), F.monotonically_increasing_id().alias("row"), "text"))
    whole = materialize(numbered, "sets")
    rows = materialize(whole.select("doc_id", "tie", "row", "digest"), "rows")
    # a set's node is the number of its first row
    nodes = materialize(rows.groupBy("digest").agg(F.min("row").alias("node"), F.min(_by_id(F.col("tie"))).alias("first")), "nodes")
    # sketches of repeated sets only bring more of them into play
    chosen = in_play(whole.select(F.col("row").alias("node"), "shingles")).join(nodes.select("node"), "node", "left_semi")
    sets = materialize(whole.select(F.col("row").alias("node"), "fp", "shingles").join(materialize(chosen, "in_play"), "node", "left_semi"), "sets_in_play")
    discard(whole)
    prints = materialize(sets.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    near = near_links(prints.select(F.col("fp").alias("node"), "fp"))
    by_print = [prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in "uv"]
    near = near.join(by_print[0], "u").join(by_print[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    equal = sets.select("fp", F.col("node").alias("v")).join(prints.select("fp", F.col("node").alias("u")), "fp").where("u <> v").select("u", "v")
    found = _firsts(nodes.select("node", "first"), set_links(sets.select("node", "shingles"), near.unionByName(equal)))
    numbered = materialize(nodes.select("digest", "node").join(found, "node").select("digest", "first"), "firsts")
    id_name, tie_name, text_name = free_names(docs, "__qs_id", "__qs_tie", "__qs_text")
    gone = rows.join(numbered, "digest").where(~_by_id(F.col("tie")).eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name)).distinct()
    gone = materialize(gone, "near_copies")
    keyed = docs.withColumn(text_name, tie)
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(text_name) == F.col(tie_name)), "left_anti").select(*own_columns(docs))


def query(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
