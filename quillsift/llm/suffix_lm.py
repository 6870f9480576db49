"""Language-model scores by a probabilistic suffix tree.

The tree's symbols are classes of tokens: each of the ``SINGLES`` most frequent words is a class of its own, so is the
end of a text, and all other words fall into classes by a digest of their first and last two bytes (a fixed alphabet of
``CLASSES``). A token's probability is that of its class in the longest retained suffix of the classes before it, times
that of the token within its class, which has the same counts and the same 0.1 for unseen words as the word-frequency
base. So the score exceeds the base by what the context says about the next class.

Growth: every context of every training position is counted, up to ``DEPTH`` classes, however rare it is. One of depth 2 or
more is retained if its next-symbol distribution diverges from its suffix's by more than it costs (count times
Kullback-Leibler divergence, against ``COST`` for each of its symbols), and its suffixes are retained with it; those of
depth 1, CLASSES at most, always are. Distributions are smoothed by those of the longest retained suffix, in the
proportion of Witten and Bell.

All training texts are counted, and both the tree and the word counts, which grow with the corpus, stay distributed. The
tree is dealt by the two nearest classes of its contexts: each part has whole subtrees, and above them only the first
level, which the alphabet bounds and which is broadcast. Documents travel in chunks; a chunk asks each part for the
probabilities of its distinct (context, symbol), whose counts it brings along, and adds up the answers. Of the words, the
most frequent ones, ``COMMON`` at most, are broadcast, all others are joined by a shuffle.

Defined results: a null text counts as empty and is its end alone; documents are scored as rows, so repeated rows and
null ids are kept; without training rows all classes are equally likely; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ASCII_LOWER, crc_mod, discard, materialize, table

DEPTH = 3
#: Nats that each seen symbol of a retained context costs (Akaike's measure).
COST = 1.0
#: Words whose counts are broadcast, and rows of words and counts that a worker holds.
COMMON, HELD = 50_000, 1 << 17
#: Bytes of texts that are taken apart at once (or one text).
SLICE = 1 << 19
#: Bytes of a batch of rows on its way to a worker (or one row), which the JVM and the worker both hold.
BATCH = 1 << 22
#: Bits of a class; the first two classes are the end of a text and, in contexts only, its start.
BITS = 9
CLASSES, SINGLES = 1 << BITS, 254
END, START = 0, 1
#: Symbols of a chunk of documents, and positions of a part of the tree, of which there are as many as that takes.
CHUNK, PART = 1 << 20, 1 << 19
#: Shares (a power of two) in which a part grows, so that a worker holds the arrays of one.
SHARES = 4


#: 0 for what stands between words, else 1.
_BLANK = b" \t\n\v\f\r"
_INSIDE = bytes(b not in _BLANK for b in range(256))
#: What a byte does to a running CRC-32.
_CRC_STEP = np.array([crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most that many bytes in a column, or one row."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has."""
    joined = b" ".join(texts)
    steps = np.diff(np.frombuffer(joined.translate(_INSIDE), np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(ASCII_LOWER, _BLANK))])
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return words, np.diff(np.append(np.searchsorted(starts, begin), len(starts)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged():
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        for rows in _slices(batch, 0, SLICE):
            coded = _words(rows.column(0).to_pylist())[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            held.append(pa.table({"word": coded.dictionary, "n": pa.array(n, pa.int64())}))
            if sum(map(len, held)) > HELD:
                held = [merged()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


class Classes:
    """The class of each word: ``singles`` have their own, the others share CLASSES - 2 - SINGLES."""

    def __init__(self, singles: list[bytes]):
        self.known = {w: i + 2 for i, w in enumerate(singles)}
        self.words = pa.array(singles, pa.binary())
        self.fixed = len(singles)

    def __call__(self, word: bytes) -> int:
        known = self.known.get(word)
        return known if known is not None else 2 + SINGLES + crc32(word[:2] + word[-2:]) % (CLASSES - 2 - SINGLES)

    def of(self, words: pa.Array) -> np.ndarray:
        """The classes of words, none of which is empty."""
        if not len(words):
            return np.zeros(0, np.int64)
        _, offsets, data = words.buffers()
        offsets, data = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data, np.uint8)
        first, last = offsets[:-1], offsets[1:] - 1
        long = last > first  # of a word of one byte, that byte is taken twice
        crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
        for at, counts in ((first, None), (first + long, long), (last - long, None), (last, long)):
            step = _crc_step(crc, data[at])
            crc = step if counts is None else np.where(counts, step, crc)
        out = 2 + SINGLES + (~crc % (CLASSES - 2 - SINGLES)).astype(np.int64)
        known = _places(words, self.words)
        return np.where(known >= 0, known + 2, out)


def _crc_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC_STEP[(crc ^ byte) & 255] ^ crc >> 8


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where words are among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)


def _class_totals(classes: Classes):
    """Words and tokens of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            k = classes.of(batch.column(0))
            np.add.at(tokens, k, batch.column(1).to_numpy())
            kinds += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(kinds)], names=["symbol", "tokens", "kinds"])

    return run


def _contexts(symbols: np.ndarray, depth: int):
    """For each depth from 1 on: packed contexts of all symbols, the nearest class lowest, and whether they are valid."""
    wide = symbols.astype(np.int64)
    inside = symbols != START
    context, valid = np.zeros(len(wide), dtype=np.int64), inside.copy()
    for d in range(1, depth + 1):
        valid = valid.copy()
        valid[:d] = False
        if d > 1:  # a context may begin with the start of its text, and goes no further back
            valid[d:] &= inside[1 : len(inside) - d + 1]
        context = context.copy()
        context[d:] |= wide[:-d] << (BITS * (d - 1))
        yield d, context, valid


def _packed(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The longest context of each symbol, up to ``depth`` classes, the nearest class lowest; zeros (no context has an END) fill it."""
    packed = np.zeros(len(symbols), dtype=np.int64)
    for _, context, valid in _contexts(symbols, depth):
        np.copyto(packed, context, where=valid)
    return packed


def _keys(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """context << BITS | symbol of each predicted symbol of a chunk, and how many each of its documents has."""
    symbols = np.frombuffer(data, dtype="<u2")
    predicted = symbols != START
    lengths = np.diff(np.append(np.flatnonzero(~predicted), len(symbols))) - 1
    return (_packed(symbols, depth) << BITS | symbols)[predicted], lengths


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys that are not negative, equal ones as they come, and the keys in that order."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = keys << bits | np.arange(len(keys))  # sorting values is several times faster than finding their order
    both.sort()
    return both & (1 << bits) - 1, both >> bits


def _numbers(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key in its own place the number of its run, from the order that sorts the keys and the starts of runs."""
    numbers = np.empty(len(order), np.int32)
    numbers[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(order))))
    return numbers


def _to_planes(values: np.ndarray) -> bytes:
    """Eight-byte values, byte by byte, so that the shuffle compresses those bytes that are alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values are in the sorted known ones, and whether they are."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    last = int(known[-1])
    if last < CLASSES << BITS < len(values) * 16:
        table = np.zeros(last + 1, np.int64)
        table[known] = np.arange(len(known))
        at = table[np.minimum(values, last)]
    else:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


@dataclass
class SuffixTree:
    """State 0 is the root; other states are numbered depth by depth, in the order of their contexts."""

    contexts: list[np.ndarray]  # by depth, from 1 on: sorted retained contexts
    first: list[int]  # by depth: the number of the first state
    parent: np.ndarray
    back: np.ndarray  # log10 of the parent's weight
    pairs: np.ndarray  # state << BITS | symbol, sorted
    log_p: np.ndarray  # log10 of the smoothed probability of each pair
    root: np.ndarray  # log10 of the root's probabilities
    of_keys: list[np.ndarray] = field(default_factory=list)  # by depth: log10 of the probability of each key it grew from, nan where the context is not retained

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The longest retained suffix before each symbol."""
        return self.longest(_packed(symbols, max(len(self.contexts), 1)))

    def longest(self, packed: np.ndarray) -> np.ndarray:
        """The longest retained suffix of each packed context."""
        state = np.zeros(len(packed), dtype=np.int64)
        for d, (first, contexts) in enumerate(zip(self.first, self.contexts), 1):
            at, known = _found(contexts, packed & (1 << BITS * d) - 1)
            known &= (packed >> BITS * (d - 1)) & (CLASSES - 1) != 0
            state[known] = first + at[known]
        return state

    def given(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probabilities of symbols in states."""
        state, symbol = state.copy(), symbol.astype(np.int64)
        out, left = np.zeros(len(symbol)), np.arange(len(symbol))
        while len(left):
            here, next_one = state[left], symbol[left]
            root = here == 0
            out[left[root]] += self.root[next_one[root]]
            at, hit = _found(self.pairs, here << BITS | next_one)
            hit &= ~root
            out[left[hit]] += self.log_p[at[hit]]
            left = left[~hit & ~root]
            out[left] += self.back[state[left]]
            state[left] = self.parent[state[left]]
        return out


def grow(totals: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
    """totals: tokens of each class; levels: sorted keys (context << BITS | symbol) and counts of depth 1, 2, ...

    From depth 2 on, levels may be those of some pairs of nearest classes only. A level may have a third array: for each
    key, where that of the context's suffix is in the level before.
    """
    kinds, n = np.count_nonzero(totals), totals.sum()
    symbols = CLASSES - 1  # all but the start, which is never predicted
    root = (totals + max(kinds, 1) / symbols) / (n + max(kinds, 1))
    of_level, kept, ups = [], [], []
    for d, (keys, counts, *up) in enumerate(levels, 1):
        start = _runs(keys >> BITS)
        contexts, each = keys[start] >> BITS, np.diff(np.append(start, len(keys)))
        total = np.add.reduceat(counts, start) if len(start) else np.zeros(0, np.int64)
        of_level.append((contexts, each, total))
        if d == 1:
            ups.append(None)
            kept.append(np.ones(len(contexts), bool))
            continue
        ups.append(up[0] if up else _found(levels[d - 2][0], keys & (1 << BITS * d) - 1)[0])
        if not len(contexts):
            kept.append(np.zeros(0, bool))
            continue
        _, up_each, up_total = of_level[-2]
        expected = (levels[d - 2][1] / np.repeat(up_total, up_each))[ups[-1]]
        gain = np.add.reduceat(counts * np.log(counts / np.repeat(total, each) / expected), start)
        kept.append(gain > COST * each)
    for d in range(len(levels) - 1, 0, -1):  # a retained context keeps its suffixes
        below = of_level[d][0][kept[d]] & (1 << BITS * d) - 1
        at, known = _found(of_level[d - 1][0], below)
        kept[d - 1][at[known]] = True
    empty = np.zeros(0, np.int64)
    tree = SuffixTree([], [], np.zeros(1, np.int64), np.zeros(1), empty, np.zeros(0), np.log10(root))
    parents, backs, pairs, log_p = [tree.parent], [tree.back], [tree.pairs], [tree.log_p]
    first = 1
    for d, (keys, counts, *_) in enumerate(levels, 1):
        contexts, each, total = of_level[d - 1]
        chosen = np.repeat(kept[d - 1], each)
        each, total, contexts = each[kept[d - 1]], total[kept[d - 1]], contexts[kept[d - 1]]
        if d > 1:
            at, _ = _found(tree.contexts[-1], contexts & (1 << BITS * (d - 1)) - 1)
            parents.append(tree.first[-1] + at)
        else:
            parents.append(np.zeros(len(contexts), np.int64))
        symbol, number = keys[chosen] & CLASSES - 1, np.repeat(np.arange(len(contexts)), each)
        # a suffix has all the symbols that its context has
        up_p = root[symbol] if d == 1 else 10 ** tree.of_keys[-1][ups[d - 1][chosen]]
        smooth = (counts[chosen] + each[number] * up_p) / (total + each)[number]
        tree.contexts.append(contexts)
        tree.first.append(first)
        backs.append(np.log10(each / (total + each)))
        pairs.append((first + number) << BITS | symbol)
        log_p.append(np.log10(smooth))
        tree.of_keys.append(np.full(len(keys), np.nan))
        tree.of_keys[-1][chosen] = log_p[-1]
        first += len(contexts)
    tree.parent, tree.back, tree.pairs, tree.log_p = map(np.concatenate, (parents, backs, pairs, log_p))
    return tree


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and the symbol after it: how often they are in training texts, and in all."""
    learned, every = np.zeros(CLASSES << BITS, np.int64), np.zeros(CLASSES << BITS, np.int64)
    for batch in batches:
        for data, held in zip(batch.column(1), batch.column(2)):
            keys, lengths = _keys(data.as_py(), 1)
            taught = np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, lengths)
            every += np.bincount(keys, minlength=len(every))
            learned += np.bincount(keys[taught], minlength=len(learned))
    seen = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(learned[seen]), pa.array(every[seen])], names=["key", "n", "m"])


def deal(positions: np.ndarray, parts: int) -> np.ndarray:
    """A part for each pair of nearest classes, by how many positions have it: the largest first, to the part with least."""
    part = np.zeros(len(positions), np.min_scalar_type(parts))  # numbers of one or two bytes sort fastest
    load = [(0, p) for p in range(parts)]
    for at in np.argsort(-positions, kind="stable"):
        if not positions[at]:
            break
        least, p = load[0]
        part[at] = p
        heapq.heapreplace(load, (least + int(positions[at]), p))
    return part


def _dealt(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by their parts, and the parts in that order."""
    of = part[(keys >> BITS) & len(part) - 1]
    order = np.argsort(of, kind="stable")
    return order, of[order]


def _ask(part: np.ndarray, depth: int):
    """The distinct keys of each chunk with their counts in its training texts, to the parts of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, held in zip(batch.column(0), batch.column(1), batch.column(2)):
                keys, lengths = _keys(data.as_py(), depth)
                marked = np.sort(keys << 1 | np.repeat(np.frombuffer(held.as_py(), np.uint8) == 0, lengths))
                start = _runs(marked >> 1)
                keys, counts = marked[start] >> 1, np.add.reduceat(marked & 1, start)
                order, of = _dealt(keys, part)
                keys, counts, start = keys[order], counts[order], _runs(of)
                asked = [(_to_planes(np.diff(k, prepend=0)), _to_planes(c)) for k, c in zip(np.split(keys, start[1:]), np.split(counts, start[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[start], pa.int32()), pa.array([row.as_py()] * len(start), pa.int64()), pa.array([k for k, _ in asked], pa.binary()), pa.array([c for _, c in asked], pa.binary())], names=["part", "row", "keys", "counts"]
                )

    return run


def _grown(totals: np.ndarray, first: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """log10 probabilities of keys, repeated ones too, by the tree that grows from them and their counts."""
    order, keys = _sorted(keys)
    start = _runs(keys)
    which = _numbers(order, start)
    keys, counts = keys[start], np.add.reduceat(counts[order], start)
    del order, start
    taught = counts > 0
    levels, places = _levels(keys[taught], counts[taught], first[0], depth)
    tree = grow(totals, [first, *levels])
    known = tree.of_keys[0][places[0]]  # the longest retained suffix of a key of training texts has its symbol
    for (deep, at), log_p in zip(places[1:], tree.of_keys[1:]):
        found = log_p[at]
        better = ~np.isnan(found)
        known[deep[better]] = found[better]
    values = np.empty(len(keys))
    values[taught] = known
    keys = keys[~taught]
    values[~taught] = tree.given(tree.longest(keys >> BITS), keys & CLASSES - 1)
    return values[which]


def _answer(totals: np.ndarray, first: tuple[np.ndarray, np.ndarray], depth: int):
    """Grows a part of the tree, a share of its nearest classes after the other, and gives log10 probabilities for the keys of each chunk, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, keys, counts = [], [], []
        for batch in batches:
            for part, row, k, c in zip(*(batch.column(i) for i in range(4))):
                asked.append((row.as_py(), part.as_py()))
                keys.append(np.cumsum(_of_planes(k.as_py(), np.int64)))
                counts.append(_of_planes(c.as_py(), np.int64))
        if not asked:
            return
        sizes = [len(k) for k in keys]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        values, share = np.empty(len(keys)), (keys >> BITS & SHARES - 1).astype(np.uint8)
        for i in range(SHARES):
            chosen = np.flatnonzero(share == i)
            if len(chosen):
                values[chosen] = _grown(totals, first, keys[chosen], counts[chosen], depth)
        for (row, part), found in zip(asked, np.split(values, np.cumsum(sizes)[:-1])):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([part], pa.int32()), pa.array([_to_planes(found)], pa.binary())], names=["row", "part", "data"])

    return run


def _levels(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, depth: int):
    """Keys, counts and suffixes of depth 2, 3, ... for ``grow``, from sorted keys of the longest contexts.

    ``pairs``: the keys of depth 1. With them, where each key is at depth 1, and for the other depths which keys reach it
    and where they are there.
    """
    before = _found(pairs, keys & (CLASSES << BITS) - 1)[0].astype(np.int32)
    levels, places = [], [before]
    for d in range(2, depth + 1):
        deep = np.flatnonzero((keys >> BITS * d) & (CLASSES - 1)).astype(np.int32)
        order, short = _sorted(keys[deep] & (1 << BITS * (d + 1)) - 1)
        start = _runs(short)
        at = _numbers(order, start)
        levels.append((short[start], np.add.reduceat(counts[deep[order]], start) if len(start) else np.zeros(0, np.int64), before[deep[order[start]]]))
        places.append((deep, at))
        before = np.zeros(len(keys), np.int32)
        before[deep] = at
    return levels, places


def _add_up(part: np.ndarray, depth: int):
    """The sum of the log10 probabilities of each document, from chunks and, behind each, the answers of its parts."""

    def sums(row, data, answers):
        keys, lengths = _keys(data, depth)
        order, keys = _sorted(keys)
        start = _runs(keys)
        which = _numbers(order, start)
        by_part, _ = _dealt(keys[start], part)
        del order, keys
        values = np.empty(len(start))
        values[by_part] = np.concatenate(answers)
        found = np.add.reduceat(values[which], np.cumsum(lengths) - lengths)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(found))), pa.array(found)], names=["row", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, answers = None, []
        for batch in batches:
            for row, part, data in zip(*(batch.column(i) for i in range(3))):
                if part.as_py() < 0:
                    if chunk:
                        yield sums(*chunk, answers)
                    chunk, answers = (row.as_py(), data.as_py()), []
                else:
                    answers.append(_of_planes(data.as_py(), np.float64))
        if chunk:
            yield sums(*chunk, answers)

    return run


def tree_scores(chunks: DataFrame, totals: np.ndarray, depth: int = DEPTH) -> DataFrame:
    """The log10 probability of each document's classes (row, tree), by a tree of all training texts.

    ``chunks``: row (of the first document), symbols (of all documents), held (a byte each); totals: tokens of each class.
    """
    chunks = chunks.select("row", "symbols", "held")
    found = chunks.mapInArrow(_pairs, "key long, n long, m long").groupBy("key").agg(F.sum("n"), F.sum("m")).toArrow()
    keys, learned, every = (found.column(i).to_numpy() for i in range(3))
    order = np.argsort(keys)
    order = order[learned[order] > 0]
    first = (keys[order], learned[order])
    # the pair (a, b) of a text is the pair of nearest classes of what comes next; where b is the first class, a is not there
    positions = np.zeros(CLASSES << BITS, np.int64)
    positions[keys] = np.where(keys & CLASSES - 1 == END, 0, every)
    positions[START] = every[keys >> BITS == START].sum()
    parts = max(1, -(-int(every.sum()) // PART))
    part = deal(positions, parts)
    asked = chunks.mapInArrow(_ask(part, depth), "part int, row long, keys binary, counts binary")
    answers = asked.repartitionById(parts, "part").mapInArrow(_answer(totals, first, depth), "row long, part int, data binary")
    both = chunks.select("row", F.lit(-1).alias("part"), F.col("symbols").alias("data")).unionByName(answers)
    together = both.repartition(parts, "row").sortWithinPartitions("row", "part")
    return materialize(together.mapInArrow(_add_up(part, depth), "row long, tree double"), "tree")


_ENCODED = T.StructType(
    [
        T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("symbols", T.BinaryType()), T.StructField("held", T.BinaryType()),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _encode(classes: Classes, common: dict[bytes, int], within: np.ndarray, all_tokens: float, texts: int, size: int):
    """Documents with their scores but for the tree's, and rows of their own (those with symbols) for chunks of documents.

    Words that are not ``common`` leave with the document, to be joined with their counts. A chunk has the number of its
    first document, the classes of all, each from its start to its end, and whether each is held out.
    within: log10 of the denominator of each class.
    """
    log_all, of_end = float(np.log10(all_tokens)), float(np.log10(texts + 0.1))
    known_words, log_counts = pa.array(list(common), pa.binary()), np.append(np.log10(np.array(list(common.values()), float) + 0.1), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        parts: list[np.ndarray] = []
        held: list[bool] = []

        def chunk():
            values = [row - len(held), *[None] * 8, np.concatenate(parts).tobytes(), bytes(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, _ARROW)], names=_ENCODED.names)

        for batch in batches:
            for rows in _slices(batch, 2, min(SLICE, size)):
                words, each = _words(rows.column(2).to_pylist())
                coded = words.dictionary_encode()
                at, distinct, docs = coded.indices.to_numpy(), coded.dictionary, len(each)
                of = np.repeat(np.arange(docs), each)
                start = np.cumsum(each + 2) - each - 2
                symbols = np.empty(len(at) + 2 * docs, np.int64)
                symbols[start], symbols[start + each + 1] = START, END
                symbols[np.arange(len(at)) + 2 * of + 1] = classes.of(distinct)[at]
                by_class = -within[symbols]
                by_class[start] = 0
                counts = log_counts[_places(distinct, known_words)][at]
                rare = np.isnan(counts)
                numerators = np.bincount(of, np.where(rare, 0, counts), minlength=docs) + of_end
                n_known = each - np.bincount(of[rare], minlength=docs) + (texts > 0)
                bags = np.sort(of[rare] * max(len(distinct), 1) + at[rare])
                first = _runs(bags)
                bag_of, word = np.divmod(bags[first], max(len(distinct), 1))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(bag_of, minlength=docs))), pa.int32())
                bag_words = pa.ListArray.from_arrays(ends, distinct.take(pa.array(word)))
                bag_times = pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(first, len(bags))), pa.int64()))
                values = [
                    np.arange(row, row + docs), rows.column(0), rows.column(1), each + 1, n_known, numerators - (each + 1) * log_all, numerators + np.add.reduceat(by_class, start),
                    bag_words, bag_times, pa.nulls(docs, pa.binary()), pa.nulls(docs, pa.binary()),
                ]
                row += docs
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(values, _ARROW)], names=_ENCODED.names)
                parts.append(symbols.astype("<u2"))
                held += [h is not False for h in rows.column(1).to_pylist()]
                if sum(map(len, parts)) >= size:
                    yield chunk()
                    parts, held = [], []
        if parts:
            yield chunk()

    return run


def frequent_words(words: DataFrame, most: int = COMMON) -> list[tuple[bytes, int]]:
    """The words (word, n) that a threshold of counts leaves, at most ``most``, the most frequent first.

    The threshold comes from a histogram of the counts with eight steps to a power of two, a few hundred rows.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["step"], r["count"]) for r in words.select(step.alias("step")).groupBy("step").count().collect()), reverse=True)
    least, total = None, 0
    for at, count in histogram:
        total += count
        if total > most:
            break
        least = at
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in words.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession):
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


def score_documents(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, held_out, text. Learns from the rows that are not held out, and scores all."""
    with _small_batches(docs.sparkSession):
        return _scored(docs)


def _scored(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "held_out", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    learned = texts.where(~F.col("held_out"))
    words = materialize(learned.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_texts = learned.select("doc_id").count()
    sums = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    train_tokens = int(sums[1] or 0) + n_texts
    all_tokens = train_tokens + 0.1 * (int(sums[0]) + (n_texts > 0) + 1)
    top = frequent_words(words)
    classes = Classes([w for w, _ in top[:SINGLES]])
    sizes = words.mapInArrow(_class_totals(classes), "symbol long, tokens long, kinds long").groupBy("symbol").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
    tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sizes.collect():
        tokens[r["symbol"]], kinds[r["symbol"]] = r["tokens"], r["kinds"]
    tokens[END] = n_texts
    # a class of one word has room for no other; the shared classes have one place for all unseen words
    single = np.arange(CLASSES) < 2 + classes.fixed
    within = np.log10(tokens + 0.1 * np.where(single, 1, kinds + 1))
    encoded = materialize(texts.mapInArrow(_encode(classes, dict(top), within, all_tokens, n_texts, CHUNK), _ENCODED), "encoded")
    chunks = materialize(encoded.where("symbols is not null").select("row", "symbols", "held"), "chunks")
    scored = encoded.where("symbols is null")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counted = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("numerators"),
    )
    more = F.coalesce("numerators", F.lit(0.0))
    by_words = scored.join(counted, "row", "left").select(
        "row", "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
    by_words = materialize(by_words, "by_words")
    discard(encoded, words)  # the tree needs the room
    by_tree = tree_scores(chunks, tokens)
    discard(chunks)
    return by_words.join(by_tree, "row").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("score") + F.col("tree")).alias("score"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text"))
