"""Pairs of words within one or two edits, adjacent swaps included, from hashes of their deletions, in Arrow batches.

A word sends a hash of each of its variants to where the same variants of other words are. Of the variants that two near
words share, one is marked out by where the words differ: a pair is given there and nowhere else, so no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY, VALUE = 1, 2
#: The most edits whose pairs are told apart by where they differ.
MOST = 2
_BASE = 0x9E3779B97F4A7C15
_POWER = np.uint64(_BASE)
_BACK = np.array([pow(_BASE, -k, 1 << 64) for k in range(MOST + 1)], "uint64")
#: How many hashes, letters of blocks, bytes of blocks (of one bucket at least), and letters of pairs are handled at once.
_HASHES, _PACKED, _HELD, _COMPARED = 1 << 18, 1 << 23, 1 << 20, 1 << 22
#: Buckets of all parts together, at least.
_PLACES = 1 << 10


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins and the last one ends."""
    words = words.cast(pa.string())
    starts = np.frombuffer(words.buffers()[1], "int32")[words.offset : words.offset + len(words) + 1].astype("int64")
    data = np.frombuffer(words.buffers()[2] or b"", "uint8")[starts[0] : starts[-1]]
    starts -= starts[0]
    if not len(data) or data.max() < 128:
        return data, starts
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "uint32"), heads[starts]


def _table(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Words as rows of code points, zeros behind them."""
    places = np.arange(width)
    return np.where(places < lengths[:, None], letters[np.minimum(starts[:, None] + places, len(letters) - 1)], letters.dtype.type(0))


def _sums(table: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2 ... letters of each row."""
    mixed = table.astype("uint64") + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    powers = np.cumprod(np.full(table.shape[1], _POWER, "uint64"), dtype="uint64")
    return np.concatenate([np.zeros((len(table), 1), "uint64"), np.cumsum(mixed * powers, axis=1, dtype="uint64")], axis=1)


def _without(sums, end, *cuts):
    """Hashes of words without the letters at ``cuts``; ``sums`` gives the hash up to a place."""
    found, begin = 0, 0
    for k, cut in enumerate((*cuts, end)):
        found = found + (sums(cut) - (sums(begin) if k else np.uint64(0))) * _BACK[k]
        begin = cut + 1
    return found


def _pack(keys: np.ndarray, tags: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> bytes:
    """Postings as bytes, a kind of value after the other; lengths and letters take as many bytes as the largest needs."""
    wide = [4 if part.max() > 255 else 1 for part in (lengths, letters)]
    head = np.array([len(keys), *wide], "int64")
    return b"".join((head.tobytes(), keys.tobytes(), tags.tobytes(), lengths.astype(f"u{wide[0]}").tobytes(), letters.astype(f"u{wide[1]}").tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, *wide = np.frombuffer(data, "int64", 3).tolist()
    keys, tags = np.frombuffer(data, "uint32", n, 24), np.frombuffer(data, "int8", n, 24 + 4 * n)
    at = 24 + 5 * n
    return keys, tags, np.frombuffer(data, f"u{wide[0]}", n, at), np.frombuffer(data, f"u{wide[1]}", -1, at + wide[0] * n)


def _gather(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The letters of words that begin at ``starts``, one word after the other."""
    ends = np.cumsum(lengths)
    return letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def _words(letters: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The opposite of ``_letters``."""
    ends = np.append(0, np.cumsum(lengths))
    if letters.itemsize > 1 or len(letters) and letters.max() > 127:
        data = letters.astype("uint32").tobytes().decode("utf-32-le").encode()
        heads = np.flatnonzero((np.frombuffer(data, "uint8") & 0xC0) != 0x80)
        ends = np.append(heads, len(data))[ends]
    else:
        data = letters.tobytes()
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype("int32")), pa.py_buffer(data))


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hashes as keys: above, the part and its bucket as one number; below, what tells apart the variants of a bucket."""
    upper, buckets = hashes >> np.uint64(32), _buckets(parts)
    place = ((upper * np.uint64(parts)) >> np.uint64(32)) * np.uint64(buckets) + (upper & np.uint64(0xFFFF)) % np.uint64(buckets)
    return (place << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _buckets(parts: int) -> int:
    """Of each part; a worker holds a bucket or more at once."""
    return max(8, -(-_PLACES // parts))


def _variants(distance: int, parts: int):
    """Batches (value, role) to (part, bucket, data): the keys of each word's distinct variants, with the word, in blocks."""

    def postings(letters, starts, roles):
        lengths = np.diff(starts)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            one, two = np.arange(length), np.triu_indices(length, 1)
            step = max(1, _HASHES // (1 + length + len(two[0])))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                sums = _sums(_table(letters, starts[some], lengths[some], length))
                found = [_without(lambda k: sums[:, k], length)[:, None]]
                if distance > 0 and length > 1:
                    found.append(_without(lambda k: sums[:, k], np.array([length]), one))
                if distance > 1 and length > 2:
                    found.append(_without(lambda k: sums[:, k], np.array([length]), *two))
                for level, hashes in enumerate(found):
                    keys = np.sort(_keys(hashes, parts), axis=1)
                    first = np.ones(keys.shape, bool)
                    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    keys, row = keys[first], some[np.nonzero(first)[0]]
                    most = max(1, _PACKED // int(length))
                    for begin in range(0, len(keys), most):
                        part = slice(begin, begin + most)
                        yield keys[part], row[part], roles[row[part]] + np.int8(4 * level)

    def packed(letters, starts, found):
        keys, rows, tags = map(np.concatenate, zip(*found))
        place = (keys >> np.uint64(32)).astype("int64")
        order = np.argsort(place, kind="stable")
        place, rows, tags, keys = place[order], rows[order], tags[order], keys[order].astype("uint32")
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        lengths = np.diff(starts)[rows]
        data = []
        for begin, end in zip(begins, np.append(begins[1:], len(place))):
            block = slice(begin, end)
            data.append(_pack(keys[block], tags[block], lengths[block], _gather(letters, starts[rows[block]], lengths[block])))
        numbers, buckets = place[begins], _buckets(parts)
        return pa.RecordBatch.from_arrays([pa.array((numbers // buckets).astype("int32")), pa.array((numbers % buckets).astype("int32")), pa.array(data, pa.binary())], ["part", "bucket", "data"])

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            letters, starts = _letters(batch.column(0))
            found, size, lengths = [], 0, np.diff(starts)
            for some in postings(letters, starts, batch.column(1).to_numpy().astype("int8")):
                found.append(some)
                size += int(lengths[some[1]].sum())
                if size >= _PACKED:
                    yield packed(letters, starts, found)
                    found, size = [], 0
            if found:
                yield packed(letters, starts, found)

    return variants


def _first(found: np.ndarray, none: np.ndarray) -> np.ndarray:
    return np.where(found.any(axis=1), found.argmax(axis=1), none)


def _last(found: np.ndarray) -> np.ndarray:
    return np.where(found.any(axis=1), found.shape[1] - 1 - found[:, ::-1].argmax(axis=1), -1)


def _alike(table, a, b, level, distance):
    """Of pairs of one length: which are near, the word whose letters are cut (that with the lesser letter where they first differ), steps, cuts (-1: none)."""
    width = table.shape[1] - MOST
    unlike = table[a, :width] != table[b, :width]
    count = np.bitwise_count(unlike.view("uint64")).sum(axis=1, dtype="int64")
    kept = np.flatnonzero((count > 0) & ((count <= 2 * distance) | ((level == 1) & (distance > 1))))
    a, b, unlike, count, level = a[kept], b[kept], unlike[kept], count[kept], level[kept]
    first, last = unlike.argmax(axis=1), width - 1 - unlike[:, ::-1].argmax(axis=1)
    lesser = table[a, first] < table[b, first]
    x, y = np.where(lesser, a, b), np.where(lesser, b, a)
    front = (last > first) & (table[x, first] == table[y, first + 1]) & (table[x, first + 1] == table[y, first])
    back = (last > first) & (table[x, last] == table[y, last - 1]) & (table[x, last - 1] == table[y, last])
    one = (count == 1) | ((count == 2) & (last == first + 1) & front)
    steps, cuts = np.where(one, 1, 0), [np.where(one, first, -1), np.full(len(kept), -1)]
    if distance > 1:
        two = ~one & ((count == 2) | ((count == 3) & (front | back)) | ((count == 4) & front & back))
        rest = np.flatnonzero(~one & (two | (level == 1)))
        places = np.arange(width)
        within = (places >= first[rest, None]) & (places < last[rest, None])
        lefts, rights = table[x[rest]], table[y[rest]]
        shifted = ~((lefts[:, 1 : width + 1] != rights[:, :width]) & within).any(axis=1)
        back_shifted = ~((rights[:, 1 : width + 1] != lefts[:, :width]) & within).any(axis=1)
        two[rest] |= shifted | back_shifted
        steps[two] = 2
        cuts[0] = np.where(two, first, cuts[0])
        cuts[0][rest] = np.where(~shifted & back_shifted, last[rest], cuts[0][rest])
        cuts[1] = np.where(two, last, -1)
        cuts[1][rest] = np.where(shifted | back_shifted, -1, cuts[1][rest])
    near = np.flatnonzero(steps)
    return kept[near], x[near], steps[near], cuts[0][near], cuts[1][near]


def _longer(table, lengths, x, y, longer, distance):
    """The same of pairs whose first word is longer by one or two; letters are cut from that."""
    width = table.shape[1] - MOST
    lefts, rights, places = table[x], table[y, :width], np.arange(width)
    inside = places < lengths[y, None]
    straight, shifted, ends = ((lefts[:, k : k + width] != rights) & inside for k in (0, 1, longer))
    first, last = _first(straight, lengths[y]), _last(ends)
    only_cut = last < first
    within = (places >= first[:, None]) & (places <= last[:, None])
    here, next_ = (straight & within).sum(axis=1), (shifted & within).sum(axis=1)
    if longer == 1:
        front = (first < last) & (table[x, first] == table[y, first + 1]) & (table[x, first + 1] == table[y, first])
        back = (first < last) & (table[x, last] == table[y, last]) & (table[x, last + 1] == table[y, last - 1])
        two = (next_ == 1) | (here == 1) | ((next_ == 2) & back) | ((here == 2) & front)
        steps = np.where(only_cut, 1, np.where(two & (distance > 1), 2, 0))
        cuts = first, np.where(only_cut, -1, last + 1)
    else:
        steps = np.where((only_cut | (next_ == 0)) & (distance > 1), 2, 0)
        cuts = first, np.where(only_cut, first + 1, last + 2)
    near = np.flatnonzero(steps)
    return near, x[near], steps[near], cuts[0][near], cuts[1][near]


def _near(table, sums, lengths, keys, levels, a, b, distance, parts):
    """Of pairs of rows that share a key: those near, given at the key that is theirs, and their steps."""
    a, b = np.where(lengths[a] >= lengths[b], a, b), np.where(lengths[a] >= lengths[b], b, a)
    longer = lengths[a] - lengths[b]
    for more in range(distance + 1):
        at = np.flatnonzero(longer == more)
        if len(at):
            near, x, steps, *cuts = _longer(table, lengths, a[at], b[at], more, distance) if more else _alike(table, a[at], b[at], levels[a[at]], distance)
            for cut in range(1, distance + 1):
                # the other word's level follows from the lengths; asked for, as unlike variants may have the same key
                own = np.flatnonzero((levels[x] == cut) & (levels[b[at[near]]] == cut - more) & ((cuts[1] >= 0) + 1 == cut))
                owner = x[own]
                hashes = _without(lambda k: sums[owner, k], lengths[owner], *(c[own] for c in cuts[:cut]))
                own = own[_keys(hashes, parts) == keys[owner]]
                yield a[at[near[own]]], b[at[near[own]]], steps[own]


def _pairs(distance: int, parts: int):
    """Batches (part, bucket, data) in the order of both to (query, value, distance)."""

    def given(words, queries, values, steps):
        for at in range(0, len(steps), _HASHES):
            part = slice(at, at + _HASHES)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(queries[part])), words.take(pa.array(values[part])), pa.array(steps[part].astype("int32"))], ["query", "value", "distance"])

    def among(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        places, (keys, tags, lengths, letters) = [p for p, _ in blocks], map(list, zip(*(_unpack(data) for _, data in blocks)))
        keys = np.concatenate(keys).astype("uint64") | (np.repeat(np.array(places, "uint64"), list(map(len, keys))) << np.uint64(32))
        tags, lengths, letters = np.concatenate(tags), np.concatenate(lengths).astype("int64"), np.concatenate(letters)
        order = np.argsort(keys)
        keys, tags, starts, lengths = keys[order], tags[order], (np.cumsum(lengths) - lengths)[order], lengths[order]
        words = _words(_gather(letters, starts, lengths), lengths)
        roles, levels = tags & 3, tags >> 2
        same = np.flatnonzero(tags == QUERY + VALUE)
        yield from given(words, same, same, np.zeros(len(same), "int32"))
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begins, len(keys)))
        both = (sizes > 1) & (np.bitwise_or.reduceat(roles, begins) == QUERY + VALUE)
        widths = np.maximum(8, 1 << np.ceil(np.log2(np.maximum.reduceat(lengths, begins))).astype("int64"))
        for width in np.unique(widths[both]):
            groups = np.flatnonzero(both & (widths == width))
            size = sizes[groups]
            head = np.repeat(np.cumsum(size) - size, size)
            row = np.arange(len(head))
            source = np.repeat(begins[groups], size) + row - head
            own = lengths[source]
            table = _table(letters, starts[source], own, width + MOST)
            sums = _sums(table[:, :width])
            key, level, role = keys[source], levels[source], roles[source]
            before = row - head  # rows of the group above this one
            upto = np.cumsum(before)
            at = 0
            while at < len(row):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _COMPARED // width, "right")))
                b = np.repeat(row[at:end], before[at:end])
                if len(b):
                    a = np.repeat(head[at:end], before[at:end]) + np.arange(len(b)) - np.repeat(upto[at:end] - before[at:end] - (upto[at - 1] if at else 0), before[at:end])
                    met = np.flatnonzero((role[a] | role[b]) == QUERY + VALUE)
                    for x, y, steps in _near(table, sums, own, key, level, a[met], b[met], distance, parts):
                        for q, v in ((x, y), (y, x)):
                            asked = np.flatnonzero((role[q] & QUERY > 0) & (role[v] & VALUE > 0))
                            yield from given(words, source[q[asked]], source[v[asked]], steps[asked])
                at = end

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, -1
        for batch in batches:
            for part, bucket, data in zip(*batch.columns):
                place, data = part.as_py() * _buckets(parts) + bucket.as_py(), data.as_py()
                if size >= _HELD and place != last:
                    yield from among(held)
                    held, size = [], 0
                held.append((place, data))
                size, last = size + len(data), place
        if held:
            yield from among(held)

    return pairs


def pairs(queries: DataFrame, values: DataFrame, distance: int) -> DataFrame:
    """Distinct (query, value, distance) within the distance, 2 at most, that share a variant; each frame has one column of words."""
    if distance > MOST:
        raise ValueError("pairs are told apart within two edits only")
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = [df.toDF("value").select("value", F.lit(role).alias("role")) for df, role in ((queries, QUERY), (values, VALUE))]
    words = sides[0].unionByName(sides[1]).where("value <> ''").groupBy("value").agg(F.bit_or("role").alias("role"))
    blocks = words.repartition(min(parts, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_variants(distance, parts), "part int, bucket int, data binary")
    ordered = blocks.repartitionById(parts, "part").sortWithinPartitions("part", "bucket")
    return ordered.mapInArrow(_pairs(distance, parts), "query string, value string, distance int")
