"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from ..functions import characters


def values(table: dict) -> str:
    """A character table as (x, y, v)."""
    rows = ", ".join("('{}', '{}', {!r}::double)".format(a.replace("'", "''"), b.replace("'", "''"), v) for (a, b), v in sorted(table.items()))
    return f"(values {rows})"


def edit_distance(pairs: str, cost: str = "1.0", insert: float = 1.0, delete: float = 1.0, swap: bool = True, corrected: bool = False) -> str:
    """SQL for (x, y, d): edit distance of ``pairs`` (x, y), by default with adjacent swaps; ``cost`` is of replacing @a by @b.

    Equal ends are stripped, then a fold over the longer string keeps the last two rows of the table, and an inner fold
    builds a row. The longer string's characters are put in (g), the shorter one's taken out (h).
    """
    swapped = "case when i > 1 and j > 1 and u[j::int] = w[i::int - 1] and u[j::int - 1] = w[i::int] then s.o[j::int - 1] + case when u[j::int] = w[i::int] then 0.0::double else 1.0::double end else 1e9::double end" if swap else "1e9::double"
    best = f"least(s.p[j::int + 1] + g, r[j::int] + h, s.p[j::int] + case when u[j::int] = w[i::int] then 0.0::double else @cost end, {swapped})".replace("@cost", cost.replace("@a", "u[j::int]").replace("@b", "w[i::int]"))
    row = f"list_reduce(range(1, len(u) + 1), lambda r, j: list_append(r, {best}), [i * g])"
    fold = f"list_reduce(range(1, len(w) + 1), lambda s, i: {{'o': s.p, 'p': {row}}}, {{'o': list_transform(range(0, len(u) + 1), lambda k: 0.0::double), 'p': list_transform(range(0, len(u) + 1), lambda k: k * h)}})"
    rest = "g" if corrected else "case when least(length(x), length(y)) = 0 then g else h end"
    costs = ", ".join(f"case when length(y) < length(x) then {a!r}::double else {b!r}::double end {n}" for n, a, b in (("g", delete, insert), ("h", insert, delete)))
    return f"""
        select x, y, case when len(u) = 0 then len(w) * {rest} else ({fold}).p[len(u) + 1] end d from (
            select x, y, {costs}, string_split(substr(a, p + 1), '') [:length(a) - p] u, string_split(substr(b, p + 1), '')[:length(b) - p] w from (
                select *, len(list_filter(range(1, length(a) + 1), lambda k: left(a, k) = left(b, k))) p from (
                    select x, y, left(a, length(a) - s) a, left(b, length(b) - s) b from (
                        select *, len(list_filter(range(1, length(a) + 1), lambda k: right(a, k) = right(b, k))) s from (
                            select x, y, case when length(y) < length(x) then y else x end a, case when length(y) < length(x) then x else y end b from {pairs}))))) q"""


def combined_cost(dissimilar: float = 0.2) -> str:
    """Cost of replacing @a by @b by keyboard and looks, as lookups in constant maps keyed by both characters."""

    def lookup(table: dict, of: str) -> str:
        entries = ", ".join("'{}': {!r}::double".format((a + b).replace("'", "''"), float(v)) for (a, b), v in sorted(table.items()))
        a, b = of.replace("@", "@a"), of.replace("@", "@b")
        return f"map {{{entries}}}[least({a}, {b}) || greatest({a}, {b})]"

    keyboard = f"(1.0 - case when lower(@a) = lower(@b) then 0.0::double else coalesce({lookup(characters.keyboard_table(), 'lower(@)')}, 1.0::double) end / {characters.keyboard_reach()!r}::double)"
    visual = f"coalesce({lookup(characters.visual_table(), '@')}, 1.0::double)"
    alike = f"coalesce({lookup({pair: 1 - dissimilar for pair in characters.alike_pairs()}, '@')}, 1.0::double)"
    return f"{keyboard} * {visual} * {alike}"
