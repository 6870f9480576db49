"""Character tables: visual similarity and distances on an ANSI keyboard."""

from __future__ import annotations

import functools
import math

from .visual_data import ratings

#: Reserved below 1, which means the same character.
VISUAL_SCALE = 0.95
#: Characters of a group look alike.
ALIKE = ("0OQ", "LI1Jilj|", "NM", "8B", "G6", "FE", "S5", "2Z", "PFR", "9P", "VWU", "vwu", ":;", "`'\"", "~-", ".,")
_ROWS = (
    (0, ("~`", "1!", "2@", "3#", "4$", "5%", "6^", "7&", "8*", "9(", "0)", "-_", "=+")),
    (102, (*"qwertyuiop", "[{", "]}", "\\|")),
    (133, (*"asdfghjkl", ";:", "'\"")),
    (164, (*"zxcvbnm", ",<", ".>", "?/")),
)
_KEY, _STEP = 63, 71


def ordered(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


@functools.cache
def visual_table() -> dict[tuple[str, str], float]:
    """Similarity below 1 of rated pairs; unrated pairs are absent."""
    known = ratings()
    most = max(known.values())
    return {pair: VISUAL_SCALE * rating / most for pair, rating in known.items()}


def visual_similarity(a: str, b: str) -> float | None:
    return 1.0 if a == b else visual_table().get(ordered(a, b))


@functools.cache
def alike_pairs() -> frozenset[tuple[str, str]]:
    return frozenset(ordered(a, b) for group in ALIKE for a in group for b in group if a != b)


def looks_alike(a: str, b: str) -> bool:
    return a == b or ordered(a, b) in alike_pairs()


@functools.cache
def keyboard_table() -> dict[tuple[str, str], float]:
    """Distance between keys, in key widths; 0 on one key, 1 for neighbours."""
    place = {c: (left + _STEP * i, _STEP * row) for row, (left, keys) in enumerate(_ROWS) for i, key in enumerate(keys) for c in key}
    found = {}
    for a, (xa, ya) in place.items():
        for b, (xb, yb) in place.items():
            if a < b:
                apart = math.hypot(max(abs(xa - xb) - _KEY, 0), max(abs(ya - yb) - _KEY, 0))
                found[a, b] = (apart + _KEY) / _STEP if apart else 0.0
    return found


@functools.cache
def keyboard_reach() -> float:
    """The largest distance between two keys."""
    return max(keyboard_table().values())


def key_distance(a: str, b: str, unknown: float = 1.0) -> float:
    a, b = a.lower(), b.lower()
    return 0.0 if a == b else keyboard_table().get(ordered(a, b), unknown)


def key_similarity(a: str, b: str, unknown: float = 1.0) -> float:
    return 1 - key_distance(a, b, unknown) / keyboard_reach()


def combined_cost(a: str, b: str, dissimilar: float = 0.2, corrected: bool = False) -> float:
    """What a substitution costs. The formula multiplies similarities, so far keys are cheap; ``corrected`` takes 1 - s."""
    result = key_similarity(a, b)
    seen = visual_similarity(a, b)
    if seen is not None:
        result *= seen
    if looks_alike(a, b):
        result *= 1 - dissimilar
    return 1 - result if corrected else result
