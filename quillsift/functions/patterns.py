"""Pattern languages, compiled on the driver to predicates that Catalyst can push down.

Wildcards: ``?`` is one character and ``*`` any run. Class patterns: a fixed number of positions, each a literal or a set
such as ``[a-z-]``, ``[*]`` for any; ``[``, ``]`` and the backslash are escaped by a backslash. Class patterns and one-character
wildcards of key lookups count UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import placed

EXACT, CONTAINS, STARTS, ENDS = "exact", "contains", "starts_with", "ends_with"
_ESCAPE = "!"
_SPANS = "array<struct<index:int,length:int>>"


def like_escaped(text: str) -> str:
    """Text as a LIKE pattern that uses ``!`` to escape."""
    return re.sub(r"([%_!])", r"!\1", text)


@dataclass(frozen=True)
class Wildcard:
    """A wildcard pattern; an empty one never matches, one of ``*`` alone always does."""

    pattern: str
    option: str = EXACT
    unknown: str = "?"
    anything: str = "*"

    def __post_init__(self):
        if self.option not in (EXACT, CONTAINS, STARTS, ENDS):
            raise ValueError(f"unknown search option {self.option}")

    @property
    def everything(self) -> bool:
        return bool(self.pattern) and set(self.pattern) == {self.anything}

    def tokens(self) -> list[str]:
        """Literal characters, ``unknown`` and ``anything``; in each run of wildcards ``anything`` comes first, once."""

        def settle(m: re.Match) -> str:
            run = m[0]
            return (self.anything if self.anything in run else "") + self.unknown * run.count(self.unknown)

        return list(re.sub(f"[{re.escape(self.unknown + self.anything)}]+", settle, self.pattern))

    def literal_runs(self) -> list[str]:
        return [r for r in re.split(f"[{re.escape(self.unknown + self.anything)}]+", self.pattern) if r]

    def like(self) -> str:
        body = "".join("%" if c == self.anything else "_" if c == self.unknown else like_escaped(c) for c in self.tokens())
        return ("%" if self.option in (CONTAINS, ENDS) else "") + body + ("%" if self.option in (CONTAINS, STARTS) else "")

    def head(self) -> str:
        """The literal text that any match begins with."""
        if self.option in (CONTAINS, ENDS):
            return ""
        return re.split(f"[{re.escape(self.unknown + self.anything)}]", self.pattern, maxsplit=1)[0]

    def is_match(self, text: Column) -> Column:
        """LIKE, and the literal head as a predicate of its own where LIKE would not be pushed down."""
        if not self.pattern:
            return F.lit(False)
        found = F.like(text, F.lit(self.like()), F.lit(_ESCAPE))
        return text.startswith(self.head()) & found if self.head() else found

    def regex(self) -> str:
        """A greedy regular expression whose first match is the result's span."""
        body = "".join(".*" if c == self.anything else "." if c == self.unknown else re.sub(r"([^\w\s])", r"\\\1", c) for c in self.tokens())
        first = r"\A" if self.option in (EXACT, STARTS) else ""
        return f"(?s){first}{body}" + (r"\z" if self.option in (EXACT, ENDS) else "")

    def match(self, text: Column) -> Column:
        """struct<index, length> of the first match, from 0; length -1 if there is none."""
        none = F.struct(F.lit(0).alias("index"), F.lit(-1).alias("length"))
        if not self.pattern:
            return F.when(text.isNotNull(), none)
        start = F.regexp_instr(text, F.lit(self.regex())) - 1
        span = F.struct(start.alias("index"), F.length(F.regexp_extract(text, self.regex(), 0)).alias("length"))
        return F.when(text.isNull(), None).when(F.regexp_like(text, F.lit(self.regex())), span).otherwise(none)

    def matches(self, text: Column) -> Column:
        """Spans of all matches that do not overlap, from the left."""
        if not self.pattern:
            return F.when(text.isNotNull(), F.array().cast(_SPANS))
        if self.everything or self.option != CONTAINS:
            one = self.match(text)
            return F.filter(F.array(one), lambda s: s["length"] >= 0)
        spans = placed(F.regexp_extract_all(text, F.lit(self.regex()), F.lit(0)), F.split(text, self.regex(), -1))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("index"), (s["end"] - s["start"]).alias("length")))

    def to_regex(self, sql: bool = False) -> str:
        """Regular-expression text for other engines: lazy between literals; ``sql`` quotes it as a literal."""
        tokens = self.tokens()
        out = []
        for i, c in enumerate(tokens):
            if c == self.anything:
                out.append(".*" if i == len(tokens) - 1 else ".*?")
            elif c == self.unknown:
                out.append(".")
            else:
                out.append("''" if sql and c == "'" else f"\\{c}" if c in ".$^{[(|)*+?\\" else c)
        text = ("^" if self.option in (EXACT, STARTS) else "") + "".join(out) + ("$" if self.option in (EXACT, ENDS) else "")
        return f"'{text}'" if sql else text


def byte_view(text: Column) -> Column:
    """The UTF-8 bytes of a text, one character each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


ANY = frozenset(range(256))


def parse_classes(pattern: str) -> list[frozenset[int]]:
    """The set of bytes of each position; raises ValueError for bad syntax."""

    def escaped(at: int) -> str:
        if at >= len(pattern) or pattern[at] not in "[]\\":
            raise ValueError(f"a backslash before {pattern[at:at + 1]!r} in {pattern!r}")
        return pattern[at]

    out: list[frozenset[int]] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "]":
            raise ValueError(f"a ']' without '[' in {pattern!r}")
        if c != "[":
            if c == "\\":
                i += 1
                c = escaped(i)
            out += [frozenset([b]) for b in c.encode()]
            i += 1
            continue
        if pattern.startswith("[*]", i):
            out.append(ANY)
            i += 3
            continue
        first = i = i + 1
        chosen: set[int] = set()
        before = ""
        while True:
            if i >= len(pattern):
                raise ValueError(f"a '[' without ']' in {pattern!r}")
            c = pattern[i]
            if c == "]":
                break
            if c == "[":
                raise ValueError(f"a '[' inside a class of {pattern!r}")
            upper = ""
            if c == "\\":
                i += 1
                c = escaped(i)
            elif c == "-" and i > first and pattern[i + 1 : i + 2] not in ("", "]"):
                i += 1
                upper = pattern[i]
                if upper == "\\":
                    i += 1
                    upper = escaped(i)
            if upper:
                if ord(before) >= ord(upper):
                    raise ValueError(f"an inverted range {before}-{upper} in {pattern!r}")
                chosen |= set(range(ord(before), ord(upper) + 1))
                c = upper
            else:
                chosen.add(ord(c))
            if max(chosen) > 127:
                raise ValueError(f"a class holds single bytes only, not {c!r}")
            before = c
            i += 1
        out.append(frozenset(chosen))
        i += 1
    return out


def classes_of_wildcard(pattern: str, wildcard: str) -> list[frozenset[int]]:
    """A pattern in which ``wildcard`` is any one byte."""
    return [s for c in pattern for s in ([ANY] if c == wildcard else [frozenset([b]) for b in c.encode()])]


def literal_head(classes: list[frozenset[int]]) -> str:
    """The text of the leading positions that allow one byte each."""
    head = bytearray()
    for s in classes:
        if len(s) > 1 or not s:
            break
        head += bytes(s)
    return bytes(head).decode(errors="ignore")


def _regex_class(chosen: frozenset[int]) -> str:
    return r"[\x00-\xFF]" if chosen == ANY else "[" + "".join(f"\\x{b:02X}" for b in sorted(chosen)) + "]"


def classes_match(text: Column, classes: list[frozenset[int]], prefix: bool = False) -> Column:
    """Whether the text has (or, with ``prefix``, begins with) one byte of each class; its literal head is pushed down."""
    if prefix:
        while classes and classes[-1] == ANY:  # trailing wildcards only ask for length
            classes = classes[:-1]
    found = F.regexp_like(byte_view(text), F.lit(r"(?s)\A" + "".join(map(_regex_class, classes)) + ("" if prefix else r"\z")))
    head = literal_head(classes)
    return text.startswith(head) & found if head else found


def classes_cost(text: Column, classes: list[frozenset[int]], missing: int = 1, extra: int = 1) -> Column:
    """Mismatched positions, and what missing and extra bytes cost."""
    view = byte_view(text)
    size = F.length(view)
    cost = F.greatest(F.lit(len(classes)) - size, F.lit(0)) * missing + F.greatest(size - len(classes), F.lit(0)) * extra
    for i, chosen in enumerate(classes, 1):
        if chosen != ANY:
            allowed = bytes(sorted(chosen)).decode("ISO-8859-1")
            cost = cost + F.when((size >= i) & (F.instr(F.lit(allowed), F.substring(view, i, 1)) == 0), 1).otherwise(0)
    return cost
