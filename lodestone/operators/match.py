"""What a keyword query asks for: phrases joined by AND, OR and NOT.

Words side by side must all match and bind tightest; then NOT, AND and OR, each from left to right. Only these words in capitals are
operators. A query that begins or ends with one, or has two in a row, is malformed and matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOOSEST_FIRST = ("OR", "AND", "NOT")


@dataclass(frozen=True)
class Match:
    """A node: a phrase by its number (all words of several side by side are joined by AND), or an operator over its parts; no parts
    and no phrase: nothing matches."""

    kind: str = "none"
    phrase: int = -1
    parts: tuple["Match", ...] = ()

    def holds(self, has: Callable[[int], Column]) -> Column:
        """Whether a row matches, by whether it has each phrase."""
        if self.kind == "phrase":
            return has(self.phrase)
        if self.kind == "none":
            return F.lit(False)
        found = [p.holds(has) for p in self.parts]
        return reduce({"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "NOT": lambda a, b: a & ~b}[self.kind], found)

    def counted(self, has: Callable[[int], Column]) -> list[tuple[int, Column]]:
        """(phrase, whether it adds to a matching row's rank): those of parts that match themselves, and none of what NOT excludes."""
        if self.kind == "phrase":
            return [(self.phrase, has(self.phrase))]
        inside = [c for p in (self.parts[:1] if self.kind == "NOT" else self.parts) for c in p.counted(has)]
        own = self.holds(has) if inside and self.kind != "OR" else F.lit(True)
        return [(i, c & own) for i, c in inside]

    @property
    def plain(self) -> bool:
        """Whether it is some phrases, all of which must be there."""
        return self.kind == "phrase" or self.kind == "AND" and all(p.plain for p in self.parts)


class Malformed(ValueError):
    """An operator without something on both sides."""


def parsed(query: str, cut: Callable[[str], list[str]]) -> tuple[list[list[str]], Match]:
    """(phrases, what must match) of a query; cut gives a word's terms, which are a phrase if they are several. Raises Malformed.

    A word without terms asks for nothing; where one stands alone beside an operator, nothing matches it."""
    phrases: list[list[str]] = []
    words = query.split()

    def side_by_side(part: list[str]) -> Match:
        if not part:
            raise Malformed(query)
        found = []
        for p in filter(None, map(cut, part)):
            found.append(Match("phrase", len(phrases)))
            phrases.append(p)
        return Match("AND", parts=tuple(found)) if len(found) > 1 else found[0] if found else Match()

    def level(part: list[str], operators: tuple[str, ...]) -> Match:
        if not operators:
            return side_by_side(part)
        ends = [-1, *[i for i, w in enumerate(part) if w == operators[0]], len(part)]
        found = tuple(level(part[a + 1 : b], operators[1:]) for a, b in zip(ends, ends[1:], strict=False))
        return Match(operators[0], parts=found) if len(found) > 1 else found[0]

    return phrases, level(words, _LOOSEST_FIRST) if words else Match()
