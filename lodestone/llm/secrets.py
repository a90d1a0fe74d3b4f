"""Secret scans: all rules in one deterministic automaton, run over the UTF-8 bytes of a text in one pass.

The whole regular expressions of all rules are compiled by subset construction, their product is minimised into one transition
table (some 13,000 states for the production rules), and a step of the scan is one look-up. The automaton searches for each
rule's leftmost, longest, non-overlapping matches by itself: a step tells when a match has ended, and nothing else is done
until then, so candidates that fail cost no more than other text. The start of a match is found by running the rule's reversed
automaton back over it, never past the match before: the time is linear in the text, whatever the text is. The rules' length
limits then drop matches; a dropped match still uses up its text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, Search, backwards, compile_patterns, parse, search
from .common import map_rows


@dataclass(frozen=True)
class Rule:
    """Matches of pattern with at least `least` characters, of which at least value_least come after the longest match of head."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""
    value_least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_HEAD = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?"
#: Production rules in the order in which spans at the same place are listed; the first three are the base ones.
RULES = (
    Rule("assign", f"{_HEAD}[A-Za-z0-9+/_.=-]+", head=_HEAD, value_least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("session", "ASIA[A-Z0-9]+", least=20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("pay", "[rs]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=30),
)
BASE = ("assign", "access", "hex")


def _linked(a: Search) -> tuple[list[list], list[tuple[list, list[int]]]]:
    """Rows whose entries are the next rows themselves, and the events. Where a match has ended the entry is the number of an
    event (the next row, the rules), on which the scan loop stumbles. The entry after the classes lists the rules whose match
    ends with the text. A step of the loop is then one look-up."""
    rows: list[list] = [[] for _ in a.table]
    events: list[tuple[list, list[int]]] = []
    bits = lambda m: [k for k in range(m.bit_length()) if m >> k & 1]
    for row, to, done, last in zip(rows, a.table.tolist(), a.done.tolist(), a.last.tolist(), strict=True):
        row.extend([rows[t] for t in to])
        for c, m in enumerate(done):
            if m:
                row[c] = len(events)
                events.append((rows[to[c]], bits(m)))
        row.append(bits(last))
    return rows, events


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], every: Search, reverse: list[Automaton], heads: list[Automaton | None]):
        self.rules, self.every, self.reverse, self.heads = rules, every, reverse, heads
        self.dead, self.linked = [_dead(a) for a in reverse], None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"linked": None}  # made again where the scanner is used

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        if self.linked is None:
            self.linked = _linked(self.every)
        rows, events = self.linked
        found: list[tuple[int, int, int]] = []
        ended, n, row = [0] * len(self.rules), len(data), rows[0]
        it = iter(data.translate(self.every.classes))
        b = 0
        while True:
            try:
                for b in it:
                    row = row[b]
                break
            except TypeError:  # an event of the byte before b
                row, rules = events[row]
                for k in rules:
                    self._ended(k, data, n - it.__length_hint__() - 2, ended, found)
                row = row[b]
        if row.__class__ is int:
            row, rules = events[row]
            for k in rules:
                self._ended(k, data, n - 1, ended, found)
        for k in row[-1]:
            self._ended(k, data, n, ended, found)
        found.sort()
        return found

    def _ended(self, k: int, data: bytes, end: int, ended: list[int], found: list[tuple[int, int, int]]) -> None:
        """A match of rule k ends at `end`: its start is the furthest place that the reversed rule reaches."""
        a, q, at, start, least, dead = self.reverse[k], 0, end, end, ended[k], self.dead[k]
        while at > least:
            at -= 1
            q = a.table[q][a.classes[data[at]]]
            if q == dead:
                break
            if a.accepts[q]:
                start = at
        ended[k] = end
        rule = self.rules[k]
        if end - start >= rule.least and (not rule.value_least or end - _longest(self.heads[k], data, start, end) >= rule.value_least):
            found.append((start, k, end))


def _longest(a: Automaton, data: bytes, at: int, end: int) -> int:
    """The place after the longest match from at on."""
    q, best = 0, at
    while at < end:
        q = a.table[q][a.classes[data[at]]]
        at += 1
        if a.accepts[q]:
            best = at
    return best


def _dead(a: Automaton) -> int:
    return next((q for q, row in enumerate(a.table) if not a.accepts[q] and set(row) == {q}), -1)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [parse(r.pattern) for r in rules]
    return Scanner(rules, search(trees), [compile_patterns([backwards(t)], True) for t in trees], [compile_patterns([parse(r.head)], True) if r.head else None for r in rules])


def points(text: str, data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points. Each byte is decoded once at most."""
    if len(text) == len(data):
        return spans
    places = sorted({p for s in spans for p in (s[0], s[2])})
    at, byte, point = {}, 0, 0
    for p in places:
        point += len(data[byte:p].decode())
        byte = p
        at[p] = point
    return [(at[a], k, at[b]) for a, k, b in spans]


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of df.

    spans lists kind:start:end by start, then rule order; a null or empty text has none and the digest of no bytes. Repeated
    rows each give a row; other columns are not read. The automaton is compiled once, on the driver."""
    made = df.sparkSession.sparkContext.broadcast(scanner(rules))

    def make():
        s, kinds = made.value, [r.kind for r in rules]
        base = [k for k, r in enumerate(rules) if r.kind in BASE]

        def work(keys, texts):
            out = {"doc_id": keys, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in BASE}
            for text in texts.to_pylist():
                data = (text or "").encode()
                spans = s.scan(data)
                if spans:
                    spans = points(text, data, spans)
                said = [(k, f"{kinds[k]}:{a}:{b}") for a, k, b in spans]
                own = [(kinds[k], x) for k, x in said if k in base]
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _ in own))
                out["base_sha256"].append(hashlib.sha256(",".join(x for _, x in own).encode()).hexdigest())
                out["spans"].append(",".join(x for _, x in said))
            return out

        return work

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return map_rows(df, ["doc_id", "text"], make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", pa.schema(list(zip(names, kinds, strict=True))))
