"""Personal data: base patterns, and boosted trees over the spans that high-recall generators propose.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Generators then propose further spans of these kinds,
which may overlap and have no limit of length: addresses with `at` and `dot` spelled out, bracketed or spaced, or with letters
beyond ASCII; IPv6, and IPv4 with bracketed or spaced dots; of a run of digit groups every row of successive groups whose digits
fit a card or a phone number, local numbers of seven digits among them. Boosted trees weigh each candidate's format and context;
a calibration on held-out examples turns margins into probabilities, and a threshold for each kind selects. Of overlapping
candidates the likelier stays; none may touch a base span.

The tables hold no labelled personal data, so the trees are trained on sentences made here from fixed seeds: planted values of
each kind and look-alikes (orders, dates, versions, amounts, serial numbers, places), alone and side by side. Training takes some
seconds on the driver. Recall and precision are tested on sentences written by hand,
none of which is trained on, though their misses guided the choice of formats.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit, sigmoid
from .common import in_slices, map_rows, ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end
#: Candidates whose features are held at a time.
BLOCK = 20_000

# Base patterns. Possessive repeats and look-behinds keep long runs linear; they match what the plain patterns match.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9][0-9.\x20()-]{6}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    at = text.find("@")
    ended = 0
    while at >= 0:
        start = at
        while start > ended and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            ended = m.end()
            out.append((0, start, ended))
            at = text.find("@", ended)
        else:
            at = text.find("@", at + 1)
    if _HINT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _digits(m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Generators: (kind, pattern, a cheap test that must hold before the pattern is tried).
# Patterns begin with one set of characters where they can: places that cannot begin a match are then passed over fast.
_CORE = re.compile(r"[@Aa](?:(?<=@)|(?<=\b[Aa])(?:[Tt]|[Rr][Rr][Oo][Bb][Aa])\b)")
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?|\s+(?:at|arroba)\s+|\s+@\s*|@\s+|@(?=[^\W\d_])", re.I)
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.|punkt|point|punto)\s?[\])}>]\s?|\s+(?:dot|punkt|point|punto)\s+|\s\.\s|\.(?=\w))"
_LABELS = re.compile(rf"[^\W_][\w-]*+(?:{_DOT}[^\W_][\w-]*+)+", re.I)
_LOCAL = re.compile(r"[\w.%+-]")
_SPELLED_DOT = re.compile(r"\bdot\b|\bpunkt\b|\bpoint\b|\bpunto\b", re.I)
_SPACED_V4 = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\s\.\s?|\.\s?)[0-9]{1,3}+){3}(?![0-9]|\.[0-9])", re.I)
#: Common last labels of addresses.
LAST_LABELS = frozenset("com org net edu gov mil int info biz io co dev app ai me tv de fr es it nl be ch at uk eu us ca mx ar br pt pl se no dk fi ie au nz jp cn in example test".split())
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_V6_SHORT = re.compile(r"(?<![0-9A-Za-z_:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z_]|:[0-9A-Za-z:])")
_RUN = re.compile(r"[0-9]++(?:(?:[\x20().\-/\u00a0\u2009\u2011\u2013](?=[0-9(\x20/\-\u00a0]))++[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_GAPS = re.compile(r"[^0-9]+")
_LEFT = re.compile(r"([0-9]+)([\x20().\-/\u00a0\u2009\u2011\u2013]+)$")
_RIGHT = re.compile(r"([\x20().\-/\u00a0\u2009\u2011\u2013]+)([0-9]+)")
_PHONE_WORDS = re.compile(r"phone|tel|tél|call|mobile|cell|fax|whatsapp|dial|contact|appel|anruf|ruf|movil|móvil|llam|ring|handy|portable|numéro|rappel|marque|text me|reach|sms|hotline", re.I)
_CARD_WORDS = re.compile(r"card|visa|credit|debit|amex|master|carte|karte|tarjeta|payment|paid|pan\b", re.I)
_ID_WORDS = re.compile(r"order|invoice|ref|id\b|number|nr\b|no\.|version|build|serial|isbn|date|part|sku|ticket|total|amount|page|room|zip|item|case|model|rechnung|pedido|commande|line|row|score|code|between|years|chapter|section", re.I)
_PLACE_WORDS = re.compile(r"\b(?:look|meet|met|see|saw|read|arrive|stay|visit|work|works|stop|sit|live|hosted|available|browse|shop|buy|seen|found|docs|online|sold)\b", re.I)
_MAIL_WORDS = re.compile(r"mail|write|contact|send|reach|adress|address|correo|courriel|schreib|kontakt|écri|escrib|ask|reply|user|account|forward|drop|ping|message", re.I)


_PARTS = re.compile(_DOT, re.I)


def _numbers(text: str) -> Iterator[Span]:
    """Of each run of digit groups every row of successive groups with 13 to 19 digits (card) or 7 to 15 (phone), with its opening bracket or plus sign."""
    for run in _RUN.finditer(text):
        at, end = run.span()
        if end - at < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, at, end)]
        whole = not text[end : end + 1].isascii() or not text[end : end + 1].isalpha()
        outer = text[at - 1 : at]
        for i, (first, _) in enumerate(groups):
            if not i and outer and (outer == "." or outer.isascii() and outer.isalpha()):
                continue
            n = 0
            for j in range(i, len(groups)):
                last = groups[j][1]
                n += last - groups[j][0]
                if n > 19:
                    break
                if n >= 7 and (whole or j < len(groups) - 1) and (n > 7 or j > i):
                    before = text[first - 1 : first]
                    start = first - 1 if before == "(" and ")" in text[first:last] or before == "+" else first
                    if before == "(" and text[first - 2 : first - 1] == "+":
                        start = first - 2
                    if n >= 13:
                        yield 2, start, last
                    if n <= 15:
                        yield 3, start, last


def _addresses(text: str) -> list[Span]:
    """A local part, an `at` in some form, labels and at least one dot in some form. Parts are sought from each `at` on, outwards and
    no further than the one before it, so the time is linear."""
    found: list[Span] = []
    done = 0
    for core in _CORE.finditer(text):
        at = core.start()
        before = text[max(0, at - 2) : at]
        if before.rstrip()[-1:] and before.rstrip()[-1] in "[({<":  # the bracket, and a blank before it
            at -= len(before) - len(before.rstrip()) + 1
            at -= text[at - 1 : at].isspace()
        else:
            while at > done and text[at - 1].isspace():
                at -= 1
        m = _AT.match(text, at)
        if not m or at < done:
            continue
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        right = _LABELS.match(text, m.end())
        if start < at and right:
            spaced = m[0].isspace() or m[0].strip().isalpha()
            # Without any sign of its own, `at` is told from the plain word by a dot inside the labels or one spelled out.
            if not spaced or "." in right[0].rstrip(".") or _SPELLED_DOT.search(right[0]):
                end = right.end()
                while text[end - 1] in "-_":
                    end -= 1
                found.append((0, start, end))
        done = m.end()
    return found


def proposed(text: str, taken: list[Span]) -> Iterator[Span]:
    """Spans that generators propose; they may overlap each other, not the taken ones."""
    found: list[Iterator[Span]] = [iter(_addresses(text)), _numbers(text)]
    if "." in text or _SPELLED_DOT.search(text):
        found.append((1, m.start(), m.end()) for m in _SPACED_V4.finditer(text) if all(_small_part(g) for g in _GROUP.findall(m[0])))
    if text.count(":") >= 7:
        found.append((1, m.start(), m.end()) for m in _V6.finditer(text))
    if "::" in text:
        found.append((1, m.start(), m.end()) for m in _V6_SHORT.finditer(text) if 1 <= sum(map(bool, m[0].split(":"))) <= 7)
    # Of the taken spans that start before a candidate's end, the furthest end tells whether one touches it.
    begins = sorted((s, e) for _, s, e in taken)
    ends = [-1, *accumulate((e for _, e in begins), max)]
    return (c for c in chain.from_iterable(found) if ends[bisect_left(begins, (c[2],))] <= c[1])


def candidates(text: str, taken: list[Span]) -> list[Span]:
    return list(proposed(text, taken))


def _assigned(s: str) -> bool:
    """Whether an IPv6 address begins as assigned ones do: global, unique local, link-local or multicast, or is the loopback."""
    first = int(s[: s.find(":")] or "0", 16)
    return 0x2000 <= first <= 0x3FFF or 0xFC00 <= first <= 0xFDFF or 0xFE80 <= first <= 0xFEBF or first >= 0xFF00 or s == "::1"


def features(text: str, c: Span) -> list[float]:
    """Format of the span and the words and characters around it."""
    kind, start, end = c
    s, before = text[start:end], text[max(0, start - 30) : start]
    digits = _digits(s)
    groups = [g for g in _GAPS.split(s) if g]
    sizes = [len(g) for g in groups] or [0]
    gaps = {g for g in _GAPS.findall(s) if g}
    last, after = text[start - 1 : start], text[end : end + 1]
    at = _AT.search(s) if kind == 0 else None
    sign = at[0].strip() if at else ""
    labels = _PARTS.split(s[at.end() :]) if at else []
    # The groups beside a row of groups tell whether it is cut from a longer number.
    left, right = _LEFT.search(before), _RIGHT.match(text, end, end + 30)
    return [
        float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3),
        len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        float("(" in s), float(" " in gaps), float("-" in gaps), float("." in gaps), float("/" in gaps), len(gaps),
        float(s.startswith("0")), float(s.startswith("00")), float(s.startswith("(")),
        float(luhn(digits)) if digits else 0.0, float(sizes in ([4, 2, 2], [2, 2, 4], [1, 2, 4], [2, 1, 4])), float(len(set(digits)) <= 2),
        float(len(sizes) > 1 and set(sizes[1:]) == {3} and len(gaps) == 1), float(digits[:1] in "3456" and digits != ""),
        float(bool(_PHONE_WORDS.search(before))), float(bool(_CARD_WORDS.search(before))), float(bool(_ID_WORDS.search(before))), float(bool(_MAIL_WORDS.search(before))),
        float(last in "#$€£=_:"), float(after in "%€$£_=" and after != ""),
        len(left[1]) if left else 0, len(right[2]) if right else 0, float(bool(left) and left[2] in gaps), float(bool(right) and right[1] in gaps),
        float(bool(left) and left[2] != " "), float(bool(right) and right[1] != " "), s.count(":"), float("::" in s), float(kind == 1 and ":" in s and _assigned(s)),
        float(sizes in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3], [4, 4, 4, 1])), float(sizes in ([3, 3, 4], [2, 2, 2, 2, 2], [4, 3, 3, 3])), float(len(gaps) == len(sizes) - 1),
        float(sign.lower() in ("at", "arroba")), float("@" in sign), float(len(sign) > 2 and not sign.isalpha()), float(bool(_SPELLED_DOT.search(s))), len(labels), float(bool(labels) and labels[-1].lower() in LAST_LABELS),
        at.start() if at else 0, float(bool(at) and not s[: at.start()].islower()), float(bool(_PLACE_WORDS.search(before))) if kind == 0 else 0.0, float(s.startswith("+")), float(sizes == [3, 4]), float("[" in s or "{" in s), float(after.isalpha()),
        float(min(sizes) == 3 and max(sizes) == 4 and sizes[-1] == 4),
    ]


def _with_luhn(rng: random.Random, n: int) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _example(rng: random.Random) -> tuple[str, int, str]:
    """A sentence, the kind planted in it (-1: a look-alike) and the planted string."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "ti", "er", "le", "os", "cha", "mo", "ru")) for _ in range(rng.randint(1, 3)))
    kind = rng.choice((0, 0, 1, 2, 2, 3, 3, 3, -1, -1, -1, -1, -1, -1))
    if kind == 0:
        a, b = rng.choice((("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "(dot)"), ("{at}", "."), (" at ", " dot "), (" at ", " dot "), (" @ ", "."), (" @ ", " . "), ("@ ", "."), (" AT ", " DOT "), (" (@) ", ".")))
        place, last = rng.choice((word(), word(), f"{word()}-{word()}", f"{word()}{b}{word()}")), rng.choice(("com", "org", "net", "de", "fr", "es", "io", "co", "edu"))
        s, lead = f"{word()}{rng.choice(('.', '_', '', '-', '+'))}{word()}{rng.choice(('', '', num(2)))}{a}{place}{b}{last}", rng.choice(("mail", "write to", "contact", "reach", "email", "send it to", "schreib an", "ask", word(), word()))
        if rng.random() < 0.15:
            s = f"{word()}{rng.choice('éüñöá')}{word()[0]}{rng.choice('éüñ')}@{word()}{rng.choice('üéñ')}.{last}"
    elif kind == 1:
        s, lead = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), rng.choice(("host", "from", "address", word()))
        if rng.random() < 0.5:
            s = rng.choice(("[.]", "(.)", " . ", "[dot]", " [.] ", " (dot) ")).join(str(rng.randrange(256)) for _ in range(4))
            lead = rng.choice(("host", "from", "address", "server", "ip", "blocked", word()))
    elif kind == 2:
        d = _with_luhn(rng, rng.choice((13, 15, 16, 16, 16, 19)))
        gap = rng.choice((".", "/", " ", "-", "  ")) if len(d) == 16 else rng.choice((" ", "-", ""))
        parts = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)]
        s, lead = gap.join(parts), rng.choice(("card", "visa", "credit card", "paid with card", "carte", "payment by"))
    elif kind == 3:
        s = rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{rng.choice('2345678')}{num(2)}-{num(3)}-{num(4)}", f"00{rng.choice('1345')}{num(1)} {num(3)} {num(3)} {num(3)}", f"0{rng.choice('1234567')} {num(2)} {num(2)} {num(2)} {num(2)}", f"({num(3)}) {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{rng.choice('23456789')}{num(2)}-{num(4)}", f"{rng.choice('23456789')}{num(2)} {num(4)}", f"+{rng.choice('1345')}{num(1)}/{num(3)}/{num(6)}", f"+{num(2)}/{num(8)}", f"0{num(3)}/{num(6)}", f"0{num(2)}-{num(7)}", f"{num(3)}\u2013{num(3)}\u2013{num(4)}", f"9{num(2)} {num(3)} {num(3)}"))
        if rng.random() < 0.5:  # any national grouping
            sizes = rng.choice(((3, 3, 4), (4, 3, 4), (4, 6), (3, 7), (2, 2, 2, 2, 2), (3, 3, 3), (5, 6), (2, 8), (4, 3, 3), (3, 4, 4), (3, 4), (3, 4), (4, 7), (4, 2, 4, 4), (4, 3, 3, 4), (4, 2, 3, 4)))
            gap = rng.choice((" ", "-", ".", " "))
            parts = [num(k) for k in sizes]
            parts[0] = (rng.choice("23456789") if sizes in ((3, 3, 4), (3, 4), (3, 3, 3)) else "00" if len(sizes) == 4 else "0") + parts[0][2 if len(sizes) == 4 else 1 :]
            s = parts[0] + rng.choice((gap, gap, "/", " / ")) * (len(parts) > 1) + gap.join(parts[1:])
        lead = rng.choice(("phone", "tel", "call", "mobile", "fax:", "dial", "appelez", "contact", "ring me on", "call me at", "tel.:", "my cell is", "handy", "teléfono", "móvil:", "numéro :", "text me at", "hotline", "ruf an", "cell"))
        lead += rng.choice(("", "", "", " is", " on", " under", " number", " me at", f" {word()}", f" {word()} {word()}"))
    else:
        s = rng.choice((num(rng.randint(9, 19)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}", f"{num(1)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(5)}-{num(6)}", f"{num(3)} {num(3)} {num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)}-{num(7)}-{num(7)}", f"{word()} (at) {word()}.{word()}", f"{num(3)}-{num(4)}", f"{num(3)} {num(4)}", f"{num(3)}-{num(4)}", f"{word()} at {word()}.{rng.choice(('com', 'org', 'net', 'io'))}", f"{word()} at {word()}.{rng.choice(('com', 'org', 'net', 'io'))}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} point {word()}", f"{word()} @ {num(2)}.{num(2)}", f"{num(1)} . {num(1)} . {num(1)} . {num(1)}", f"20{num(2)}\u201320{num(2)}", f"19{num(2)}-20{num(2)}", f"{num(5)}-{num(4)}", f"{num(4)}/{num(4)}"))
        if " at " in s:
            lead = rng.choice(("look", "meet", "see us", "read it", "they arrive", "stay", "works", "shop", "hosted", "available", "browse", word()))
            return f"{word()} {word()} {lead} {s} {word()} {word()}", kind, s
        lead = rng.choice(("room", "between", "item", "zip", "case", "years", "model", "code", "score", "order", "invoice", "ref", "version", "date", "total", "isbn", "page", "ticket", word(), word(), word(), word(), word()))
    left, right = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(4))
    return f"{left} {lead} {s} {right}", kind, s


def _row(rng: random.Random) -> tuple[str, list[Span]]:
    """Numbers side by side as in lists and table rows, or a compressed IPv6 address or what looks like one, and the planted spans."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = ("an", "tier", "leos", "cha", "moru", "bad", "add", "list", "std", "face")
    text, spans = " ".join(rng.choice(words) for _ in range(3)) + " ", []
    if rng.random() < 0.2:
        parts = [f"{rng.randrange(65536):x}" for _ in range(rng.randint(1, 6))]
        cut = rng.randint(0, len(parts))
        good = rng.random() < 0.5
        if good:
            s = rng.choice((f"{rng.choice(('2001', 'fe80', '2a02', 'fd00'))}:{':'.join(parts[:cut])}::{':'.join(parts[cut:])}".replace(":::", "::"), f"fe80::{':'.join(parts)}", "::1"))
        else:
            s = rng.choice((f"{rng.choice(words)}::{rng.choice(words)}", f"{num(2)}::{num(2)}", "a::b", "::", f"::{rng.choice(words)}", f"{rng.choice(words)}::"))
        lead = rng.choice(("host", "from", "address", "ping", "server")) if good else rng.choice(("call", "use", "type", "from", "at"))
        text += f"{lead} "
        if good:
            spans.append((1, len(text), len(text) + len(s)))
        return text + s + rng.choice((" ", ", ", ". ", "")) + " ".join(rng.choice(words) for _ in range(3)), spans
    mode = rng.choice((2, 3, 3, -1, -1))
    lead = {2: ("card", "visa", "cards:", "payment", "paid with"), 3: ("phone", "tel", "call", "phones:", "mobile", "fax"), -1: ("order", "total", "row", "page", "data", "")}[mode]
    text += rng.choice((*lead, "")) + " "
    join = rng.choice((" ", " ", "  ", "    ", " / ", "/", ", "))
    gap, style = rng.choice((" ", "-", ".")), rng.randrange(6)
    for k in range(rng.randint(2, 6) if mode == -1 else rng.randint(1, 4)):
        kind, s = mode, ""
        if mode == 2 and k % 2 == 0:
            d = _with_luhn(rng, rng.choice((13, 15, 16, 16, 16, 16, 19)))
            cuts = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)]
            s = gap.join(cuts)
        elif mode == 2:
            kind, s = -1, rng.choice((f"{num(2)}/{num(2)}", f"{num(2)}/20{num(2)}", num(3), f"{num(2)}/{num(2)} {num(3)}", f"{num(1)}.{num(2)}"))
            if rng.random() < 0.25:
                kind, s = 2, gap.join(d[i : i + 4] for d in [_with_luhn(rng, 16)] for i in range(0, 16, 4))
        elif mode == 3 and (k == 0 or rng.random() < 0.7):
            a = f"{rng.choice('2345678')}{num(2)}"
            s = (f"{a}-{num(3)}-{num(4)}", f"({a}) {num(3)}-{num(4)}", f"{a}.{num(3)}.{num(4)}", f"0{rng.choice('1234567')} {num(2)} {num(2)} {num(2)} {num(2)}", f"({a}) {num(3)} {num(4)}", f"00{rng.choice('1345')}{num(1)} {num(3)} {num(3)} {num(3)}")[style]
        elif mode == 3:
            kind, s = -1, rng.choice((num(2), num(3), f"{num(2)}/{num(2)}/{num(4)}", f"20{num(2)}-{num(2)}-{num(2)}", num(5)))
        else:
            s = rng.choice((num(rng.randint(1, 6)), num(rng.randint(1, 6)), num(4), num(style + 1), f"{num(3)}.{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(3)}.{num(3)}", f"{num(2)}-{num(2)}", num(rng.randint(8, 14))))
        text += join if k else ""
        if kind >= 0:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s
    return f"{text} {rng.choice(words)} {rng.choice(words)}", spans


@dataclass(frozen=True)
class Model:
    """p = sigmoid(scale * margin + shift); a candidate of a kind is taken from its threshold on."""

    trees: Trees
    scale: float
    shift: float
    least: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.trees.margin(x) + self.shift)


@lru_cache(maxsize=4)
def train(examples: int = 6000, precision: float = 0.97, seed: int = 11) -> Model:
    """Two thirds of the examples grow the trees, the others calibrate: Platt scaling, then for each kind the least threshold that keeps the precision."""
    rng, beside, rows = random.Random(seed), random.Random(seed + 1), []
    x: list[list[float]] = []
    y: list[bool] = []
    for _ in range(examples):
        text, kind, planted = _example(rng)
        where = text.find(planted)
        for c in candidates(text, base_spans(text)):
            x.append(features(text, c))
            y.append(c[0] == kind and where <= c[1] + 1 and c[2] <= where + len(planted) + 1 and c[2] - c[1] >= len(planted) - 2)
        if len(rows) < examples // 2:
            rows.append(_row(beside))
            text, spans = rows[-1]
            for c in candidates(text, base_spans(text)):
                x.append(features(text, c))
                y.append(c in spans)
    a, b = np.array(x, float), np.array(y, float)
    own = np.arange(len(a)) % 3 < 2
    trees = fit(a[own], b[own], rounds=50)
    margin, t = trees.margin(a[~own]), b[~own]
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt scaling
        p = sigmoid(scale * margin + shift)
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin**2).sum() + 2.0, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((p - t) * margin).sum() + 2.0 * (scale - 1), (p - t).sum()])
        scale, shift = scale - step[0], shift - step[1]
    p, least = sigmoid(scale * margin + shift), []
    for k in range(len(KINDS)):
        at = a[~own][:, k] == 1
        pk, tk = p[at], t[at]
        order = np.argsort(-pk, kind="stable")
        good = np.cumsum(tk[order]) / np.arange(1, len(order) + 1) >= precision
        least.append(max(0.5, float(pk[order][np.flatnonzero(good)[-1]])) if good.any() else 1.1)
    return Model(trees, float(scale), float(shift), tuple(least))


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans by kind and start, and the added ones by kind and start."""
    base = base_spans(text)
    likely: list[tuple[float, int, Span]] = []
    for block in batched(proposed(text, base), BLOCK):  # a text full of digits has many candidates
        p = model.probability(np.array([features(text, c) for c in block]))
        likely += [(-x, len(likely) + i, c) for i, (x, c) in enumerate(zip(p.tolist(), block, strict=True)) if x >= model.least[c[0]]]
    added: list[tuple[int, int, int]] = []  # start, end, kind: in order and apart
    for _, _, (kind, start, end) in sorted(likely):
        k = bisect_left(added, (end,))
        if not k or added[k - 1][1] <= start:
            insort(added, (start, end, kind))
    return base, sorted((kind, start, end) for start, end, kind in added)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs.

    A null or empty text has no spans and the digest of no bytes. Repeated rows each give a row; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(train())

    def make():
        def work(keys, texts):
            out: dict = {"doc_id": keys, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS}
            for text in texts.to_pylist():
                base, added = find(text or "", model.value)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out["spans"].append(_listed(sorted(base + added)))
            return out

        return work

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", pa.schema(list(zip(names, kinds, strict=True))))


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, becomes its first kind's name in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced, and n_chars, if there is one, set to the new length. Null texts stay null, empty ones empty;
    repeated rows each give a row, and other columns keep their names and values."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train())

    def clean_text(t: str | None) -> str | None:
        base, added = find(t, model.value) if t else ([], [])
        return redact_text(t, base + added) if base or added else t

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: pa.array(map(clean_text, part), pa.string()))

    names = docs.columns
    done = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), clean("text").alias("text"))
    count = lambda: F.when(F.col("text").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[F.col("text") if c == "text" else count().alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names])
