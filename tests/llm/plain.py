"""Plain Python versions of the contracts, against which the operators are held."""

import hashlib
import re
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Rows with nulls, empty and long texts, repeats, and columns whose names clash with those used inside.
MESSY = [
    (1, "the cat sat on the mat " * 30, "en", "a", 5, "x"),
    (1, "the cat sat on the mat " * 30, "en", "a", 5, "x"),
    (2, "the cat sat on the mat " * 30, None, None, None, None),
    (None, "A null id. token = 'abcdef123' mail a.b@c.org 4111111111111111 +1 (234) 555-7777, 10.0.0.1", "en", "b", 1, "y"),
    (3, None, "en", "b", None, "y"),
    (4, "", "de", "b", 0, "z"),
    (5, " \t\n\x0b\x0c\r ", "de", "c", 7, "z"),
    (6, "Éa é ñ 𝄞 word " + "long" * 20000, "fr", "c", 9, "z"),
    (7, "two words", "fr", "c", 9, "z"),
    (8, "line one of it\nline one of it\nother line here\n\n" * 3, "es", "d", 9, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string"


def fingerprint(text):
    w = WORDS.findall((text or "").translate(UPPER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows, by comparing all fingerprints."""
    fps = [fingerprint(t) for _, t in rows]
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    own = sorted(up)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps, strict=True)]


def quality(text):
    t = text or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def contamination(text, items):
    """(n_words, n_hit, ids)."""
    cut = lambda t: TERMS.findall((t or "").translate(UPPER))
    w, hit, ids = cut(text), set(), set()
    for i, t in items:
        b = cut(t)
        for k in range(max(1, len(b) - 9)) if b else ():
            win = b[k : k + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
