"""Toxicity as ordered severity: cumulative-link regression on sparse text features.

P(grade > k) = sigmoid(x . w - cut_k) with one weight vector for all thresholds and ordered cuts. The features are a text's terms
(lower-cased runs of letters, and their beginnings of 5 and 7 letters), weighted by log(1 + count), and log(1 + words that lean to
toxic texts, per hundred words). The outputs are the probabilities of the grades and their mean, the expected severity.

The labels only say toxic or not, so only the first threshold is learned from labels. The upper grades of toxic training rows are
a weak ordinal label, which is no feature of the model: the share of a row's sentences that hold a word that leans to toxic rows,
cut at the thirds of that share among toxic rows. It says how much of a text is toxic, not how bad its words are; nothing in the
tables says that. The vocabulary is chosen on the bounded training sample; texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import map_rows, ship, stage
from .quality_gam import TRAIN_ROWS, fold, sample

GRADES = 4
#: Words that a term must follow in the training texts; how much and how clearly it must lean.
LEAST, ODDS, CLEAR = 6, 1.0, 4.0
_WORD, _END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    lean: frozenset[str]
    density: float
    cuts: tuple[float, ...]

    def margin(self, text: str | None) -> float:
        words = _WORD.findall((text or "").lower())
        known, hits = counts(words, self.weights, self.lean)
        return sum(self.weights[w] * float(np.log1p(c)) for w, c in sorted(known.items())) + self.density * _density(hits, len(words))

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Of the grades 0, 1, ..: rows as margins."""
        above = sigmoid(margins[:, None] - np.array(self.cuts)[None, :])
        edges = np.concatenate([np.ones((len(margins), 1)), above, np.zeros((len(margins), 1))], 1)
        return edges[:, :-1] - edges[:, 1:]


def beginnings(word: str) -> list[str]:
    """The word's features besides itself."""
    return [f"{word[:k]}~" for k in (5, 7) if len(word) > k]


def counts(words: list[str], terms, lean) -> tuple[Counter, int]:
    """How often each of terms occurs, and how many words lean, by themselves or by a beginning."""
    known, hits = Counter(), 0
    for w, n in Counter(words).items():
        own = [f for f in (w, *beginnings(w)) if f in terms]
        if own:
            for f in own:
                known[f] += n
            hits += n * any(f in lean for f in own)
    return known, hits


def _density(hits: int, words: int) -> float:
    return float(np.log1p(100 * hits / words)) if words else 0.0


def contexts(words: list[str]) -> dict[str, str]:
    """For each feature of a text the word before its first occurrence."""
    out: dict[str, str] = {}
    for before, w in zip(["", *words], words):  # noqa: B905
        if w not in out:
            for f in (w, *beginnings(w)):
                out.setdefault(f, before)
    return out


def leaning(seen: dict[str, tuple[int, int]], total: tuple[int, int], most: int | None = None) -> tuple[list[str], frozenset[str]]:
    """Features that tell the classes apart, the clearest first; and those of them that lean to toxic rows.

    seen: the numbers of different contexts (see contexts) of a feature in texts that are not toxic and in toxic ones, total:
    their sums over all features. Copies of a text share their contexts and add nothing. A feature is kept if its log odds are
    at least ODDS and CLEAR standard errors away from none; of those the `most` clearest, or all."""
    odds, clear = {}, {}
    for f, (good, bad) in seen.items():
        if good + bad >= LEAST:
            o = float(np.log((bad + 0.5) / (total[1] + 1)) - np.log((good + 0.5) / (total[0] + 1)))
            z = abs(o) / float(np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))
            if abs(o) >= ODDS and z >= CLEAR:
                odds[f], clear[f] = o, z
    terms = sorted(odds, key=lambda f: (-clear[f], f))[:most]
    return terms, frozenset(f for f in terms if odds[f] > 0)


def breadth(text: str, lean) -> float:
    """The share of a text's sentences with words that hold one that leans."""
    parts = [w for w in map(_WORD.findall, _END.split(text.lower())) if w]
    return sum(counts(w, lean, lean)[1] > 0 for w in parts) / len(parts) if parts else 0.0


def row(text: str, place: dict[str, int], lean: frozenset[str]) -> tuple[list[int], list[int], float, float]:
    """Columns, counts, density and breadth of a text."""
    words = _WORD.findall(text.lower())
    known, hits = counts(words, place, lean)
    return [place[w] for w in known], list(known.values()), _density(hits, len(words)), breadth(text, lean)


def grades(share: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic; 1 to GRADES - 1 for toxic ones, by the equal parts of their shares."""
    if not (toxic > 0).any():
        return np.zeros(len(share), int)
    steps = np.quantile(share[toxic > 0], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic > 0, 1 + np.searchsorted(steps, share, side="left"), 0)


def fit(rows_: list[tuple[list[int], list[int], float, float]], toxic: np.ndarray, terms: list[str], lean: frozenset[str], epochs: int = 300, penalty: float = 0.003, rate: float = 0.05) -> Model:
    """Full-batch Adam on the likelihood of the grades. Cuts are a first cut and positive steps, so they stay ordered."""
    rows = np.repeat(np.arange(len(rows_)), [len(r[0]) for r in rows_])
    cols = np.array([c for r in rows_ for c in r[0]], np.int64)
    vals = np.log1p(np.array([v for r in rows_ for v in r[1]], float))
    dens, grade = np.array([r[2] for r in rows_]), grades(np.array([r[3] for r in rows_]), toxic)
    n, width = len(rows_), len(terms)
    w = np.zeros(width + 1 + GRADES - 1)  # weights, density, first cut, log steps
    w[width + 1] = 2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    above = grade[:, None] > np.arange(GRADES - 1)[None, :]
    for t in range(1, epochs + 1):
        cuts = w[width + 1] + np.concatenate([[0.0], np.cumsum(np.exp(w[width + 2 :]))])
        x = np.bincount(rows, vals * w[cols], n) + w[width] * dens
        s = np.concatenate([np.ones((n, 1)), sigmoid(x[:, None] - cuts[None, :]), np.zeros((n, 1))], 1)
        p = np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-9)
        slope = s * (1 - s)
        gx = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p / n
        # d log p / d cut_k: of the cut below the grade (k = grade - 1) and of the one above it (k = grade).
        gc = np.array([(np.where(grade == k + 1, slope[:, k + 1], 0) / p).sum() - (np.where(grade == k, slope[:, k + 1], 0) / p).sum() for k in range(GRADES - 1)]) / n
        g = np.concatenate([np.bincount(cols, vals * gx[rows], width) + penalty * w[:width] / 10, [(gx * dens).sum()], [gc.sum()], [gc[k:].sum() * np.exp(w[width + 1 + k]) for k in range(1, GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:width] = np.sign(w[:width]) * np.maximum(np.abs(w[:width]) - rate * penalty, 0)  # sparse weights
    cuts = w[width + 1] + np.concatenate([[0.0], np.cumsum(np.exp(w[width + 2 :]))])
    return Model({t: float(x) for t, x in zip(terms, w, strict=False) if abs(x) > 1e-3}, lean, float(w[width]), tuple(map(float, cuts)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, terms_most: int | None = 4_000) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold, with the terms_most clearest terms (None: all that
    lean clearly); without rows of both labels, one that finds nothing toxic.

    Contexts are counted by Spark; the driver gets the terms that lean and a row's counts of those."""
    spark = docs.sparkSession
    texts = stage(sample(docs, labels, "toxic", rows).select("doc_id", "text", (F.col("y") > 0).alias("y")), "labelled")
    ship(spark)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                f, before, y = [], [], []
                for t, label in zip(b.column("text").slice(at, 200).to_pylist(), b.column("y").slice(at, 200).to_pylist(), strict=True):
                    c = contexts(_WORD.findall((t or "").lower()))
                    f += c.keys()
                    before += c.values()
                    y += [label] * len(c)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(before, pa.string()), pa.array(y, pa.bool_())], ["f", "before", "y"])

    found = texts.select("text", "y").mapInArrow(pairs, "f string, before string, y boolean").select("f", "y", F.xxhash64("before").alias("b")).distinct()
    seen = stage(found.groupBy("f").agg(F.count_if(~F.col("y")).alias("good"), F.count_if("y").alias("bad")), "contexts")
    total = seen.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if not total.good or not total.bad:
        return Model({}, frozenset(), 0.0, (20.0, 21.0, 22.0))
    # The driver's own test is repeated here, so that few features reach it.
    odds = F.log((F.col("bad") + 0.5) / (total.bad + 1)) - F.log((F.col("good") + 0.5) / (total.good + 1))
    z = F.abs(odds) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    most = seen.filter((F.col("good") + F.col("bad") >= LEAST) & (F.abs(odds) >= ODDS) & (z >= CLEAR)).orderBy(F.desc(z), "f")
    most = most if terms_most is None else most.limit(terms_most)
    terms, lean = leaning({r.f: (r.good, r.bad) for r in most.collect()}, (total.good, total.bad), terms_most)
    place = {f: i for i, f in enumerate(terms)}

    def make():
        def work(keys, texts, ys):
            made = [row(t or "", place, lean) for t in texts.to_pylist()]
            return {"doc_id": keys, "y": ys} | {k: [m[i] for m in made] for i, k in enumerate("cvdb")}

        return work

    kinds = pa.schema([("doc_id", pa.int64()), ("y", pa.bool_()), ("c", pa.list_(pa.int32())), ("v", pa.list_(pa.int32())), ("d", pa.float64()), ("b", pa.float64())])
    got = map_rows(texts, ["doc_id", "text", "y"], make, "doc_id long, y boolean, c array<int>, v array<int>, d double, b double", kinds).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["d"], r["c"]))  # the same model whatever the order of the rows
    return fit([(r["c"], r["v"], r["d"], r["b"]) for r in got], np.array([int(r["y"]) for r in got]), terms, lean)


def grade(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, terms_most: int | None = 4_000) -> DataFrame:
    """doc_id, held_out, score (P(grade > 0)), predicted (1 if score >= 0.5), grade (the likeliest), severity (the expected grade) for every row of docs.

    rows bounds the labelled rows that the model is trained on, terms_most its terms (None: no bound). A null text scores as an empty one. Repeated rows each give a row; other columns are not read."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, terms_most))

    def make():
        def work(keys, texts):
            p = model.value.probabilities(np.array([model.value.margin(t) for t in texts.to_pylist()], float))
            score = 1 - p[:, 0]
            return {"doc_id": keys, "held_out": [fold(k) == 1 for k in keys.to_pylist()], "score": score, "predicted": (score >= 0.5).astype(np.int32), "grade": p.argmax(1).astype(np.int32), "severity": p @ np.arange(GRADES)}

        return work

    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("grade", pa.int32()), ("severity", pa.float64())])
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], make, "doc_id long, held_out boolean, score double, predicted int, grade int, severity double", kinds)
