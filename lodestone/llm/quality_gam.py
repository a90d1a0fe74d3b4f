"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Cyclic boosting visits the features in turn and grows a shallow tree on one of them
each time; trees on one feature only add up to a table with a value per bin. Then pairs are ranked by what a table on both
could still explain, and the best get tables of their own, boosted in the same way. A score is the sum of table values:
bins are found and added for a whole batch at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import map_rows

#: Labelled rows used for training at most: those of the labels table that come first by a hash of doc_id.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_chars", "word_spread", "upper", "digits", "symbols", "punctuation", "other_ascii", "not_ascii", "pipes", "line_words", "line_repeats", "distinct_words", "short_words", "trigram_repeats")
_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=\\{}[]", b".,;:!?'\"()-", b"|"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 6
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz \t\n\r\x0b\x0c")] = 7


def measure(text: str | None) -> list[float]:
    """The features of one whole text; empty texts have zeros."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)
    size = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    threes = n - 2
    share = 1 / len(data)
    return [
        float(np.log1p(n)), float(size.mean()), float(size.std()), count[1] * share, count[2] * share, count[3] * share, count[4] * share, count[0] * share, count[6] * share, count[5] / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), len(set(words)) / n, float((size <= 3).mean()), 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes if threes > 0 else 0.0,
    ]


@dataclass(frozen=True)
class Model:
    """margin = start + sum of single[j][bin_j] + sum over pairs of table[bin_i, bin_j]; cuts[j]: the bins' borders."""

    start: float
    cuts: tuple[np.ndarray, ...]
    single: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self.bins(x)
        out = np.full(len(x), self.start)
        for j, table in enumerate(self.single):
            out += table[b[:, j]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return sigmoid(out)


def _shallow(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree with so many leaves over one ordered feature; g, h: sums per bin."""
    value, parts = np.zeros(len(g)), [(0, len(g))]
    fit = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + penalty)
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(gl):
                gain = gl**2 / (hl + penalty) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + penalty) - fit(a, b)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (gain[k], a, a + k + 1, b)
        if best is None or best[0] <= 1e-9:
            break
        _, a, m, b = best
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    for a, b in parts:
        value[a:b] = -g[a:b].sum() / (h[a:b].sum() + penalty)
    return value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 2.0, bins: int = 32, pairs: int = 4, pair_rounds: int = 40, pair_bins: int = 6) -> Model:
    n, width = x.shape
    cuts = tuple(np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width))
    b = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, start)
    single = [np.zeros(len(c) + 1) for c in cuts]
    for _ in range(rounds):
        for j in range(width):
            p = sigmoid(margin)
            step = rate * _shallow(np.bincount(b[:, j], p - y, len(single[j])), np.bincount(b[:, j], p * (1 - p), len(single[j])), penalty)
            single[j] += step
            margin += step[b[:, j]]
    # Pairs: coarse bins, ranked by the gain of one table over what is left.
    coarse = [np.minimum(np.arange(len(s)) * pair_bins // len(s), pair_bins - 1) for s in single]
    p = sigmoid(margin)
    g, h = p - y, p * (1 - p)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]], v, pair_bins**2)

    gains = sorted(((float((sums(i, j, g) ** 2 / (sums(i, j, h) + penalty)).sum()), i, j) for i in range(width) for j in range(i)), reverse=True)[:pairs]
    tables = {(i, j): np.zeros(pair_bins**2) for _, i, j in gains}
    for _ in range(pair_rounds):
        for (i, j), table in tables.items():
            p = sigmoid(margin)
            gs, hs = (sums(i, j, v).reshape(pair_bins, pair_bins) for v in (p - y, p * (1 - p)))
            # A tree of depth two: a cut on one of the two, then a cut on the other on either side.
            best = None
            for turned, (ga, ha) in ((False, (gs, hs)), (True, (gs.T, hs.T))):
                for m in range(1, pair_bins):
                    value = np.concatenate([np.tile(_shallow(q.sum(0), w.sum(0), penalty, 2), (len(q), 1)) for q, w in ((ga[:m], ha[:m]), (ga[m:], ha[m:]))])
                    gain = -(ga * value + (ha + penalty / pair_bins**2) * value**2 / 2).sum()
                    if best is None or gain > best[0]:
                        best = (gain, value.T if turned else value)
            step = rate * best[1].reshape(-1)
            table += step
            margin += step[coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]]
    wide = tuple((i, j, t.reshape(pair_bins, pair_bins)[np.ix_(coarse[i], coarse[j])]) for (i, j), t in tables.items())
    return Model(start, cuts, tuple(single), wide)


def fold(doc_id: int | None) -> int:
    """crc32 of doc_id as text, modulo 3; fold 1 is held out. A null doc_id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of at most `rows` labelled documents outside the held-out fold, one row for a doc_id: of repeated labels the
    greatest, of repeated documents the least text counts. The bounded label rows are broadcast, so only texts of the sample are shuffled."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    y = y.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from the bounded sample; without rows of both labels, one that gives every text the share of label 1 (a half without labels)."""

    def make():
        def work(keys, texts, ys):
            return {"y": ys, "x": [measure(t) for t in texts.to_pylist()]}

        return work

    got = map_rows(sample(docs, labels, label, rows), ["doc_id", "text", "y"], make, "y int, x array<double>", pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])).toArrow()
    y = got.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        start = 0.0 if not len(y) else 5.0 if y[0] else -5.0
        return Model(start, tuple(np.zeros(0) for _ in FEATURES), tuple(np.zeros(1) for _ in FEATURES), ())
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the rows
    return fit(x[order], (y[order] > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null text scores as an empty one. Repeated rows each give a row; other columns are not read. Labels of the held-out fold
    are never read by the training."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows))

    def make():
        def work(keys, texts):
            score = model.value.score(np.array([measure(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES)))
            return {"doc_id": keys, "held_out": [fold(k) == 1 for k in keys.to_pylist()], "score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return work

    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], make, "doc_id long, held_out boolean, score double, predicted int", kinds)
