"""Language ID by mixtures: the proportions of all languages in each document, and the set of languages that it needs.

Every language has the distribution of its letter trigrams, counted over all rows that may be learned from. A document is a mixture:
each trigram comes from one language, drawn by the document's proportions. Expectation-maximisation finds the proportions from the
trigrams' likelihoods; then sets of languages, the largest proportions first, are fitted again, and the set with the best
likelihood less a penalty for each language is the document's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick, ship

#: Trigrams are hashed into so many cells.
CELLS = 1 << 16
#: Added to every count.
SMOOTH = 0.1
#: What a language more must gain in likelihood for each log of the document's trigrams: trigrams overlap, so more than the usual half.
PENALTY = 3.0
STEPS, CLOSE = 40, 1e-4
#: Characters whose trigrams are held at a time, and distinct trigrams times languages that are fitted together.
PIECE, TOGETHER = 1 << 20, 1 << 21
#: Languages whose counts a task holds before it hands them on.
HELD = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def cells(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the trigrams of a whole text: lower-case letters, a gap at both ends of each word, centred on a letter.
    Held a piece at a time."""
    text, total = (text or "").lower(), None
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 1) : at + PIECE + 1]  # a letter on either side, whose trigrams are those of the next piece
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.concatenate([[0], np.where(_letters()[code], code, 0), [0]]).astype(np.uint64)
        a, b, c = code[:-2], code[1:-1], code[2:]
        mixed = a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F) ^ c * np.uint64(0x165667B19E3779F9)
        centred = b != 0
        if at:
            centred[0] = False
        if at + PIECE < len(text):
            centred[-1] = False
        cell = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))[centred].astype(np.int64) % CELLS
        if len(text) <= PIECE:
            return np.unique(cell, return_counts=True)
        total = np.bincount(cell, minlength=CELLS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.flatnonzero(total), total[total > 0]


@dataclass(frozen=True)
class Model:
    """languages in order; likelihood[cell, language]."""

    languages: tuple[str, ...]
    likelihood: np.ndarray

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray) -> "Model":
        p = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(counts))
        return cls(tuple(languages), p)


def _mixtures(like: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of documents by expectation-maximisation. like[trigram, language]; size: the trigrams of each
    document, one after another. A document stops when its own proportions do, so nothing depends on what it is fitted with."""
    langs = like.shape[1]
    ones, out = np.ones(langs), np.full((len(size), langs), 1 / langs)
    todo, now, n, at, weigh = np.arange(len(size)), out.copy(), size, like, count.astype(float)
    for _ in range(STEPS):
        starts = np.cumsum(n) - n
        joint = at * np.repeat(now, n, axis=0)
        joint *= (weigh / (joint @ ones))[:, None]
        new = np.add.reduceat(joint, starts, axis=0)
        new /= (new @ ones)[:, None]
        out[todo] = new
        open_ = np.abs(new - now).max(1) > CLOSE
        now = new
        if not open_.all():
            rows = np.repeat(open_, n)
            todo, now, n, at, weigh = todo[open_], new[open_], n[open_], at[rows], weigh[rows]
            if not len(todo):
                break
    score = np.add.reduceat(count * np.log((like * np.repeat(out, size, axis=0)) @ ones), np.cumsum(size) - size)
    return out, score


def mixtures(model: Model, docs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY) -> list[list[tuple[int, float]]]:
    """For each document, by (cells, counts): its set of languages (by number) and their proportions, the largest first.

    Sets grow in order of the proportions under all languages, until a language more does not pay. No trigrams, no set."""
    out: list[list[tuple[int, float]]] = [[] for _ in docs]
    at = [i for i, (c, _) in enumerate(docs) if len(c)]
    langs = len(model.languages)
    if not at or not langs:
        return out
    names = np.concatenate([docs[i][0] for i in at])
    count = np.concatenate([docs[i][1] for i in at])
    size = np.array([len(docs[i][0]) for i in at])
    own = np.repeat(np.arange(len(at)), size)
    starts = np.cumsum(size) - size
    like = model.likelihood[names]
    whole, _ = _mixtures(like, count, size)
    order = np.argsort(-whole, axis=1, kind="stable")  # equal ones in order of name
    price = penalty * np.log(np.add.reduceat(count, starts).astype(float) + 1)
    first = order[:, :1]
    share = np.ones((len(at), 1))
    gain = np.add.reduceat(count * np.log(like[np.arange(len(own)), first[own, 0]]), starts)
    best = [(first[d], share[d]) for d in range(len(at))]
    open_ = np.arange(len(at))
    for k in range(2, langs + 1):
        rows = np.isin(own, open_)
        place = np.searchsorted(open_, own[rows])
        chosen = order[open_, :k]
        got, score = _mixtures(np.take_along_axis(like[rows], chosen[place], 1), count[rows], size[open_])
        pays = score - gain[open_] > price[open_]
        for d, s, c in zip(open_[pays], got[pays], chosen[pays], strict=True):
            best[d] = (c, s)
        gain[open_[pays]] = score[pays]
        open_ = open_[pays]
        if not len(open_):
            break
    for i, (c, s) in zip(at, best, strict=True):
        out[i] = sorted(((int(a), float(b)) for a, b in zip(c, s, strict=True)), key=lambda x: (-x[1], x[0]))
    return out


def fold(doc_id: int | None) -> int:
    """crc32 of doc_id as text, modulo 5; fold 0 is held out. A null doc_id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def learn(docs: DataFrame) -> Model:
    """A model of all rows outside of the held-out fold whose lang is not null: trigrams are counted by the task that reads a text,
    and only counts are shuffled. The driver gets CELLS numbers for each language at most."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(n[at], 0))], ["lang", "cell", "n"])
            held.clear()

        for b in batches:
            for name, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                if name not in held and len(held) >= HELD:
                    yield from told()
                c, n = cells(text.as_py())
                np.add.at(held.setdefault(name, np.zeros(CELLS, np.int64)), c, n)
        yield from told()

    got = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((CELLS, len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    column = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    counts[cell[cell >= 0], column[cell >= 0]] = n[cell >= 0]
    return Model.of(languages, counts)


def identify(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (name=proportion, the largest first) for every row of docs.

    lang_pred has the largest proportion in the document's set, score is that proportion. A text that is null or has no letter is
    `und` with score 0, and so is every text if nothing could be learned. A lang without letters in any text is a language whose
    trigrams are all alike. Repeated rows each give a row. Columns other than doc_id, text and lang are not read; lang only to learn."""
    d = pick(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = d.sparkSession.sparkContext.broadcast(learn(d))

    def make():
        def work(keys, texts):
            m = model.value
            pred, score, named, some, held = [], [], [], [], 0

            def fitted():
                for found in mixtures(m, some, penalty):
                    pred.append(m.languages[found[0][0]] if found else "und")
                    score.append(min(1.0, found[0][1]) if found else 0.0)
                    named.append(",".join(f"{m.languages[i]}={s:.4f}" for i, s in found))
                some.clear()

            for text in texts:
                some.append(cells(text.as_py()))
                held += len(some[-1][0]) * len(m.languages)
                if held > TOGETHER:
                    fitted()
                    held = 0
            fitted()
            return {"doc_id": keys, "held_out": [fold(k) == 0 for k in keys.to_pylist()], "lang_pred": pred, "score": score, "languages": named}

        return work

    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])
    return map_rows(d, ["doc_id", "text"], make, "doc_id long, held_out boolean, lang_pred string, score double, languages string", kinds)
