"""Vector code compression: a codebook for each part of the vectors, learned by Yinyang Lloyd rounds over integers.

The entries of a codebook are clustered into a few groups. Of every part of a vector a round keeps its entry and, for each group,
a lower bound of the distances to the group's other entries. When the entries have moved, each bound falls by the farthest move in
its group, and only groups whose bound is not above the distance to the part's own entry are scanned. Bounds are floating point
and rounded down, so they can only cause a scan that was not needed; what is compared and summed are integers, so that ties are
real and every run, however its rows are dealt, gives the same codes.

Vectors lie in blocks, one row for some thousands of them, with their integers, codes and bounds. A round is one pass over the
blocks, written to the shared folder, which also holds each block's sums by entry: only those are read to move the entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, pick, ship, stage, unstage

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 8, 16, 6, 4, 4096
#: Vectors of a block at most.
BLOCK = 4_096
#: Integers beyond this would not let the squares be added in 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, place]; group[part, entry]; drift[part, group]: how far an entry of the group moved at most."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @classmethod
    def start(cls, entries: np.ndarray, groups: int = GROUPS) -> "Codebooks":
        return cls(entries, np.stack([_grouped(c, groups) for c in entries]), np.zeros((len(entries), groups)))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> "Codebooks":
        """Each entry at the floor of its parts' mean; unused ones stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        far = np.sqrt(((new - self.entries) ** 2).sum(-1).astype(float)) * (1 + 1e-9)
        drift = np.stack([[far[p][self.group[p] == g].max(initial=0.0) for g in range(self.drift.shape[1])] for p in range(len(far))])
        return Codebooks(new, self.group, drift)


def _grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: a few rounds of Lloyd over the entries themselves. No result depends on it."""
    seeds = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(float)
    for _ in range(5):
        own = ((entries[:, None] - seeds) ** 2).sum(-1).argmin(1)
        seeds = np.stack([entries[own == g].mean(0) if (own == g).any() else seeds[g] for g in range(groups)])
    return own


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in integers."""
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)


def _down(bound: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not above."""
    low = bound.astype(np.float32)
    return np.where(low > bound, np.nextafter(low, np.float32(-np.inf)), low).astype(np.float32)


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each row, its squared distance, bounds by group, rows of groups scanned). codes and bounds are those of the round
    before, None at first. Of equally near entries the lowest counts."""
    n, groups = len(x), len(drift)
    if codes is None:
        code, best = np.zeros(n, np.int64), ((x - entries[0]) ** 2).sum(1)
        lower = np.full((n, groups), -np.inf)
    else:
        code, best = codes.astype(np.int64), ((x - entries[codes]) ** 2).sum(1)
        lower = bounds.astype(float) - drift
    own, before = best.copy(), code.copy()
    open_ = lower <= (np.sqrt(own.astype(float)) * (1 + 1e-9) + 1e-6)[:, None]
    seen = []
    for g in range(groups):
        rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if len(rows) and len(members):
            d = _squares(x[rows], entries[members])
            k = d.argmin(1)
            least, name = d[np.arange(len(rows)), k], members[k]
            nearer = (least < best[rows]) | ((least == best[rows]) & (name < code[rows]))
            best[rows[nearer]], code[rows[nearer]] = least[nearer], name[nearer]
            seen.append((g, rows, members, d))
    # An entry that a row left without a scan of its group may be the nearest of that group.
    left = np.flatnonzero((code != before) & ~open_[np.arange(n), group[before]])
    lower[left, group[before[left]]] = np.minimum(lower[left, group[before[left]]], np.sqrt(own[left].astype(float)) * (1 - 1e-9))
    for g in set(range(groups)) - {s[0] for s in seen}:
        if not (group == g).any():
            lower[:, g] = np.inf
    for g, rows, members, d in seen:
        others = np.where(members == code[rows][:, None], np.inf, d)
        lower[rows, g] = np.sqrt(others.min(1)) * (1 - 1e-9)
    return code, best, _down(lower), sum(d.size for *_, d in seen)


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    one = (code[:, None] == np.arange(entries)).astype(np.int64)
    return one.T @ x, one.sum(0)


def _rounded(ids: pa.Array, labels: pa.Array, x: np.ndarray, small: np.dtype, books: Codebooks, codes: np.ndarray | None, bounds: np.ndarray | None) -> tuple[list, np.ndarray, np.ndarray]:
    """(a block's columns after a round, codes, squared distances), parts as rows of both."""
    parts, entries, width = books.entries.shape
    got = [assign(x[:, p * width : (p + 1) * width], books.entries[p], books.group[p], books.drift[p], None if codes is None else codes[p], None if bounds is None else bounds[p]) for p in range(parts)]
    code, far = np.stack([g[0] for g in got]), np.stack([g[1] for g in got])
    totals = [_sums(x[:, p * width : (p + 1) * width], code[p], entries) for p in range(parts)]
    sums = np.concatenate([np.concatenate([s.ravel() for s, _ in totals]), np.concatenate([c for _, c in totals])])
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = [listed(ids), listed(labels), pa.array([x.astype(small).tobytes()]), pa.array([code.astype(np.uint8).tobytes()]), pa.array([np.stack([g[2] for g in got]).tobytes()]), listed(pa.array(sums)), pa.array([sum(g[3] for g in got)], pa.int64())]
    return columns, code, far


_COLUMNS = ["ids", "labels", "x", "codes", "bounds", "sums", "scanned"]


def blocks(vectors: DataFrame, books: Codebooks, small: np.dtype) -> DataFrame:
    """The first round: vec_id, label, embedding -> blocks."""
    ship(vectors.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(flat * SCALE).astype(np.int64).reshape(b.num_rows, books.entries.shape[0] * books.entries.shape[2])
            yield pa.RecordBatch.from_arrays(_rounded(b.column("vec_id"), b.column("label"), x, small, books, None, None)[0], _COLUMNS)

    return vectors.mapInArrow(run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, x binary, codes binary, bounds binary, sums array<long>, scanned long")


def _opened(b: pa.RecordBatch, i: int, books: Codebooks, small: np.dtype) -> tuple:
    parts, _, width = books.entries.shape
    ids = b.column("ids").slice(i, 1).flatten()
    x = np.frombuffer(b.column("x")[i].as_py(), small).astype(np.int64).reshape(len(ids), parts * width)
    codes = np.frombuffer(b.column("codes")[i].as_py(), np.uint8).reshape(parts, len(ids))
    bounds = np.frombuffer(b.column("bounds")[i].as_py(), np.float32).reshape(parts, len(ids), -1)
    return ids, b.column("labels").slice(i, 1).flatten(), x, codes, bounds


def next_round(state: DataFrame, books: Codebooks, small: np.dtype) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, x, codes, bounds = _opened(b, i, books, small)
                yield pa.RecordBatch.from_arrays(_rounded(ids, labels, x, small, books, codes, bounds)[0], _COLUMNS)

    return state.mapInArrow(run, state.schema)


def coded(state: DataFrame, books: Codebooks, small: np.dtype) -> DataFrame:
    """vec_id, label, code, error of every vector of the blocks, by the entries as they are now."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in state.schema if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, x, codes, bounds = _opened(b, i, books, small)
                _, code, far = _rounded(ids, labels, x, small, books, codes, bounds)
                text = [r.tobytes().hex() for r in np.ascontiguousarray(code.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(far.sum(0))], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def _totals(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by part and entry: as many numbers as the codebooks have, whatever the rows."""
    parts, entries, width = books.entries.shape
    got = state.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for r in got:
        flat[r.at] = r.v
    cut = parts * entries * width
    return flat[:cut].reshape(parts, entries, width), flat[cut:].reshape(parts, entries)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector is there and has neither null nor non-finite components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return pick(vectors, "vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & sound)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, np.dtype] | None:
    """(blocks after the last round, staged; codebooks; type of the blocks' integers) of kept vectors; None if there are none."""
    shape = vectors.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("largest")).first()
    if shape.low is None:
        return None
    if shape.low != shape.high or shape.low % parts:
        raise ValueError(f"vectors have {shape.low} to {shape.high} components; all need the same number, a multiple of {parts}")
    largest = (shape.largest or 0) * SCALE + 1
    if largest > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} are too large for sums of squares in 64 bits")
    small = np.dtype(np.int16 if largest < 1 << 15 else np.int32)
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # the first entries
    first = np.floor(np.array([r.embedding for r in least], np.float64) * SCALE).astype(np.int64)
    books = Codebooks.start(np.ascontiguousarray(first.reshape(len(least), parts, shape.low // parts).transpose(1, 0, 2)))
    state = stage(blocks(vectors, books, small), "blocks")
    books = books.moved(*_totals(state, books))
    for _ in range(rounds - 1):
        after = stage(next_round(state, books, small), "blocks")
        unstage(state)
        state, books = after, books.moved(*_totals(after, books))
    return state, books, small


def digest(books: Codebooks) -> str:
    """SHA-256 of the entries' components in order of part, entry and place."""
    import hashlib

    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept.

    Null vectors and those with null or non-finite components are dropped. A null vec_id is kept and comes last among the first
    entries; rows with the same vec_id are ordered by their vectors and each give a row. With fewer vectors than entries the
    codebooks are smaller; without any there are no rows. Vectors without components all have the first codes and no error. Null labels are one label. Vectors of different lengths, or of one that is
    no multiple of the parts, and components beyond 16,383 are refused with a ValueError. Other columns are not read."""
    good = kept(vectors)
    trained = train(good, parts, entries, rounds)
    spark = vectors.sparkSession
    if trained is None:
        kind = good.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    state, books, small = trained
    named = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = stage(coded(state, books, small).withColumn("label", named), "codes")
    unstage(state)
    per = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    size = per.agg(F.coalesce(F.sum(F.octet_length("label") + 16), F.lit(0)).alias("n")).first()["n"]
    return join_unique(rows, per, "label", size).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
