"""Vector retrieval: exact nearest neighbours by squared distance, embeddings without a model file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.text import stems
from ..shipping import ship
from .keyword import top

TOP_K = 30
#: Query vectors scored together, and rows scored with them at once.
BLOCK, SLAB = 64, 2048
TIERS = (("light", 384, 46), ("balanced", 768, 109), ("max", 1024, 1100))


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Unit vectors of hashed stems: the stand-in where no model is at hand. A text without words has the zero vector."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for s in stems(t):
                h = int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: list[float], k: int = TOP_K) -> DataFrame:
    """vec_id, distance, score, the k nearest: one scan that keeps k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.select("vec_id", squared_distance(F.col("embedding"), q).alias("distance"))
    return d.orderBy("distance", "vec_id").limit(k).withColumn("score", 1 / (1 + F.col("distance")))


class _Best:
    """The k nearest rows, so far, of some query vectors: products of matrices bound the distances; those that may be among the k least
    are then computed as squared_distance does."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k, self.lengths = asked, k, (asked**2).sum(-1)
        self.starts = range(0, len(asked), BLOCK)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(self.starts)  # query's place, vec_id, distance
        self.bound = np.full(len(asked), np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        own, k = (rows**2).sum(1), self.k
        for n, at in enumerate(self.starts):
            q, far, length = self.asked[at : at + BLOCK], self.bound[at : at + BLOCK], self.lengths[at : at + BLOCK]
            near = own[:, None] + length - 2 * (rows @ q.T)
            slack = 1e-9 * (own.max() + length)
            least = np.partition(near, k - 1, axis=0)[k - 1] if len(ids) > k else np.inf
            r, c = np.nonzero(near <= np.minimum(least, far) + slack)
            d = ((rows[r] - q[c]) ** 2).sum(1)
            new = (c, ids[r], d)
            place, name, d = new if self.found[n] is None else (np.concatenate(x) for x in zip(self.found[n], new, strict=True))
            order = np.lexsort((name, d, place))
            place, name, d = place[order], name[order], d[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            far[place[rank == k - 1]] = d[rank == k - 1]
            self.found[n] = (place[rank < k], name[rank < k], d[rank < k])

    def batches(self, names: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at, found in zip(self.starts, self.found, strict=True):
            if found:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at + found[0])), pa.array(found[1].tolist(), id_type), pa.array(found[2])], ["query_id", "vec_id", "distance"])


def _slabs(t: pa.RecordBatch | pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in t.to_batches() if isinstance(t, pa.Table) else [t]:
        for x in (b.slice(at, SLAB) for at in range(0, b.num_rows, SLAB)):
            yield np.array(x.column("vec_id").to_pylist()), x.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(x.num_rows, width)


def knn_batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = TOP_K) -> DataFrame:
    """query_id, vec_id, distance, pos for a few stated queries: one Arrow pass over the vectors, in which a task keeps k rows of each query."""
    ship(vectors.sparkSession)
    names, asked = pa.array([i for i, _ in queries], pa.int64()), np.array([v for _, v in queries], np.float64)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, id_type = _Best(asked, k), None
        for b in batches:
            id_type = b.column("vec_id").type
            for ids, rows in _slabs(b, asked.shape[1]):
                best.add(ids, rows)
        yield from best.batches(names, id_type)

    hits = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding").mapInArrow(nearest, f"query_id long, vec_id {kind}, distance double")
    return top(hits, "distance", "vec_id", k)


#: Numbers of a tile's vectors, and of its queries: a task holds some times 16 MB. Candidate lists that meet in one group of a query.
TILE, MEET = 1 << 21, 64


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, vec_id, distance, pos for a set of queries of any size (query_id, embedding) against all vectors (vec_id, embedding).

    Both are dealt to rows and columns of a grid by a hash of their ids, and each tile is one product of matrices that keeps k rows of
    each query; the lists of a query meet in two steps. Rows without a vector ask and answer nothing."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    # New names, so that queries that are rows of the vectors' table are no columns of theirs.
    q = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").alias("asking"), F.col("embedding").alias("asked"))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("d")).first()
    deep = max(1, TILE // max(1, size.d))
    down, over = -(-size.n // deep) or 1, -(-q.count() // deep) or 1
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = v.withColumn("r", at("vec_id", down)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(over - 1)))).groupBy("r", "c")
    asked = q.withColumn("c", at("asking", over)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).groupBy("r", "c")
    made = StructType([StructField("query_id", q.schema["asking"].dataType), StructField("vec_id", v.schema["vec_id"].dataType), StructField("distance", DoubleType()), StructField("part", IntegerType())])
    schema = to_arrow_schema(made)

    def tile(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return schema.empty_table()
        names = some.column("asking").combine_chunks()
        matrix = some.column("asked").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
        best = _Best(matrix, k)
        for ids, block in _slabs(rows, matrix.shape[1]):
            best.add(ids, block)
        found = pa.Table.from_batches(best.batches(names, schema.field("vec_id").type))
        part = rows.column("r")[0].as_py() // MEET
        return found.append_column("part", pa.array(np.full(found.num_rows, part, np.int32)))

    hits = dealt.cogroup(asked).applyInArrow(tile, made)
    if down > MEET:
        own = Window.partitionBy("query_id", "part").orderBy("distance", "vec_id")
        hits = hits.withColumn("pos", F.row_number().over(own)).filter(F.col("pos") <= k).drop("pos")
    return top(hits.drop("part"), "distance", "vec_id", k)
