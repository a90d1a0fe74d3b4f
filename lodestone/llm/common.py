"""What the training-data operators share: inputs, shipping of code, staged tables, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast if it is known to hold at most so many bytes; beyond that Spark joins by shuffle.
BROADCAST_BYTES = 48 << 20
#: join_unique: the bound of its broadcasts; keys with more than one in so many rows are joined apart from the others.
UNIQUE_BYTES, HOT = 8 << 20, 1_000

_shipped: "weakref.WeakSet[SparkContext]" = weakref.WeakSet()
_staged: list[tuple["weakref.ref[SparkSession]", str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, also beside others that differ in case only or repeat a name (the first one counts)."""
    low = [c.lower() for c in df.columns]
    if all(low.count(n.lower()) == 1 for n in names):
        return df.select(*names)
    return df.toDF(*[f"c{i}" for i in range(len(low))]).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a context, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), f"{package}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    _shipped.add(sc)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a new one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _staged.append((weakref.ref(spark), path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing needs any more."""
    path = df._staged_at
    _staged[:] = [x for x in _staged if x[1] != path]
    _delete(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is deleted at the end, but the tables given to the function that this yields, which returns them."""
    before, kept = {path for _, path in _staged}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    try:
        yield keep
    finally:
        for ref, path in list(_staged):
            if ref() is spark and path not in before and path not in kept:
                _staged.remove((ref, path))
                _delete(spark, path)


@atexit.register
def drop_staged() -> None:
    """Delete every staged table of the sessions that still run."""
    for ref, path in _staged:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass
    _staged.clear()


def small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df, to be broadcast if the bytes of its rows, counted here, are within the bound."""
    took = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if took <= BROADCAST_BYTES else df


def join_unique(left: DataFrame, right: DataFrame, key: str, most_bytes: int) -> DataFrame:
    """left with the columns of right, whose keys are unique and which holds most_bytes at most. left: staged.

    Within the bound right is broadcast. Beyond it the two meet by shuffle, but for keys with more than one in HOT of left's rows:
    those are fewer than HOT, their rows of right are broadcast, and so no task gets more than its part of left."""
    if most_bytes <= UNIQUE_BYTES:
        return left.join(F.broadcast(right), key)
    per = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(stage(per.filter(F.col("n") * HOT > left.count()).select(key), "hot"))
    few = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key)
    return few.unionByName(left.join(hot, key, "left_anti").join(right, key))


#: Rows of a batch that are Python objects at a time.
SLICE = 1_000
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no such function in this C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system. Workers are kept from stage to stage, and what texts took of one would lie beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def in_slices(texts: pa.Array, make: Callable[[list], pa.Array]) -> pa.Array:
    """make() of SLICE values at a time, as one array: an Arrow batch of long texts is never a list of Python strings as a whole."""
    parts = [make(texts.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(texts)), SLICE)]
    out = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
    give_back()
    return out


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Run make()(**columns as Arrow arrays) -> dict of columns over df's batches. Only the named columns reach Python;
    a batch is at most some tens of MB, so memory does not grow with the input."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                made = work(*(part.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow], schema=arrow)
            give_back()

    return df.select(*columns).mapInArrow(run, schema)
