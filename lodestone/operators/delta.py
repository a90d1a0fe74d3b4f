"""What changed between two snapshots, and how a stored table follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, old_hash, new_hash, status (added, modified, removed, unchanged): one full outer join on the key."""
    a, b = old.select(key, F.col("hash").alias("old_hash")), new.select(key, F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, "old_hash", "new_hash", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with their keys; of new's rows with the same key the last by content stays."""
    rows = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in new.columns if c != key])
    return old.join(rows, key, "left_anti").unionByName(rows)


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def changed(files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files to parse anew, and the paths whose rows must go (modified or removed). state: rel_path, hash."""
    d = delta(state, files, "rel_path")
    return files.join(d.filter("status in ('added', 'modified')").select("rel_path"), "rel_path", "left_semi"), d.filter("status in ('modified', 'removed')").select("rel_path")
