"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every end of an edge; edges: a, b long.

    Each round is two joins on node ids and is written to the shared folder, so a lost executor costs one round at most.
    Only minima are gathered for a node, never its list of neighbours, and the edges of a hub are joined apart."""

    def down(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, seen = stage(down(edges), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage(down(join_unique(both, least, "a", 32 * mark["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_unique(large, least, "a", 32 * mark["n"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        done, now = now, stage(down(small), "edges")
        unstage(done)
        unstage(large)
