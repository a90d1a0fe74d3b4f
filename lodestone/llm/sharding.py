"""Sharding by proportional stratified interleaving, on DataFrame functions alone.

The rows of each source are shuffled by a seeded hash and ranked; rank over the source's size is a row's fractional rank.
All rows in order of fractional rank are a sequence in which every stretch holds the sources in their overall proportions;
it is cut into shards whose sizes differ by one row at most.

No rank is made in a single task: ranks come from a row number inside a hash bucket plus the summed sizes of the buckets
before it, so a source with a third of all rows is spread over all buckets. The number of buckets follows the row count.
Texts are read once to be measured and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should hold, about; and the hex digits of the hash that name buckets at most (65,536 buckets).
BUCKET_ROWS, MOST_DIGITS = 50_000, 4


def _digits(rows: int) -> int:
    digits = 1
    while digits < MOST_DIGITS and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows in earlier buckets. counts holds one row for each bucket, so this window stays small."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return counts.withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])


def interleave(df: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, source, law, shard, slot, grown_shard for every row of df.

    size is the UTF-8 bytes of the text plus 1 (null: 1), the checksum of a null text is 0. A null source is a source of
    its own, rows with a null doc_id are ranked by size and checksum of the text. Rows equal in doc_id and source are told apart by size and checksum; those equal in all may
    exchange places. An empty table gives no rows. grown_shard is null, as the law is `rows`."""
    d = _digits(df.count())
    # Rows without an id are told apart by text, so that they are spread over the buckets too.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.octet_length("text"), F.lit(" "), F.crc32(F.col("text").cast("binary"))), F.lit("null"))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), name))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("source").alias("source"),
        F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col("source"), F.lit(""))).alias("s"),
        hashed.alias("h"),
    ).withColumn("hb", F.substring("h", 1, d))
    of_source = rows.groupBy("s", "hb").agg(F.count(F.lit(1)).alias("n"))
    whole = of_source.groupBy("s").agg(F.sum("n").alias("total"))
    starts = _before(of_source, ["s"], "hb").join(whole, "s").select("s", "hb", "before", "total")
    within = Window.partitionBy("s", "hb").orderBy("h", "doc_id", "b", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(within)).join(starts, ["s", "hb"])
    steps = 16**d
    fr = ranked.withColumn("f", (F.col("before") + F.col("r") - F.lit(0.5)) / F.col("total")).withColumn("fb", F.floor(F.col("f") * steps).cast("int"))
    fr = fr.drop("before", "r", "total", "hb")
    ends = _before(fr.groupBy("fb").agg(F.count(F.lit(1)).alias("n")), [], "fb")
    everything = Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("fb", "before", F.sum("n").over(everything).alias("rows_in_all"))
    w = Window.partitionBy("fb").orderBy("f", "h", "s", "doc_id", "b", "text_crc32")
    placed = fr.withColumn("r", F.row_number().over(w)).join(ends, "fb").withColumn("pos", F.col("before") + F.col("r") - 1)
    placed = placed.withColumn("shard", F.expr(f"int(pos * {shards} div rows_in_all)"))
    start = F.expr(f"(shard * rows_in_all + {shards - 1}) div {shards}")
    return placed.select("doc_id", (F.col("b") + 1).alias("size"), "text_crc32", "source", F.lit("rows").alias("law"), "shard", (F.col("pos") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
