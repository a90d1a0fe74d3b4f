"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through vantage-point trees, grouped by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import vptree
from .common import in_slices, join_unique, passing, ship, small, stage
from .components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: The trees are fitted on so many fingerprints (the least by hash): SAMPLE_EACH for a leaf, within these bounds. Results do not depend on them.
SAMPLE_EACH, SAMPLE_LEAST, SAMPLE_MOST = 8, 32_768, 1 << 20
#: Homes that a leaf should have at most. Beyond some SAMPLE_MOST / SAMPLE_EACH * LEAF fingerprints leaves grow; they are dealt out in tiles.
LEAF = 8_000
#: Homes, and fingerprints to compare them with, that a task gets, about.
LEAF_MOST, OTHERS_MOST = 64_000, 500_000
#: Shingles whose bits are spread out at a time (a multiple of 255), so that a very long text takes little memory.
SLAB = 255 * 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned integer; a text without words has 0."""
    w = (text or "").encode().lower().split()  # bytes: lower() knows A-Z only, split() the six ASCII spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), SLAB):
        bits = np.unpackbits(h[at : at + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        # Eight counters in each 64-bit word: at most 255 rows are added before they are read out.
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda part: pa.array(np.array([fingerprint(t) for t in part], np.uint64).view(np.int64)))


def trees(fingerprints: DataFrame, n: int, radius: int = RADIUS) -> list:
    """A tree for each half, fitted on a bounded sample of the n fingerprints."""
    take = max(SAMPLE_LEAST, min(SAMPLE_MOST, SAMPLE_EACH * n // LEAF)) if n > LEAF else 0
    sample = fingerprints.orderBy(F.xxhash64("fp"), "fp").limit(take).toArrow().column("fp").to_numpy() if take else np.zeros(0, np.int64)
    return [vptree.fit(np.ascontiguousarray(sample).view(np.uint64), n, LEAF, radius, half) for half in vptree.HALVES]


def links(fingerprints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b, compared: pairs of the n distinct fingerprints (column fp) whose components are those of all pairs within radius;
    rows without a pair hold the comparisons of a task.

    In each tree fingerprints are routed to their home leaf and, as guests, to leaves over whose border they may have partners. A
    leaf is dealt out in tiles: a part of its homes against a part of all its fingerprints, so that no task's rows grow with the input."""
    spark = fingerprints.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees(fingerprints, n, radius))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = np.ascontiguousarray(fp[at : at + 20_000])
                for k, (tree, half) in enumerate(zip(shared.value, vptree.HALVES, strict=True)):
                    leaf, i, home = vptree.route(tree, part.view(np.uint64), radius, half)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf * len(vptree.HALVES) + k, pa.int32()), pa.array(part[i], pa.int64()), pa.array(home, pa.bool_())], ["leaf", "fp", "home"])

    routed = stage(fingerprints.select("fp").mapInArrow(spread, "leaf int, fp long, home boolean"), "routed")
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count_if("home") / LEAF_MOST).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / OTHERS_MOST).cast("int").alias("cols")).filter("rows > 0")
    # At most 2 * SAMPLE_MOST / 8 leaves, since a node with fewer than 8 points of the sample is not split: this table's size is bounded.
    dealt = routed.join(F.broadcast(sizes), "leaf").withColumn("r", F.pmod(F.xxhash64("fp"), F.col("rows")).cast("int")).withColumn("c", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cols")).cast("int"))
    # A home is in every tile of its row of tiles, as a home; any fingerprint is in every other tile of its column.
    across = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.struct(F.col("r").alias("r"), c.alias("c"), F.lit(True).alias("home")))
    along = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("c").alias("c"), F.lit(False).alias("home")))
    tiles = F.when(F.col("home"), F.concat(across, F.filter(along, lambda x: x["r"] != F.col("r")))).otherwise(along)
    dealt = dealt.select("leaf", "fp", F.explode(tiles).alias("tile")).select("leaf", "tile.r", "tile.c", "fp", "tile.home")

    def join(t: pa.Table) -> pa.Table:
        fp = np.ascontiguousarray(t.column("fp").to_numpy())
        a, b, compared = vptree.leaf_links(fp.view(np.uint64), t.column("home").to_numpy(), radius, vptree.HALVES[t.column("leaf")[0].as_py() % len(vptree.HALVES)])
        return pa.table({"a": pa.array([*fp[a], None], pa.int64()), "b": pa.array([*fp[b], None], pa.int64()), "compared": pa.array([None] * len(a) + [compared], pa.int64())})

    return dealt.groupBy("leaf", "r", "c").applyInArrow(join, "a long, b long, compared long")


def _grouped(rows: DataFrame, rank: str) -> tuple[DataFrame, int]:
    """fp, first: for each fingerprint the least `rank` of its component; and a bound of this table's bytes. rows: staged, with fp."""
    spark = rows.sparkSession
    nodes = stage(rows.groupBy("fp").agg(F.min(rank).alias("first")), "nodes")
    n = nodes.count()
    with passing(spark) as keep:
        roots = components(links(nodes, n).filter(F.col("a").isNotNull()).select("a", "b"))
        known = keep(stage(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots"))
    firsts = known.groupBy("root").agg(F.min("first").alias("first"))
    return join_unique(known.select("fp", "root"), firsts, "root", 48 * n).select("fp", "first"), 48 * n


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id names no component: component_id
    is the least doc_id that is not null, or null if the component has none. Repeated rows each give a row; other columns are not read."""
    ship(docs.sparkSession)
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of("text").alias("fp")), "fingerprints")
    grouped, size = _grouped(rows, "doc_id")
    out = join_unique(rows, grouped, "fp", size)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: that with the least doc_id (null last, any one of rows with the same).

    Texts are not shuffled unless more rows go than may be broadcast. Null and empty texts are one component."""
    ship(docs.sparkSession)
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = stage(docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("id"), fingerprint_of("text").alias("fp"), F.monotonically_increasing_id().alias("rid")), "rows")
    thin = rows.select("fp", "rid", F.struct(F.col("id").isNull().alias("none"), "id", "rid").alias("rank"))
    grouped, size = _grouped(thin, "rank")
    gone = stage(join_unique(thin, grouped, "fp", size).filter(F.col("rid") != F.col("first")["rid"]).select("rid"), "gone")
    return rows.join(small(gone, 16), "rid", "left_anti").select(*[F.col("row")[c].alias(c) for c in names])
