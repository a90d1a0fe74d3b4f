"""Filter interaction audit: what each filter removes at each place of each order of the filters.

Every document becomes a mask with a bit for each filter that it fails. Masks are counted by part, so that what follows grows with
the parts and masks alone. The cells are unpivoted against the steps of all orders; a running bit-or over a cell's earlier steps tells
what removed it before; conditional sums make the counts of a step, and a window over a filter's steps in all orders its total.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage

_WORD = r"[^ \t-\r]+"
#: A filter: from text and words (an array) to whether the document fails it.
Filter = Callable[[Column, Column], Column]
FILTERS: dict[str, Filter] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that a document fails if its text is that of a smaller doc_id.
REPEATS = "E"


def masks(docs: DataFrame, filters: dict[str, Filter]) -> DataFrame:
    """doc_id, part, digest (of the text), mask: bit i is 1 if the document fails the i-th filter. Texts are read here and nowhere else."""
    text = F.coalesce("text", F.lit(""))
    d = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)))
    bits = [F.when(f(F.col("t"), F.col("w")), 1 << i).otherwise(0) for i, f in enumerate(filters.values())]
    return d.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """part, mask, n, good, toxic of masked (staged). bit: set in the mask of what is no first of its text.

    Copies are counted before anything meets: of a text's rows only sums and the least doc_id are shuffled, so a text of a third of
    all rows is a few rows for each part. Rows without doc_id are no one's copy, have no labels, and do not meet in one task."""
    with_id = masked.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    own = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.max((F.col("quality") == 1).cast("long")).alias("q"), F.max((F.col("toxic") == 1).cast("long")).alias("x"))
    d = with_id.join(own, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", (F.coalesce("q", F.lit(0)) * F.col("n")).alias("good"), (F.coalesce("x", F.lit(0)) * F.col("n")).alias("toxic"))
    counts = ("n", "good", "toxic")
    texts = d.groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("least"), *[F.sum(c).alias(c) for c in counts], *[F.min_by(c, "doc_id").alias(f"{c}_1") for c in counts]
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    stays = texts.select("part", "mask", *counts, *[F.when(first, F.col(f"{c}_1")).otherwise(F.lit(0).cast("long")).alias(f"{c}_1") for c in counts])
    one = lambda m, f: F.struct(m.alias("mask"), *[f(c).alias(c) for c in counts])
    both = F.array(one(F.col("mask"), lambda c: F.col(f"{c}_1")), one(F.col("mask").bitwiseOR(F.lit(bit)), lambda c: F.col(c) - F.col(f"{c}_1")))
    split = stays.select("part", F.explode(both).alias("c")).select("part", "c.*").filter("n > 0")
    without = masked.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return split.unionByName(without).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def steps(cell: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts: cells against every step of every order of the letters."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = cell.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    long = long.withColumn("step", (F.col("at") + 1).cast("int")).withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    long = long.withColumn("gone", F.coalesce(F.bit_or("fails").over(before), F.lit(0)) != 0)
    fails, gone = F.col("fails") != 0, F.col("gone")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0).cast("long"))
    each = long.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return each.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS, repeats: str = REPEATS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part and step.

    The filters are named by one letter each; `repeats` names the one for copies. A null text is an empty one (and a copy of other
    empty texts); a null lang is the part ''. A row without doc_id is never a copy, makes no other row one, and has no labels; of
    repeated rows of a text's least doc_id none is a copy. Of repeated labels of a doc_id the greater counts. Without documents
    there are no rows. Columns other than doc_id, text, lang, quality and toxic are not read, whatever their names."""
    letters = "".join(filters) + repeats
    if len(set(letters)) != len(letters) or len(letters) != len(filters) + 1:
        raise ValueError("filters need different names of one letter")
    masked = stage(masks(docs, filters), "masks")
    return steps(cells(masked, labels, 1 << len(filters)), letters)
