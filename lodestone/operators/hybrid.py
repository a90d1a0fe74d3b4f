"""Keyword and vector hits as one list; reranking; enrichment."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_ONLY = 0.8
_AFTER = 1_000_000


def merge(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """id, score, match_type, order_key: keyword hits in their order, then vector hits that are not among them, at VECTOR_ONLY of their score.

    Both sides: id, score, pos; they are top-k lists."""
    k = keyword.select("id", F.col("score").alias("ks"), F.col("pos").alias("kp"))
    v = vector.select("id", F.col("score").alias("vs"), F.col("pos").alias("vp"))
    m = k.join(v, "id", "full_outer")
    score = F.when(F.col("kp").isNull(), F.col("vs") * VECTOR_ONLY).otherwise(F.greatest("ks", "vs"))
    kind = F.when(F.col("vp").isNull(), "keyword").when(F.col("kp").isNull(), "vector").otherwise("hybrid")
    return m.select("id", score.alias("score"), kind.alias("match_type"), F.coalesce(F.col("kp"), _AFTER + F.col("vp")).alias("order_key"))


def first(merged: DataFrame, n: int) -> DataFrame:
    """Without a reranker: the first n in merge order, each with score 1; the merged score stays beside it."""
    return merged.orderBy("order_key", "id").limit(n).withColumn("merged_score", F.col("score")).withColumn("score", F.lit(1.0))


def overlap(query: str) -> Callable:
    """A reranker's stand-in: the share of the query's terms that a text has."""
    from .keyword import words

    asked = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    return lambda text: F.size(F.array_intersect(words(text), F.array(*map(F.lit, asked)))) / F.lit(float(max(1, len(asked))))


def rerank(candidates: DataFrame, meta: DataFrame, scorer: Callable, n: int) -> DataFrame:
    """Candidates with metadata (id, text, ..), scored anew and cut to the n best; those without metadata go."""
    return candidates.drop("score").join(meta, "id").withColumn("score", scorer(F.col("text"))).orderBy(F.desc("score"), "order_key", "id").limit(n)


def enrich(results: DataFrame, meta: DataFrame) -> DataFrame:
    return results.join(meta, "id")


def clamp(n: int | None) -> int:
    return 10 if n is None else max(1, min(100, int(n)))


def relevance(label: Column, score: Column) -> Column:
    """What a classifier's answer says of relevance: its score if it chose the second label, else the rest to one."""
    return F.when(label == "LABEL_1", score).otherwise(1 - score)


def formatted(results: DataFrame) -> DataFrame:
    """rank, text: each of a search's few results as lines to read; in order of score and id, numbered from 1."""
    r = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    kind = F.when(F.coalesce(F.col("kind"), F.lit("")) != "", F.concat(F.lit(" ("), "kind", F.lit(")"))).otherwise("")
    symbol = F.when(F.coalesce(F.col("symbol"), F.lit("")) != "", F.concat(F.lit("\n    Symbol: "), "symbol", kind)).otherwise("")
    head = F.format_string("[%d] %s:%d-%d\n    Language: %s  |  Type: %s  |  Score: %.3f", "rank", "file", "start_line", "end_line", "language", "match_type", "score")
    return r.select("rank", F.concat(head, symbol, F.lit("\n    " + "\u2500" * 60)).alias("text"))
