"""Keyword retrieval: an inverted index as tables, BM25 top-k, phrases.

Scoring joins the posting lists with the query's few terms, which are broadcast; sums are partial before they are shuffled by
row id, and the top k needs no full sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms as words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOP_K = 30


def normalise(query: str) -> str:
    return re.sub(r"\s+", " ", query.strip())


def sanitise(query: str) -> str:
    """All but ASCII word characters and spaces become spaces."""
    return re.sub(r"[^A-Za-z0-9_\s]", " ", query)


def phrases(query: str) -> list[list[str]]:
    """The phrases of a query, all of which must occur: words apart are phrases of one, a_b is the phrase a b."""
    found = (re.findall("[a-z0-9]+", t.lower()) for t in sanitise(normalise(query)).split())
    return [list(p) for p in dict.fromkeys(map(tuple, filter(None, found)))]


def postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, pos."""
    return rows.select(key, F.posexplode(words(text)).alias("pos", "term"))


def lengths(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return rows.select(key, F.size(words(text)).alias("dl"))


def frequencies(posted: DataFrame, key: str) -> DataFrame:
    """key, term, tf. Rows are the positions of postings(), counted before the shuffle."""
    return posted.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(rows: DataFrame, text: Column) -> DataFrame:
    """term, n (occurrences), df (rows with the term). A row's words, and its distinct words, are counted before anything is shuffled: only sums are."""
    own = rows.select(words(text).alias("w")).select(F.posexplode(F.array("w", F.array_distinct("w"))).alias("k", "w"))
    each = own.select("k", F.explode("w").alias("term"))
    return each.groupBy("term").agg(F.count_if(F.col("k") == 0).alias("n"), F.count_if(F.col("k") == 1).alias("df"))


def match_all(rows: DataFrame, key: str, text: Column, queries: DataFrame) -> DataFrame:
    """query_id, key: the rows that hold all terms of a query (query_id, term; a few rows, which are broadcast)."""
    need = F.broadcast(queries.groupBy("query_id").agg(F.count_distinct("term").alias("need")))
    own = rows.select(key, F.explode(F.array_distinct(words(text))).alias("term")).join(F.broadcast(queries), "term")
    return own.groupBy("query_id", key).agg(F.count(F.lit(1)).alias("n")).join(need, "query_id").filter("n = need").select("query_id", key)


def bm25(rows: DataFrame, key: str, text: Column, queries: DataFrame, k: int = 2 * TOP_K) -> DataFrame:
    """query_id, key, rank (negative BM25, least is best), pos: the k best rows that hold all terms of a query.

    queries: query_id, term (distinct); a few rows, which are broadcast. Ranks are rounded to 9 places, so that the order of a sum decides no tie."""
    q = F.broadcast(queries)
    tokens = rows.select(key, words(text).alias("w"))
    n_rows, avgdl = tokens.agg(F.count(F.lit(1))).scalar(), tokens.agg(F.avg(F.size("w"))).scalar()  # subqueries of one value
    hit = tokens.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).join(F.broadcast(queries.select("term").distinct()), "term")
    tf = hit.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    stats = df.select("term", avgdl.alias("avgdl"), idf.alias("idf"))
    need = F.broadcast(queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("need")))
    score = tf.join(F.broadcast(stats), "term").join(q, "term").groupBy("query_id", key).agg(F.round(-F.sum(weight), 9).alias("rank"), F.count(F.lit(1)).alias("got")).join(need, "query_id").filter("got = need")
    return top(score.select("query_id", key, "rank"), "rank", key, k)


def top(scored: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows of each query with the least `by`, and their place; Spark keeps k rows a task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(by, key)
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def minmax(hits: DataFrame) -> DataFrame:
    """score: ranks scaled to 0..1 within a query; 1 if they are all the same."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(-F.col("rank")).over(w), F.max(-F.col("rank")).over(w)
    return hits.withColumn("score", F.when(hi == lo, F.lit(1.0)).otherwise((-F.col("rank") - lo) / (hi - lo)))


def match_phrase(posted: DataFrame, key: str, phrase: list[str]) -> DataFrame:
    """key, n: rows with the phrase and how often: positions moved by each word's offset meet at the start."""
    spark = posted.sparkSession
    asked = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(phrase)], "term string, off int"))
    met = posted.join(asked, "term").groupBy(key, (F.col("pos") - F.col("off")).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(phrase))
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def query_terms(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, text in queries.items() for p in phrases(text) for t in dict.fromkeys(p)], "query_id string, term string").distinct()
