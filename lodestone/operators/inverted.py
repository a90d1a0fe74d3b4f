"""A stored positional inverted index: postings, documents per term, corpus totals; searched without reading any text.

postings: term, id, dl (terms of the row), tf, positions. They lie in order of term (those of a frequent one are spread over many
files), so a search reads the row groups of its few terms. terms: term, df. totals: n, avgdl. Each is a table that a store keeps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import give_back
from ..functions.text import stems
from ..shipping import ship
from . import match
from .keyword import B, K1, LEAST_IDF, TOP_K, top

#: Positions between the fields of a row, so that no phrase crosses from one into the next.
GAP = 1 << 20
#: Rows whose words are Python objects at a time.
SLICE = 1_000
#: Postings of a term in a row while they are gathered, words that a worker holds, rows that a task sorts on average.
BLOCK, HELD, BLOCKS = 32, 3 << 19, 1 << 18
_PLAIN = re.compile("[a-z0-9]+")


def plain(text: str) -> list[str]:
    """Lower-cased ASCII words, unstemmed."""
    return _PLAIN.findall(text.lower())


#: porter: stemmed words of any script without marks. plain: what SQL can check.
ANALYSERS: dict[str, Callable[[str], list[str]]] = {"porter": stems, "plain": plain}


def gathered(rows: DataFrame, key: str, fields: list[Column], analyser: str = "porter") -> DataFrame:
    """The postings of the texts of rows, those of a term in a batch side by side: term, first (rows that are counted here), ids, sizes
    (their dl, then where the positions of each end), positions. One Arrow pass. What is shuffled and sorted afterwards is a row for
    BLOCK postings at most, not one for each; no more than these, so that ranges with frequent terms are cut finer."""
    ship(rows.sparkSession)

    def blocks(parts: list[tuple]) -> pa.RecordBatch:
        words, ids, dl, count, pos = zip(*parts, strict=True)
        coded, (dl, count, pos) = pa.concat_arrays(words).dictionary_encode(), map(np.concatenate, (dl, count, pos))
        begins = np.zeros(len(pos), np.int32)
        begins[np.cumsum(count) - count] = 1
        order = np.argsort(coded.indices.to_numpy(), kind="stable")  # words come by row and place, and stay so within a term
        codes, row, pos, begins = coded.indices.to_numpy()[order], np.repeat(np.arange(len(dl)), count)[order], pos[order], begins[order]
        new = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))  # postings
        tf, first, codes, row, n = np.add.reduceat(pos >= 0, new, dtype=np.int64), np.add.reduceat(begins, new), codes[new], row[new], len(new)
        nth = np.arange(n) - np.repeat(np.flatnonzero(np.diff(codes, prepend=-1)), np.bincount(codes))
        starts = np.flatnonzero(nth % BLOCK == 0)
        bounds = np.append(starts, n)
        lengths = np.diff(bounds)
        ends = np.concatenate([[0], np.cumsum(tf)])
        at = np.repeat(starts, lengths) + np.arange(n)
        sizes = np.empty(2 * n, np.int32)
        sizes[at], sizes[at + np.repeat(lengths, lengths)] = dl[row], ends[1:] - np.repeat(ends[starts], lengths)
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((bounds, pa.concat_arrays(ids).take(pa.array(row))), (2 * bounds, pa.array(sizes)), (ends[bounds], pa.array(pos[pos >= 0])))]
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[starts])), pa.array(np.add.reduceat(first, starts), pa.int32()), *lists], ["term", "first", "ids", "sizes", "positions"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = ANALYSERS[analyser]
        for b in batches:
            parts, held = [], 0
            for at in range(0, b.num_rows, SLICE):  # a batch's words are Python objects a slice at a time
                part = b.slice(at, SLICE)
                words, sizes, each = [], [], []
                for texts in part.column("texts").to_pylist():
                    before = len(words)
                    for k, text in enumerate(texts):
                        found = cut(text or "")
                        words += found
                        each.append((len(found), k * GAP))
                    sizes.append(len(words) - before)
                    if not sizes[-1]:  # an empty row keeps its length
                        words.append("")
                        each.append((1, -1))
                lens, offs = np.array(each, np.int64).T
                dl = np.array(sizes, np.int32)
                pos = np.arange(len(words)) + np.repeat(offs - (np.cumsum(lens) - lens), lens)
                parts.append((pa.array(words, pa.string()), part.column("id"), dl, np.maximum(dl, 1), pos.astype(np.int32)))
                held += len(words)
                if held >= HELD:
                    yield blocks(parts)
                    parts, held = [], 0
            if parts:
                yield blocks(parts)
            give_back()

    rows = rows.select(F.col(key).alias("id"), F.array(*fields).alias("texts"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(post, f"term string, first int, ids array<{kind}>, sizes array<int>, positions array<int>")


def spread(blocks: DataFrame) -> DataFrame:
    """term, id, dl, tf, positions: a row for each posting of what was gathered, in the order of the blocks."""
    size = lambda i: F.get("sizes", i)
    each = blocks.select("term", "sizes", "positions", F.size("ids").alias("n"), F.posexplode("ids").alias("at", "id"))
    start = F.when(F.col("at") == 0, 0).otherwise(size(F.col("n") + F.col("at") - 1))
    cut = each.select("term", "id", size(F.col("at")).alias("dl"), start.alias("start"), (size(F.col("n") + F.col("at")) - start).alias("tf"), "positions")
    return cut.select("term", "id", "dl", "tf", F.slice("positions", F.col("start") + 1, F.col("tf")).alias("positions"))


def postings(rows: DataFrame, key: str, fields: list[Column], analyser: str = "porter") -> DataFrame:
    """term, id, dl, tf, positions of the texts of rows."""
    return spread(gathered(rows, key, fields, analyser))


def _is_gathered(posted: DataFrame) -> bool:
    return "ids" in posted.columns


def clustered(posted: DataFrame) -> DataFrame:
    """Postings as they are stored, from postings or from what was gathered. posted is read twice, as ranges are found by a sample: it
    should be a table that was written. Gathered ones are sorted before they are spread, BLOCKS at most some times over in a task."""
    if not _is_gathered(posted):
        return posted.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    order = ["term", F.get("ids", 0)]
    return spread(posted.repartitionByRange(posted.count() // BLOCKS + 1, *order).sortWithinPartitions(*order))


def clustered_few(posted: DataFrame) -> DataFrame:
    """The same for few rows, in one task."""
    if not _is_gathered(posted):
        return posted.coalesce(1).sortWithinPartitions("term", "id")
    return spread(posted.coalesce(1).sortWithinPartitions("term", F.get("ids", 0)))


def terms(posted: DataFrame) -> DataFrame:
    """term, df."""
    n = F.sum(F.size("ids").cast("long")) if _is_gathered(posted) else F.count(F.lit(1))
    return posted.filter("term <> ''").groupBy("term").agg(n.alias("df"))


def _rows(posted: DataFrame) -> DataFrame:
    """n, words: rows of the corpus and their words. Each row counts once: where it was gathered, or by the length that its postings carry."""
    if _is_gathered(posted):
        return posted.agg(F.coalesce(F.sum("first"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("words"))
    return posted.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))


def sizes(posted: DataFrame) -> tuple[int, int]:
    """Rows of the corpus and their words."""
    own = _rows(posted).first()
    return own.n, own.words


def change(posted: DataFrame, unposted: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(terms, numbers) of a segment: how rows per term, rows and words change when posted's rows come and unposted's go. Both: staged."""
    came, (n, words) = terms(posted), sizes(posted)
    if unposted is None:
        return came, {"n": n, "words": words}
    went, (n_out, words_out) = terms(unposted), sizes(unposted)
    both = came.unionByName(went.withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    return both, {"n": n - n_out, "words": words - words_out}


def totals(posted: DataFrame) -> DataFrame:
    """n, avgdl: one row."""
    return _rows(posted).select("n", F.when(F.col("n") > 0, F.col("words") / F.col("n")).otherwise(0.0).alias("avgdl"))


def without(posted: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of the rows in gone (id)."""
    return posted.join(gone.select("id").distinct(), "id", "left_anti")


def _phrase_places(spark: SparkSession, posted: DataFrame, asked: list[tuple]) -> DataFrame:
    """query_id, need, phrase, id, dl, tf, df of phrases of several words: the places at which the lists of the words, moved by their offsets, meet."""
    want = F.broadcast(spark.createDataFrame(asked, "query_id string, need int, phrase int, words int, off int, term string"))
    lists = posted.filter(F.col("term").isin(sorted({a[-1] for a in asked}))).join(want, "term")
    moved = lists.select("query_id", "need", "phrase", "words", "id", "dl", F.transform("positions", lambda p: p - F.col("off")).alias("starts"))
    met = moved.groupBy("query_id", "need", "phrase", "words", "id", "dl").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == F.col("words"))
    starts = F.aggregate(F.slice("all", F.lit(2), F.col("words") - 1), F.get("all", 0), F.array_intersect)
    tf = met.select("query_id", "need", "phrase", "id", "dl", F.size(starts).alias("tf")).filter("tf > 0")
    df = tf.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(F.broadcast(df), ["query_id", "phrase"])


def search(spark: SparkSession, posted: DataFrame, vocabulary: DataFrame, total: DataFrame | tuple[int, float], queries: dict[str, str], k: int = 2 * TOP_K, analyser: str = "porter", ids: DataFrame | None = None) -> DataFrame:
    """query_id, id, rank (negative BM25, least is best), pos: the k best rows that match a query. ids: the only rows that count, if given.

    A query is words, all of which must be there, or words joined by AND, OR and NOT; a malformed one matches nothing. How many rows
    hold each of the asked words is looked up first; then the terms reach the scan of the postings as a filter, and what is asked of
    each is part of the plan, so that only the rows' sums are shuffled. A phrase of several words counts as a term of its own. Ranks
    are rounded to 9 places, so that the order of a sum decides no tie. total: n and avgdl."""
    asked: dict[str, tuple[list[list[str]], match.Match]] = {}
    for q, text in queries.items():
        try:
            asked[q] = match.parsed(text, ANALYSERS[analyser])
        except match.Malformed:
            pass
    need = {q: len(ps) if m.plain else 0 for q, (ps, m) in asked.items()}
    terms_ = sorted({p[0] for ps, _ in asked.values() for p in ps if len(p) == 1})
    known = {r.term: r.df for r in vocabulary.filter(F.col("term").isin(terms_)).collect()} if terms_ else {}  # as many as were asked
    words = [(p[0], q, need[q], i) for q, (ps, _) in asked.items() for i, p in enumerate(ps) if len(p) == 1 and p[0] in known]
    longer = [(q, need[q], i, len(p), off, t) for q, (ps, _) in asked.items() for i, p in enumerate(ps) if len(p) > 1 for off, t in enumerate(p)]
    names = ["query_id", "need", "phrase", "id", "dl", "tf", "df"]
    if not words and not longer:
        return spark.createDataFrame([], f"query_id string, id {posted.schema['id'].dataType.simpleString()}, rank double, pos int")
    parts = []
    if words:
        want = lambda w: F.struct(F.lit(w[1]).alias("query_id"), F.lit(w[2]).alias("need"), F.lit(w[3]).alias("phrase"), F.lit(known[w[0]]).cast("long").alias("df"))
        each = [x for t in terms_ if t in known for x in (F.lit(t), F.array(*[want(w) for w in words if w[0] == t]))]
        hits = posted.filter(F.col("term").isin([t for t in terms_ if t in known])).select("id", "dl", "tf", F.explode(F.element_at(F.create_map(*each), F.col("term"))).alias("w"))
        parts.append(hits.select("id", "dl", "tf", "w.*").select(*names))
    if longer:
        parts.append(_phrase_places(spark, posted, longer).select(*names))
    tf = reduce(DataFrame.unionByName, parts)
    if ids is not None:
        tf = tf.join(ids.select("id"), "id", "left_semi")
    # A table of totals is read by subqueries of one value.
    n, avgdl = map(F.lit, total) if isinstance(total, tuple) else (total.select("n").scalar(), total.select("avgdl").scalar())
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    joined = {q: (len(ps), m) for q, (ps, m) in asked.items() if not m.plain and ps}
    each = [F.sum(F.when((F.col("need") == 0) & (F.col("phrase") == i), score)).alias(f"w{i}") for i in range(max((c for c, _ in joined.values()), default=0))]
    found = tf.groupBy("query_id", "need", "id").agg(-F.sum(score), F.count(F.lit(1)).alias("got"), *each).toDF("query_id", "need", "id", "rank", "got", *[f"w{i}" for i in range(len(each))])
    has = lambda i: F.col(f"w{i}").isNotNull()
    holds, rank = F.col("got") == F.col("need"), F.col("rank")
    for q, (_, m) in joined.items():
        mine = F.col("query_id") == q
        holds = F.when(mine, m.holds(has)).otherwise(holds)
        rank = F.when(mine, -sum((F.when(c, F.col(f"w{i}")).otherwise(0.0) for i, c in m.counted(has)), F.lit(0.0))).otherwise(rank)
    return top(found.filter(holds).select("query_id", "id", F.round(rank, 9).alias("rank")), "rank", "id", k)
