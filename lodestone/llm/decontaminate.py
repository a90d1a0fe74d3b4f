"""Benchmark decontamination by a positional inverted index, on DataFrame functions alone.

1. The benchmark's windows (phrases) are cut and kept once each, with the items that hold them; their terms get numbers.
2. The corpus is read once: the posting lists (term, document, position) of all these terms are stored, and each document's length.
3. The lists' lengths say how rare the terms are; a window with an absent term goes. The lists of a window's two rarest terms,
   moved by the terms' offsets in the window, are intersected: what lies SLOP apart at most is a possible start.
4. The starts that are left are intersected with the lists of all the window's terms. A start that meets all of them in place is
   an occurrence of the phrase; one that meets all of them within SLOP words is a proximity match.

Lists meet by document, window and stretch of positions, so a frequent term or passage is spread over all tasks. Texts are never
shuffled. Where the terms are too many to be broadcast, the list of each term is dealt to SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passing, small, stage

WINDOW, SLOP = 10, 2
#: Positions in a stretch; parts of a term's list where lists are shuffled by term.
STRETCH, SALTS = 64, 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased; other letters keep their case. Null: none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(plain, SEPARATORS, -1), "")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """wid, terms, items: the distinct windows; an item of fewer words, but not none, is one window."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = b.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id())


def _by_key(many: DataFrame, few: DataFrame, key: str, row_bytes: Column | int, how: str = "inner") -> DataFrame:
    """many joined with few by key. few is broadcast if its bytes, counted here, are within the bound; else each key's rows of many are dealt to SALTS tasks."""
    hint = small(few, row_bytes)
    if hint is not few:
        return many.join(hint, key, how)
    salted = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"], how).drop("__salt")


def _key() -> list[Column]:
    """d, h: by these, rows equal in doc_id and text are the same; never null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h")]


def build(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: tid, k, pos for each posting of terms (term, tid); and for each row of docs one without tid: k, pos (its number of words), doc_id, d, h."""
    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), *_key(), "text")  # numbered before words become rows
    each = rows.select("k", "doc_id", "d", "h", F.posexplode(F.array_append(words(F.col("text")), F.lit(None).cast("string"))).alias("pos", "term"))
    met = _by_key(each, terms, "term", F.octet_length("term") + 40, "left").filter(F.col("term").isNull() | F.col("tid").isNotNull())
    whole = lambda c: F.when(F.col("term").isNull(), F.col(c)).alias(c)
    return met.select("tid", "k", "pos", whole("doc_id"), whole("d"), whole("h"))


def rarest(windows: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """wid, ranked: array of (n, off, tid) of the windows all of whose terms occur, rarest first, the first of equally rare ones first."""
    each = _by_key(windows.select("wid", F.posexplode("terms").alias("off", "term")), terms, "term", F.octet_length("term") + 40)
    each = _by_key(each.select("wid", "off", "tid"), counts, "tid", 40, "left")
    per = each.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "tid"))).alias("ranked"))
    return per.filter(F.col("ranked")[0]["n"] > 0)


def _stretches(at: Column) -> Column:
    """The stretches of all positions within SLOP of at."""
    return F.array_distinct(F.array(F.floor((at - SLOP) / STRETCH), F.floor((at + SLOP) / STRETCH)))


def starts(index: DataFrame, anchors: DataFrame, rank: int) -> DataFrame:
    """k, wid, start: the list of each window's term of rank `rank`, moved by the term's offset. A start may lie before the text: in a proximity match the first words may come later."""
    a = anchors.filter(F.size("ranked") > rank).select("wid", F.col("ranked")[rank]["tid"].alias("tid"), F.col("ranked")[rank]["off"].alias("off"))
    return _by_key(index, a, "tid", 60).select("k", "wid", (F.col("pos") - F.col("off")).alias("start"))


def matches(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """k, wid, start, len, exact: where all terms of a window occur in place (exact) or within SLOP words of it, seen from the rarest.

    index, windows and terms: staged."""
    posted = index.filter(F.col("tid").isNotNull()).select("tid", "k", "pos")
    anchors = stage(rarest(windows, terms, posted.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))), "anchors")
    first = starts(posted, anchors, 0)
    lone = first.join(small(anchors.filter(F.size("ranked") == 1).select("wid"), 40), "wid", "left_semi")
    second = starts(posted, anchors, 1).select("k", "wid", F.col("start").alias("other"), F.floor(F.col("start") / STRETCH).alias("b"))
    spread = first.withColumn("b", F.explode(_stretches(F.col("start"))))
    both = spread.join(second, ["k", "wid", "b"]).filter(F.abs(F.col("start") - F.col("other")) <= SLOP).select("k", "wid", "start").distinct()
    left = stage(both.unionByName(lone), "starts")
    held = small(left.select("k").distinct(), 40)
    lists = posted.join(held, "k", "left_semi").withColumn("b", F.floor(F.col("pos") / STRETCH))
    asked = left.join(small(anchors.select("wid", F.col("ranked").alias("all")), 600), "wid").select("k", "wid", "start", F.size("all").alias("len"), F.explode("all").alias("t"))
    asked = asked.select("k", "wid", "start", "len", F.col("t.tid").alias("tid"), F.col("t.off").alias("off"), (F.col("start") + F.col("t.off")).alias("place")).withColumn("b", F.explode(_stretches(F.col("place"))))
    met = asked.join(lists, ["k", "tid", "b"]).filter(F.abs(F.col("pos") - F.col("place")) <= SLOP)
    per = met.groupBy("k", "wid", "start", "len", "off").agg(F.max(F.col("pos") == F.col("place")).alias("here"))
    return per.groupBy("k", "wid", "start", "len").agg(F.count(F.lit(1)).alias("n"), F.bool_and("here").alias("exact")).filter("n = len").drop("n")


def _index(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The staged index, windows and terms."""
    windows = stage(windows_of(benchmark, window), "windows")
    terms = stage(windows.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return stage(build(docs, terms), "index"), windows, terms


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items_sha256 for every row of docs.

    The last two are as n_items and items_sha256, of proximity matches (phrases are among them). Null and empty texts have no words and are
    not contaminated; their digest is that of no bytes. An item with a null item_id marks words as hit but is not listed; items with
    the same item_id count once. Repeated rows each give a row; other columns are not read."""
    index, windows, terms = _index(docs, benchmark, window)
    met = _by_key(matches(index, windows, terms), windows.select("wid", "items"), "wid", F.octet_length(F.array_join("items", ",")) + 100)
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    per = met.groupBy("k").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.struct("start", "len")))).alias("spans"), ids(F.when(F.col("exact"), F.col("items"))).alias("ids"), ids("items").alias("near"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    hit = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])
    listed = lambda c, n: [F.size(c).cast("long").alias(n), F.array_join(c, ",").alias(f"{n}_listed")]
    per = per.select("k", hit.cast("long").alias("n_hit"), *listed("ids", "n_items"), *listed("near", "n_near_items"))
    out = index.filter(F.col("tid").isNull()).select("k", "doc_id", F.col("pos").cast("long").alias("n_words")).join(per, "k", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    digest = lambda c: F.sha2(F.coalesce(F.col(f"{c}_listed"), F.lit("")), 256)
    return out.select("doc_id", "n_words", count("n_hit"), count("n_items"), digest("n_items").alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), count("n_near_items"), digest("n_near_items").alias("near_items_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold an occurrence of a benchmark window (a phrase; proximity alone is not enough).

    Null and empty texts stay, repeated rows stay or go together, columns keep their names."""
    with passing(docs.sparkSession) as keep:
        index, windows, terms = _index(docs, benchmark, window)
        hit = matches(index, windows, terms).filter("exact").select("k").distinct()
        bad = keep(stage(index.filter(F.col("tid").isNull()).select("k", "d", "h").join(hit, "k", "left_semi").select("d", "h").distinct(), "contaminated"))
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_key())
    return packed.join(small(bad, 60), ["d", "h"], "left_anti").select(*[F.col("row")[c].alias(c) for c in names])
