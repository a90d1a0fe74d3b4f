"""Quality rules: a threshold table compiled into one Spark projection; no user function runs.

The projection is one expression over the text. What it needs more than once is named inside it (see _let), so that nothing is
evaluated twice, whatever the optimiser does with the projection; as a filter it is evaluated once too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of the four languages of the corpus, for the stop-word ratio.
STOP_WORDS = (
    "the of and to a in is that it for as was with be by on not he his but at are this have from or had an they which you were "
    "der die das und ist nicht mit ein eine von zu den auf für im des dem auch sich "
    "le la les de des et un une du en que qui dans pour par sur est au ce il elle "
    "el los las y que se del una por con su para como es al lo"
).split()
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails if the ratio lies outside low..high; ratios: see RATIOS."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: name: numerator, denominator. A denominator of zero makes the ratio 0.
RATIOS = {
    "words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "stop_words": ("n_stop", "n_words"),
}
#: Production thresholds.
RULES = (
    Rule("words", low=10),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbols_per_word", high=0.3),
    Rule("duplicate_lines", high=0.3),
    Rule("stop_words", low=0.02),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_repeat_words")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _ratio(m: Column, name: str) -> Column:
    over, under = RATIOS[name]
    return m[over].cast("double") if under is None else F.when(m[under] > 0, m[over] / m[under]).otherwise(F.lit(0.0))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures m."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (_ratio(m, r.ratio) >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (_ratio(m, r.ratio) <= F.lit(float(r.high)))
    return out


def _repeats(w: Column, window: int) -> Column:
    """The words of w in windows that occur twice or more. Repeats are found by hash and then confirmed on the words themselves."""
    starts = F.sequence(F.lit(0), F.size(w) - window)
    hashes = lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))
    # The windows in order, those equal to a neighbour, and the words that their union covers.
    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("x"), i.alias("i"))))
    zero = F.struct(F.lit(-window).alias("p"), F.lit(0).alias("n"))

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda a, b: F.get(s, a)["x"] == F.get(s, b)["x"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
        places = F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))
        return F.aggregate(places, zero, lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(window), x - a["p"])).alias("n")), lambda a: a["n"])

    found = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(hashes(h), lambda v: F.when(F.size(v) > F.size(F.array_distinct(v)), _let(ordered, covered)).otherwise(0)))
    return F.when(F.size(w) >= window, found).otherwise(0)


def measures(text: Column, window: int = 5) -> Column:
    """A struct of the COUNTS of a whole text. A null text has no words and no lines."""

    def counts(v: Column) -> Column:
        w, lines = v["w"], v["l"]
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))))
        found = (F.size(w), F.length(F.array_join(w, "")), v["s"], F.size(lines), F.size(lines) - F.size(F.array_distinct(lines)), stop, _repeats(w, window))
        return F.struct(*(c.cast("long").alias(n) for n, c in zip(COUNTS, found, strict=True)))

    def parts(t: Column) -> Column:
        w = F.array_remove(F.split(t, SPACE, -1), "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(w.alias("w"), lines.alias("l"), (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("s"))

    return _let(_let(F.coalesce(text, F.lit("")), parts), counts)


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the COUNTS, base_failed and kept of a whole text: the projection that the threshold table compiles to."""

    def told(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*(m[c].alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))

    return _let(measures(text), told)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of df.

    Null and empty texts have all counts 0 and fail. Repeated rows each give a row; other columns are not read."""
    m = df.select("doc_id", judged(F.col("text"), rules).alias("m"))
    return m.select("doc_id", *(F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass, with their own columns. Null and empty texts go; repeated rows stay or go together."""
    return df.filter(judged(F.col("text"), rules)["kept"])
