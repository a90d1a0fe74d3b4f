"""Cutting files into chunks of at most TOKENS estimated tokens."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..shipping import ship

TOKENS = 512
#: Kinds in order of preference; any other kind comes last.
PRIORITY = {"function": 0, "method": 1, "class": 2, "interface": 3, "struct": 3, "trait": 3, "enum": 4, "module": 5}
_LAST = 99
_FAR = 2**31


def priority(kind: Column) -> Column:
    out = F.lit(_LAST)
    for k, p in PRIORITY.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def choose(symbols: DataFrame) -> DataFrame:
    """file, kept: the symbols (name, type, start_line, end_line, seq) of each file that no preferred symbol overlaps, best first."""
    ship(symbols.sparkSession)

    @F.arrow_udf("array<int>")
    def free(starts, ends):
        import pyarrow as pa

        out = []
        for first, last in zip(starts.to_pylist(), ends.to_pylist(), strict=True):
            kept: list[tuple[int, int]] = []  # in order and apart, so only the last one that starts before an end can overlap
            out.append([])
            for i, (a, b) in enumerate(zip(first, last, strict=True)):
                k = bisect_right(kept, (b, _FAR))
                if not k or kept[k - 1][1] < a:
                    kept.insert(k, (a, b))
                    out[-1].append(i)
        return pa.array(out, pa.list_(pa.int32()))

    s = symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(priority(F.col("type")).alias("p"), "start_line", "seq", "end_line", "name", "type"))).alias("all"))
    return s.select("file", F.transform(free("all.start_line", "all.end_line"), lambda i: F.get("all", i)).alias("kept"))


def pack(lines: Column, base: Column) -> Column:
    """array<struct<s,e>>: line ranges (from base on) that take lines greedily while the text stays within TOKENS; a longer line is a range of its own."""
    most = 4 * TOKENS
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(-1).alias("n"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a, x):
        grown = a["n"] + 1 + F.length(x)
        fits = (a["n"] < 0) | (grown <= most)
        done = F.array_append(a["out"], F.struct((base + a["s"]).cast("int").alias("s"), (base + a["i"] - 1).cast("int").alias("e")))
        return F.struct((a["i"] + 1).alias("i"), F.when(fits, a["s"]).otherwise(a["i"]).alias("s"), F.when(fits & (a["n"] >= 0), grown).otherwise(F.length(x)).alias("n"), F.when(fits, a["out"]).otherwise(done).alias("out"))

    end = lambda a: F.array_append(a["out"], F.struct((base + a["s"]).cast("int").alias("s"), (base + a["i"] - 1).cast("int").alias("e")))
    return F.aggregate(lines, zero, step, end)


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, file, language, symbol, kind, parent, hash, start_line, end_line, content: chunks of the chosen symbols, split where too
    long, and of the lines that no symbol covers (only of files within 2 * TOKENS, if those lines fit in a chunk).

    files: rel_path, language, text; symbols: file, seq, name, type, start_line, end_line."""
    f = files.select(F.col("rel_path").alias("file"), "language", "text", F.split("text", "\n").alias("lines")).join(choose(symbols), "file", "left")
    f = f.withColumn("kept", F.coalesce("kept", F.array().cast(f.schema["kept"].dataType)))
    # Each symbol takes its lines before it becomes a row: a row for each symbol with all lines would grow with the square of a file.
    end = lambda k: F.least(k["end_line"], F.size("lines"))
    part = lambda k: F.when(end(k) < k["start_line"], F.array().cast("array<string>")).otherwise(F.transform(F.sequence(k["start_line"], end(k)), lambda i: F.get("lines", i - 1)))
    each = f.select("file", "language", F.explode(F.transform("kept", lambda k: F.struct(k["name"].alias("symbol"), k["type"].alias("kind"), k["start_line"].alias("first"), k["end_line"].alias("last"), part(k).alias("part")))).alias("k")).select("file", "language", "k.*")
    each = each.withColumn("whole", token_estimate(F.array_join("part", "\n")) <= TOKENS)
    ranges = F.when(F.col("whole"), F.array(F.struct(F.col("first").cast("int").alias("s"), F.col("last").cast("int").alias("e")))).otherwise(pack(F.col("part"), F.col("first")))
    cut = each.withColumn("r", F.explode(ranges)).select(
        "file", "language", "symbol", "kind", F.when(~F.col("whole"), F.format_string("%s:%d-%d", "file", "first", "last")).alias("parent"), F.col("r")["s"].alias("start_line"), F.col("r")["e"].alias("end_line"),
        F.array_join(F.slice("part", F.col("r")["s"] - F.col("first") + 1, F.col("r")["e"] - F.col("r")["s"] + 1), "\n").alias("content"),
    )
    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    rest = f.filter(token_estimate(F.col("text")) <= 2 * TOKENS).select("file", "language", F.size("lines").alias("n"), F.filter(numbered, lambda l: ~F.exists("kept", lambda k: l["i"].between(k["start_line"], k["end_line"]))).alias("free"))
    rest = rest.filter(F.size("free") > 0).withColumn("content", F.array_join(F.transform("free", lambda l: l["x"]), "\n")).filter(token_estimate(F.col("content")) <= TOKENS)
    rest = rest.select("file", "language", F.concat(F.lit("file_"), F.regexp_replace("file", "[^a-zA-Z0-9]", "_")).alias("symbol"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), "content")
    out = cut.unionByName(rest)
    return out.select(F.format_string("%s:%d-%d", "file", "start_line", "end_line").alias("id"), "file", "language", "symbol", "kind", "parent", F.sha2("content", 256).alias("hash"), "start_line", "end_line", "content")


def packed_documents(files: DataFrame) -> DataFrame:
    """rel_path, start_line, end_line, n_chars, hash: every file cut as one oversize symbol."""
    lines = files.select("rel_path", F.split("text", "\n").alias("lines"))
    each = lines.select("rel_path", "lines", F.explode(pack(F.col("lines"), F.lit(1))).alias("r"))
    content = F.array_join(F.slice("lines", F.col("r")["s"], F.col("r")["e"] - F.col("r")["s"] + 1), "\n")
    return each.select("rel_path", F.col("r")["s"].alias("start_line"), F.col("r")["e"].alias("end_line"), F.length(content).alias("n_chars"), F.sha2(content, 256).alias("hash"))
