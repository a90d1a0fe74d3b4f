"""The file corpus: scanning, size and type gate, ignore rules, languages, content hashes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree

MAX_BYTES = 10 * 1024 * 1024
#: Extensions that are never indexed.
BLOCKED = (
    "exe dll so dylib bin wasm o a lib pyc class jar war png jpg jpeg gif svg ico webp bmp tiff pdf doc docx xls xlsx ppt pptx "
    "zip tar gz bz2 7z rar mp4 avi mov wmv flv mkv mp3 wav flac ogg"
).split()
#: Folders and files that are ignored by default (the last folder is this engine's own).
IGNORED = (
    "node_modules .git dist build coverage .next out vendor bin obj target tmp .cache .turbo .lodestone".split()
    + [f"*.{e}" for e in BLOCKED]
    + "*.min.js *.min.css package-lock.json yarn.lock pnpm-lock.yaml".split()
)
#: Language key, extensions, whole names (in order of registration).
LANGUAGES: list[tuple[str, str, str]] = [
    ("ts", ".ts .tsx .mts .cts", ""), ("js", ".js .jsx .mjs .cjs", ""), ("py", ".py .pyw", ""), ("go", ".go", ""), ("rs", ".rs", ""), ("java", ".java", ""), ("rb", ".rb", ""),
    ("c", ".c .h", ""), ("cpp", ".cpp .cxx .cc .c++ .hpp .hxx .hh", ""), ("csharp", ".cs", ""), ("php", ".php", ""), ("swift", ".swift", ""), ("kotlin", ".kt .kts", ""),
    ("dart", ".dart", ""), ("scala", ".scala .sc", ""), ("haskell", ".hs .lhs", ""), ("solidity", ".sol", ""), ("lua", ".lua", ""), ("html", ".html .htm", ""),
    ("css", ".css .scss .less", ""), ("json", ".json", ""), ("yaml", ".yaml .yml", ""), ("toml", ".toml", ""), ("sql", ".sql", ""), ("markdown", ".md .markdown", ""), ("xml", ".xml", ""),
    ("vue", ".vue", ""), ("svelte", ".svelte", ""), ("terraform", ".tf .tfvars", ""), ("dockerfile", "", "dockerfile dockerfile.dev dockerfile.prod"),
    ("salesforce", ".cls .trigger .page .component .cmp .app .evt .intf .design .auradoc -meta.xml", ""), ("csv", ".csv", ""), ("json-variants", ".jsonc .json5", ""),
    ("config", ".ini .properties .env .conf .cfg", ".gitignore .editorconfig"), ("documentation", ".rst .adoc", ""), ("svg", ".svg", ""), ("text", ".txt .log", ""), ("astro", ".astro", ""),
]


def listing(spark: SparkSession, root: str, ignore: list[str] | None = None, keep: Callable[[Column], Column] | None = None, only: list[str] | None = None) -> DataFrame:
    """rel_path, size, mtime, error of the indexable files below root, none of which is opened; an error is what could not be listed.

    keep: a further condition on rel_path. only: a few paths below root; nothing else is listed, and those that are no files give no
    row. On a file system that Arrow does not open, Spark's own listing stands in, which leaves out names that start with . or _."""
    if tree.opened(root) is None:
        found = _by_spark(spark, root, ignore).select("rel_path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(None).cast("string").alias("error"))
        found = found if only is None else found.filter(F.col("rel_path").isin(only))
    else:
        found = tree.listing(spark, root, _rules(ignore)) if only is None else tree.listed(spark, root, only).filter(~pruned(F.col("rel_path"), ignore))
    rel = F.col("rel_path")
    return found.filter(F.col("error").isNotNull() | indexable(rel, F.col("size")) & (keep(rel) if keep else F.lit(True)))


def read(spark: SparkSession, root: str, listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """files: rel_path, language, hash, size, mtime, malformed, text, error of listed files; read and hashed on the executors.

    Bytes that are not UTF-8 become U+FFFD, which malformed tells. What cannot be read has an error and no text."""
    if tree.opened(root) is None:
        bytes_ = F.col("content").cast("string")
        raw = _by_spark(spark, root, None).select("rel_path", (~F.is_valid_utf8(bytes_)).alias("malformed"), F.make_valid_utf8(bytes_).alias("text"))
        got = listed.join(raw, "rel_path", "left").withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("unreadable"))))
    else:
        got = tree.read(listed, root, tasks)
    return got.select("rel_path", language(F.col("rel_path")).alias("language"), F.sha2("text", 256).alias("hash"), "size", "mtime", "malformed", "text", "error")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, keep: Callable[[Column], Column] | None = None, only: list[str] | None = None) -> DataFrame:
    """read() of all that listing() finds, without what has an error."""
    found = listing(spark, root, ignore, keep, only)
    return read(spark, root, found, None if only is None else max(1, min(len(only), 8))).filter("error IS NULL").drop("error")


def _by_spark(spark: SparkSession, root: str, ignore: list[str] | None) -> DataFrame:
    """The columns of Spark's binary files and rel_path. The rules are a condition on what the listing knows, so ignored files get no task."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    rel = lambda p: F.substr(p, F.lit(len(top) + 2))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(top)
    return raw.filter(~pruned(rel(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))), ignore)).withColumn("rel_path", rel(F.col("path")))


def from_documents(docs: DataFrame) -> DataFrame:
    """The documents table as a file corpus: rel_path, language, hash, size, text."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("rel_path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), "text")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def indexable(path: Column, size: Column) -> Column:
    return size.between(1, MAX_BYTES) & ~extension(path).isin(*BLOCKED)


def generated(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.rlike(r"\.generated\.ts$|\.g\.ts$|\.min\.(js|css)$") | name.isin("tsconfig.json", "package.json")


def glob_regex(glob: str) -> str:
    """The regular expression of an ignore glob: ** any path, * and ? within a folder. A folder glob (dir/) means what is below it."""
    glob = glob + "**" if glob.endswith("/") else glob
    return re.sub(r"\*\*/?|\*|\?|\.", lambda m: {"*": "[^/]*", "?": "[^/]", ".": r"\."}.get(m[0], ".*"), glob)


def _rules(user: list[str] | None) -> list[tuple[str, bool, bool]]:
    """(pattern, whether it is tried on the path alone, whether a match takes the path back) in order; the default rules are two patterns."""
    plain = "(^|/)(" + "|".join(re.escape(r) for r in IGNORED if "*" not in r) + ")(/|$)"
    out = [(f"(?i){plain}", True, False), ("(?i)^(" + "|".join(glob_regex(r) for r in IGNORED if "*" in r) + ")$", False, False)]
    for line in user or []:
        rule = line.strip()
        if rule and not rule.startswith("#"):
            out.append((f"(?i)^{glob_regex(rule.lstrip('!'))}$", False, rule.startswith("!")))
    return out


def ignored(path: Column, user: list[str] | None = None) -> Column:
    """Whether the last matching rule ignores the path. Rules are tried on the whole path, on its name and, for plain names, on
    each folder; lines that start with # are comments, ! takes back. The default and user rules fold into one expression."""
    out = F.lit(False)
    name = F.substring_index(path, "/", -1)
    for pattern, whole, back in _rules(user):
        out = F.when(path.rlike(pattern) if whole else path.rlike(pattern) | name.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def pruned(path: Column, user: list[str] | None = None) -> Column:
    """Whether the path, or a folder on the way to it, is ignored: what is below an ignored folder is never met, so no rule takes it back."""
    parts = F.split(path, "/")
    way = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.exists(way, lambda p: ignored(p, user))


def language(path: Column) -> Column:
    """Whole names first (a Dockerfile may have an ending that is no language's), then the longest extension, else generic."""
    lower = F.lower(path)
    name = F.substring_index(lower, "/", -1)
    out = F.when(name == "dockerfile", "dockerfile")
    for key, _, names in LANGUAGES:
        if names:
            out = out.when(name.isin(*names.split()), key)
    for ext, key in sorted(((e, k) for k, exts, _ in LANGUAGES for e in exts.split()), key=lambda p: -len(p[0])):
        out = out.when(lower.endswith(ext), key)
    return out.when(name.startswith("dockerfile."), "dockerfile").otherwise("generic")


def registry(spark: SparkSession) -> DataFrame:
    """key, extensions, names, tier of every language."""
    tier = lambda i: 1 if i < 18 else 2
    return spark.createDataFrame([(k, e.split(), n.split(), tier(i)) for i, (k, e, n) in enumerate(LANGUAGES)], "key string, extensions array<string>, names array<string>, tier int")


def extensions(keys: list[str]) -> list[str]:
    """The extensions of some languages, in order; a key that is not there has none."""
    return [e for k, exts, _ in LANGUAGES if k in keys for e in exts.split()]


def inside(root: str, path: str) -> bool:
    """Whether path, with links resolved, is root or below it."""
    root, path = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return path == root or path.startswith(root.rstrip("/") + "/")
