"""The queries of the engine's own operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import chunking, delta, graph, hybrid, inverted, keyword, stats, vector
from ..sources import adapters, files
from ..sources.segments import Segments
from ..sources.store import Store, shared_folder
from ..streaming import changes
from .fixtures import SNIPPETS, SYMBOLS, TEXTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return files.from_documents(t(spark, d, "documents"))


FILES = "(SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS rel_path, lang AS language, sha256(text) AS hash, strlen(text)::BIGINT AS size, text FROM documents)"

# Sources ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT rel_path, language, size FROM {FILES} WHERE size BETWEEN 1 AND 10485760")
def scan_inventory(spark, d):
    c = corpus(spark, d)
    return c.filter(files.indexable(F.col("rel_path"), F.col("size"))).select("rel_path", "language", "size")


@query(f"SELECT language, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS bytes FROM {FILES} GROUP BY 1")
def stats_by_language(spark, d):
    return stats.by_language(corpus(spark, d))


@query(f"SELECT rel_path, hash FROM {FILES}")
def content_hash(spark, d):
    return corpus(spark, d).select("rel_path", "hash")


_URL_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"SELECT page_id, {_URL_PATH} AS path, regexp_matches('/' || {_URL_PATH} || '/', '(?i)/(dist|build|out|bin|tmp|target|vendor|en)/') AS ignored FROM pages")
def ignore_rules(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t(spark, d, "pages").select("page_id", path.alias("path")).withColumn("ignored", files.ignored(F.col("path"), ["**/en/**"]))


_EXT = "(CASE page_id % 6 WHEN 0 THEN 'a.ts' WHEN 1 THEN 'b.tar.py' WHEN 2 THEN 'Dockerfile.dev' WHEN 3 THEN 'x-meta.xml' WHEN 4 THEN '.gitignore' ELSE CASE page_id % 4 WHEN 1 THEN 'Dockerfile-guide.md' ELSE 'z.xyz' END END)"


@query(f"SELECT page_id, {_EXT} AS path, CASE page_id % 6 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' WHEN 2 THEN 'dockerfile' WHEN 3 THEN 'salesforce' WHEN 4 THEN 'config' ELSE CASE page_id % 4 WHEN 1 THEN 'markdown' ELSE 'generic' END END AS language FROM pages")
def lang_resolve(spark, d):
    return t(spark, d, "pages").select("page_id", F.expr(_EXT).alias("path")).withColumn("language", files.language(F.col("path")))


@query("SELECT doc_id, ceil(length(text) / 4)::INTEGER AS tokens FROM documents")
def token_estimates(spark, d):
    return t(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


# Chunks ----------------------------------------------------------------------------------------------------------------

PACK = f"""
WITH RECURSIVE f AS (SELECT rel_path, string_split(text, chr(10)) AS l FROM {FILES}),
r AS (
  SELECT rel_path, l, 1 AS s, 1 AS e, length(l[1]) AS n, false AS cut FROM f
  UNION ALL
  SELECT rel_path, l, CASE WHEN n + 1 + length(l[e + 1]) <= 2048 THEN s ELSE e + 1 END, e + 1,
         CASE WHEN n + 1 + length(l[e + 1]) <= 2048 THEN n + 1 + length(l[e + 1]) ELSE length(l[e + 1]) END,
         n + 1 + length(l[e + 1]) > 2048
  FROM r WHERE e < len(l))
SELECT rel_path, s::INTEGER AS start_line, max(e)::INTEGER AS end_line, max(n)::INTEGER AS n_chars,
       sha256(array_to_string(list_slice(any_value(l), s, max(e)), chr(10))) AS hash
FROM r GROUP BY rel_path, s
"""


@query(PACK)
def chunk_pack(spark, d):
    return chunking.packed_documents(corpus(spark, d))


def packed_chunks(spark, d) -> DataFrame:
    """Chunks of the documents: each file as one oversize symbol."""
    p = chunking.packed_documents(corpus(spark, d))
    return p.select(F.format_string("%s:%d-%d", "rel_path", "start_line", "end_line").alias("id"), F.col("rel_path").alias("file"), F.split("rel_path", "/")[1].alias("language"), F.lit("").alias("symbol"), F.lit(None).cast("string").alias("kind"), "hash", "start_line", "end_line")


CHUNKS = f"(SELECT rel_path || ':' || start_line || '-' || end_line AS id, rel_path AS file, string_split(rel_path, '/')[2] AS language, hash, start_line, end_line FROM ({PACK}))"


@query("""SELECT * FROM (VALUES ('a.ts:12-14', 'f'), ('a.ts:3-5', 'm'), ('a.ts:1-14', 'file_a_ts'), ('b.ts:2-3', 'g'), ('b.ts:1-4', 'file_b_ts'),
('c.ts:7-7', 'big'), ('c.ts:8-8', 'big'), ('c.ts:9-9', 'big')) v(id, symbol)""")
def chunk_files(spark, d):
    s = spark.createDataFrame(SYMBOLS, "file string, seq int, name string, type string, start_line int, end_line int")
    f = spark.createDataFrame(TEXTS, "rel_path string, text string").withColumn("language", F.lit("ts"))
    return chunking.chunks(f, s).select("id", "symbol")


# Deltas ----------------------------------------------------------------------------------------------------------------

_OLD = f"(SELECT rel_path, CASE WHEN doc_id % 7 = 1 THEN sha256(text || 'x') ELSE hash END AS hash FROM {FILES} WHERE doc_id % 7 <> 0)"
_NEW = f"(SELECT rel_path, hash FROM {FILES} WHERE doc_id % 7 <> 2)"
_DELTA = f"""SELECT rel_path, o.hash AS old_hash, n.hash AS new_hash,
CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM {_OLD} o FULL JOIN {_NEW} n USING (rel_path)"""


def snapshots(spark, d):
    """Two states of the corpus: in the first some files are missing and some differ, in the second others are missing."""
    c = corpus(spark, d)
    old = c.filter("doc_id % 7 <> 0").select("rel_path", F.when(F.col("doc_id") % 7 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"))
    return old, c.filter("doc_id % 7 <> 2").select("rel_path", "hash")


@query(_DELTA)
def file_delta(spark, d):
    return delta.delta(*snapshots(spark, d), "rel_path")


_OLD_CHUNKS = f"(SELECT id, CASE WHEN start_line % 7 = 1 AND end_line % 2 = 0 THEN sha256(hash) ELSE hash END AS hash FROM {CHUNKS} WHERE end_line % 5 <> 0)"
_NEW_CHUNKS = f"(SELECT id, hash FROM {CHUNKS} WHERE end_line % 11 <> 2)"


@query(f"""SELECT id, o.hash AS old_hash, n.hash AS new_hash,
CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM {_OLD_CHUNKS} o FULL JOIN {_NEW_CHUNKS} n USING (id)""")
def chunk_delta(spark, d):
    """Two states of the chunks: in the first some are missing and some differ, in the second others are missing."""
    c = packed_chunks(spark, d)
    other = (F.col("start_line") % 7 == 1) & (F.col("end_line") % 2 == 0)
    old = c.filter("end_line % 5 <> 0").select("id", F.when(other, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return delta.delta(old, c.filter("end_line % 11 <> 2").select("id", "hash"), "id")


@query(f"SELECT rel_path, coalesce(n.hash, o.hash) AS hash FROM {_OLD} o FULL JOIN {_NEW} n USING (rel_path)")
def upsert_merge(spark, d):
    old, new = snapshots(spark, d)
    return delta.upsert(old, new, "rel_path")


@query(f"SELECT rel_path, hash FROM {_OLD} o WHERE rel_path NOT IN (SELECT rel_path FROM ({_DELTA}) WHERE status IN ('modified', 'removed'))")
def delete_removed(spark, d):
    old, new = snapshots(spark, d)
    return delta.delete(old, delta.changed(new, old)[1], "rel_path")


# Keyword search --------------------------------------------------------------------------------------------------------

ASKED = {"q1": "the and", "q2": "of that the", "q3": "idiot", "q4": "der die"}
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_TOK = f"tok AS (SELECT doc_id, {_W} AS w FROM documents)"


@query(f"WITH {_TOK}, p AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM p GROUP BY term")
def kw_terms(spark, d):
    return keyword.vocabulary(t(spark, d, "documents"), F.col("text"))


@query(f"WITH {_TOK} SELECT doc_id, len(w)::INTEGER AS dl FROM tok")
def kw_doclen(spark, d):
    return keyword.lengths(t(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"WITH {_TOK}, p AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT doc_id, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL")
def kw_postings(spark, d):
    return keyword.frequencies(keyword.postings(t(spark, d, "documents"), "doc_id", F.col("text")), "doc_id")


def _bm25_sql(asked: dict[str, str], k: int, tail: str = "SELECT query_id, doc_id, round(rank, 6) AS rank, pos::INTEGER AS pos FROM hits") -> str:
    values = ", ".join(f"('{q}', '{w}')" for q, text in asked.items() for w in dict.fromkeys(text.split()))
    return f"""
WITH {_TOK}, tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
q(query_id, term) AS (VALUES {values}),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, tot GROUP BY term),
s AS (SELECT query_id, doc_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS rank, count(*) AS got
      FROM tf JOIN df USING (term) JOIN q USING (term), tot GROUP BY ALL),
hits AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS pos FROM s
         JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY 1) USING (query_id) WHERE got = need QUALIFY pos <= {k})
{tail}"""


_built: dict[tuple, Store] = {}


def _state(spark, path: str) -> tuple:
    """Names, lengths and times of the files of a table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def stored(spark, d, analyser: str = "plain") -> Store:
    """The stored index of the documents, built once for a session, as long as their files are the same, and written to the shared folder."""
    key = (spark.sparkContext.applicationId, d, analyser, _state(spark, f"{d}/documents.parquet"))
    if key not in _built or not _built[key].has("totals"):
        store = Store(spark, shared_folder(spark, "index"))
        with store.written(inverted.gathered(t(spark, d, "documents"), "doc_id", [F.col("text")], analyser)) as posted:
            store.write(postings=inverted.clustered(posted), terms=inverted.terms(posted), totals=inverted.totals(posted))
        _built[key] = store
    return _built[key]


def _hits(spark, d, asked: dict[str, str], k: int, analyser: str = "plain") -> DataFrame:
    store = stored(spark, d, analyser)
    if not hasattr(store, "known_totals"):  # of a version, which does not change
        store.known_totals = tuple(store.read("totals").select("n", "avgdl").first())
    found = inverted.search(spark, store.read("postings"), store.read("terms"), store.known_totals, asked, k, analyser)
    return found.select("query_id", F.col("id").alias("doc_id"), "rank", "pos")


@query(_bm25_sql({"q": "of that the"}, 60))
def kw_bm25_topk(spark, d):
    return _hits(spark, d, {"q": "of that the"}, 60).withColumn("rank", F.round("rank", 6))


@query(_bm25_sql(ASKED, 60))
def kw_bm25_scan(spark, d):
    """Without an index: the texts are read."""
    return keyword.bm25(t(spark, d, "documents"), "doc_id", F.col("text"), keyword.query_terms(spark, ASKED), 60).withColumn("rank", F.round("rank", 6))


_MINMAX = "SELECT query_id, doc_id, round(CASE WHEN max(-rank) OVER w = min(-rank) OVER w THEN 1.0 ELSE (-rank - min(-rank) OVER w) / (max(-rank) OVER w - min(-rank) OVER w) END, 6) AS score FROM hits WINDOW w AS (PARTITION BY query_id)"


@query(_bm25_sql(ASKED, 60, _MINMAX))
def kw_minmax(spark, d):
    return keyword.minmax(_hits(spark, d, ASKED, 60)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_TOK} SELECT doc_id FROM tok WHERE list_contains(w, 'of') AND list_contains(w, 'idiot')")
def kw_match_and(spark, d):
    return keyword.match_all(t(spark, d, "documents"), "doc_id", F.col("text"), keyword.query_terms(spark, {"q": "of idiot"})).select("doc_id")


@query(f"WITH {_TOK}, p AS (SELECT doc_id, unnest(w) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM tok) SELECT doc_id, count(*)::BIGINT AS n FROM p WHERE a = 'of' AND b = 'the' GROUP BY doc_id")
def kw_phrase(spark, d):
    return keyword.match_phrase(keyword.postings(t(spark, d, "documents"), "doc_id", F.col("text")), "doc_id", ["of", "the"])


@query(_bm25_sql(ASKED, 60))
def kw_bm25_batch(spark, d):
    """From the stored index: the postings of the asked terms alone are read."""
    return _hits(spark, d, ASKED, 60).withColumn("rank", F.round("rank", 6))


@query(f"""WITH {_TOK}, tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM tok),
tf AS (SELECT doc_id, dl, count(*) AS tf FROM p WHERE a = 'of' AND b = 'the' GROUP BY ALL),
i AS (SELECT greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, tot)
SELECT 'q' AS query_id, doc_id, round(round(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9), 6) AS rank,
       row_number() OVER (ORDER BY round(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9), doc_id)::INTEGER AS pos
FROM tf, i, tot QUALIFY pos <= 60""")
def kw_indexed_phrase(spark, d):
    """of_the is a phrase: its places are those at which both lists meet."""
    return _hits(spark, d, {"q": "of_the"}, 60).withColumn("rank", F.round("rank", 6))


@query(f"WITH {_TOK}, p AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM p GROUP BY term")
def kw_indexed_terms(spark, d):
    return stored(spark, d).read("terms").select("term", "df")


@query(_bm25_sql(ASKED, 60))
def kw_segments(spark, d):
    """An index in segments: a base in which some documents have other texts and some copies are too many, a delta that replaces the
    texts, one that takes the copies out, and a merge. Then it is searched; the documents as they are now are what SQL reads."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    changed, doubled = F.col("doc_id") % 7 == 1, F.col("doc_id") % 13 == 5
    copies = docs.filter(doubled).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    older = docs.filter(changed).select("doc_id", F.concat(F.lit("of the old "), "text").alias("text"))
    store = Store(spark, shared_folder(spark, "segments"))
    segments = Segments(store, {"postings": "id"}, {"terms": ("term", "df")}, {"postings": inverted.clustered})

    def change(came: DataFrame | None, went: DataFrame | None) -> None:
        with ExitStack() as passing:
            staged = lambda rows: passing.enter_context(store.written(inverted.gathered(rows, "doc_id", [F.col("text")], "plain")))
            posted = staged(docs.limit(0) if came is None else came)
            gone = None if went is None else staged(went)
            terms, numbers = inverted.change(posted, gone)
            segments.append({"postings": posted, "terms": terms}, {} if went is None else {"postings": went.select(F.col("doc_id").alias("id"))}, numbers)

    change(docs.filter(~changed | F.col("doc_id").isNull()).unionByName(older).unionByName(copies), None)
    change(docs.filter(changed), older)
    change(None, copies)
    segments.compact(2)
    n, words = segments.number("n"), segments.number("words")
    found = inverted.search(spark, store.read("postings"), store.read("terms"), (n, words / max(1, n)), ASKED, 60, "plain")
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"), "pos")


JOINED = {"b1": "idiot OR der NOT the", "b2": "of the AND and NOT that", "b3": "AND of", "b4": "para OR les NOT der die"}
_HAS = ", ".join(f"max(w) FILTER (term = '{x}') AS w_{x}" for x in "idiot der the of and that para les die".split())


@query(f"""WITH {_TOK}, tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, tot GROUP BY term),
x AS (SELECT doc_id, {_HAS} FROM (SELECT doc_id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term), tot) GROUP BY doc_id),
s AS (
  SELECT 'b1' AS query_id, doc_id, coalesce(w_idiot, 0) + CASE WHEN w_the IS NULL THEN coalesce(w_der, 0) ELSE 0 END AS w FROM x WHERE w_idiot IS NOT NULL OR w_der IS NOT NULL AND w_the IS NULL
  UNION ALL SELECT 'b2', doc_id, w_of + w_the + w_and FROM x WHERE w_of + w_the + w_and IS NOT NULL AND w_that IS NULL
  UNION ALL SELECT 'b4', doc_id, coalesce(w_para, 0) + CASE WHEN w_der + w_die IS NULL THEN coalesce(w_les, 0) ELSE 0 END FROM x WHERE w_para IS NOT NULL OR w_les IS NOT NULL AND w_der + w_die IS NULL)
SELECT query_id, doc_id, round(round(-w, 9), 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(-w, 9), doc_id)::INTEGER AS pos FROM s QUALIFY pos <= 60""")
def kw_boolean(spark, d):
    """Words joined by AND, OR and NOT, and a malformed query, which matches nothing."""
    return _hits(spark, d, JOINED, 60).withColumn("rank", F.round("rank", 6))


# Vectors and hybrid ----------------------------------------------------------------------------------------------------


def _vector(spark, d, ids: list[int]) -> list[tuple[int, list[float]]]:
    rows = t(spark, d, "embeddings").filter(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()  # the stated queries
    return [(r.vec_id, list(r.embedding)) for r in sorted(rows)]


_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance, round(1 / (1 + {_DIST}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, vec_id LIMIT 30")
def vec_knn(spark, d):
    [(_, q)] = _vector(spark, d, [0])
    return vector.knn(t(spark, d, "embeddings"), q).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) <= 30")
def vec_knn_batch(spark, d):
    """Every fiftieth vector against all: the set of queries grows with the table, so both are dealt to tiles."""
    e = t(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn_join(e, asked).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def _merged(spark, d) -> DataFrame:
    """Hits of one query over the documents (keyword) and over the vectors of the same numbers."""
    kw = keyword.minmax(_hits(spark, d, {"q": "of that the"}, 60)).select(F.col("doc_id").alias("id"), "score", "pos")
    [(_, q)] = _vector(spark, d, [0])
    vec = vector.knn_batch(t(spark, d, "embeddings"), [(0, q)]).select(F.col("vec_id").alias("id"), (1 / (1 + F.col("distance"))).alias("score"), "pos")
    return hybrid.merge(kw, vec)


_MERGED = _bm25_sql({"q": "of that the"}, 60, f"""
, kw AS (SELECT doc_id AS id, pos, CASE WHEN max(-rank) OVER () = min(-rank) OVER () THEN 1.0 ELSE (-rank - min(-rank) OVER ()) / (max(-rank) OVER () - min(-rank) OVER ()) END AS score FROM hits),
vec AS (SELECT e.vec_id AS id, 1 / (1 + {_DIST}) AS score, row_number() OVER (ORDER BY {_DIST}, e.vec_id) AS pos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY pos <= 30),
m AS (SELECT id, CASE WHEN kw.pos IS NULL THEN vec.score * 0.8 ELSE greatest(kw.score, vec.score) END AS score,
      CASE WHEN vec.pos IS NULL THEN 'keyword' WHEN kw.pos IS NULL THEN 'vector' ELSE 'hybrid' END AS match_type,
      coalesce(kw.pos, 1000000 + vec.pos)::INTEGER AS order_key FROM kw FULL JOIN vec USING (id))
""")


@query(_MERGED + "SELECT id, round(score, 6) AS score, match_type, order_key FROM m")
def hybrid_merge(spark, d):
    return _merged(spark, d).withColumn("score", F.round("score", 6))


@query(_MERGED + "SELECT id, 1.0::DOUBLE AS score, round(score, 6) AS merged_score, match_type, order_key FROM m ORDER BY order_key LIMIT 10")
def hybrid_topk(spark, d):
    return hybrid.first(_merged(spark, d), 10).withColumn("merged_score", F.round("merged_score", 6))


_LANG = _bm25_sql({"q": "of the"}, 60).replace("FROM documents)", "FROM documents WHERE lang = 'en')")


@query(_LANG)
def hybrid_filters(spark, d):
    """A language filter, applied before the top k: it reaches the scan."""
    rows = t(spark, d, "documents").filter("lang = 'en'")
    return keyword.bm25(rows, "doc_id", F.col("text"), keyword.query_terms(spark, {"q": "of the"})).withColumn("rank", F.round("rank", 6))


@query(_MERGED + f", r AS (SELECT id, len(list_intersect(list_distinct({_W}), ['idiot', 'of', 'the'])) / 3.0::DOUBLE AS score, order_key FROM m JOIN documents ON doc_id = id) SELECT id, round(score, 6) AS score, order_key FROM r ORDER BY score DESC, order_key, id LIMIT 10")
def hybrid_rerank(spark, d):
    meta = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return hybrid.rerank(_merged(spark, d), meta, hybrid.overlap("the of idiot"), 10).select("id", F.round("score", 6).alias("score"), "order_key")


@query(_MERGED + ", f AS (SELECT * FROM m ORDER BY order_key LIMIT 10) SELECT id, match_type, lang, source FROM f JOIN documents ON doc_id = id")
def hybrid_enrich(spark, d):
    meta = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return hybrid.enrich(hybrid.first(_merged(spark, d), 10), meta).select("id", "match_type", "lang", "source")


@query(_MERGED + """, f AS (SELECT id, round(score, 3) AS score, match_type, lang, source FROM m JOIN documents ON doc_id = id ORDER BY order_key LIMIT 10),
n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM f)
SELECT r::INTEGER AS rank, printf('[%d] %s:1-%d', r, source, id) || chr(10) || '    Language: ' || lang || '  |  Type: ' || match_type || '  |  Score: ' || printf('%.3f', score)
       || CASE WHEN id % 2 = 0 THEN chr(10) || '    Symbol: doc (function)' ELSE '' END || chr(10) || '    ' || repeat('─', 60) AS text FROM n""")
def hybrid_format(spark, d):
    meta = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("file"), F.when(F.col("doc_id") % 2 == 0, "doc").alias("symbol"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.col("doc_id").cast("int").alias("end_line"))
    first = hybrid.enrich(hybrid.first(_merged(spark, d), 10).drop("score").withColumnRenamed("merged_score", "score"), meta)
    return hybrid.formatted(first.withColumn("score", F.round("score", 3)))


@query("SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN (vec_id % 100) / 100.0 ELSE 1 - (vec_id % 100) / 100.0 END, 6)::DOUBLE AS score FROM embeddings")
def label_flip(spark, d):
    e = t(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 3 == 0, "LABEL_1").otherwise("LABEL_0")
    return e.select("vec_id", F.round(hybrid.relevance(label, (F.col("vec_id") % 100) / 100.0), 6).cast("double").alias("score"))


# Graph -----------------------------------------------------------------------------------------------------------------


def _symbols(f: DataFrame, name: str = "doc") -> DataFrame:
    """One symbol for each file."""
    return f.select(F.col("rel_path").alias("file"), "language", F.concat(F.lit(name), "doc_id").alias("symbol"), F.lit("struct").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    f = corpus(spark, d)
    c = _symbols(f)
    return graph.nodes(f, c), graph.edges(f, c)


_GRAPH = f"""
f AS (SELECT *, len(string_split(text, chr(10)))::INTEGER AS n FROM {FILES}),
fold AS (SELECT DISTINCT unnest([string_split(rel_path, '/')[1], string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2]]) AS p FROM f),
nodes AS (
  SELECT 'kg:workspace' AS id, 'workspace' AS label, 'workspace' AS type, NULL AS language, NULL AS file, 0 AS start_line, 0 AS end_line
  UNION ALL SELECT 'kg:folder:' || p, string_split(p, '/')[-1], 'folder', NULL, p, 0, 0 FROM fold
  UNION ALL SELECT 'kg:file:' || rel_path, string_split(rel_path, '/')[-1], 'file', language, rel_path, 0, 0 FROM f
  UNION ALL SELECT 'kg:sym:' || rel_path || ':doc' || doc_id, 'doc' || doc_id, 'class', language, rel_path, 1, n FROM f),
e AS (
  SELECT CASE WHEN contains(p, '/') THEN 'kg:folder:' || string_split(p, '/')[1] ELSE 'kg:workspace' END AS source, 'kg:folder:' || p AS target, 'contains' AS type FROM fold
  UNION ALL SELECT 'kg:folder:' || regexp_replace(rel_path, '/[^/]*$', ''), 'kg:file:' || rel_path, 'contains' FROM f
  UNION ALL SELECT 'kg:file:' || rel_path, 'kg:sym:' || rel_path || ':doc' || doc_id, 'defines' FROM f),
edges AS (SELECT source || '|' || type || '|' || target AS id, source, target, type FROM e)
"""


def _g(tail: str) -> str:
    return f"WITH {_GRAPH} {tail}"


@query(_g("SELECT * FROM nodes"))
def graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query(_g("SELECT * FROM edges"))
def graph_edges(spark, d):
    return _graph(spark, d)[1]


@query(_g("SELECT id, type FROM nodes UNION ALL SELECT id, type FROM edges"))
def graph_update(spark, d):
    """A graph in which some files are missing and some have other symbols, after these files were indexed anew."""
    f = corpus(spark, d)
    fresh, known = f.filter("doc_id % 5 = 0"), f.filter("doc_id % 10 <> 0")
    c = _symbols(known.filter("doc_id % 5 <> 0")).unionByName(_symbols(known.filter("doc_id % 5 = 0"), "old"))
    n, e = graph.updated(graph.nodes(known, c), graph.edges(known, c), fresh, _symbols(fresh))
    return n.select("id", "type").unionByName(e.select("id", "type"))


@query(_g("SELECT p AS path FROM fold"))
def graph_folders(spark, d):
    return graph.folders(corpus(spark, d))


@query(_g("SELECT n.id, edges.id AS edge_id FROM edges JOIN nodes n ON n.id = CASE WHEN source = 'kg:folder:src0' THEN target ELSE source END WHERE source = 'kg:folder:src0' OR target = 'kg:folder:src0'"))
def graph_neighbors(spark, d):
    return graph.neighbors(*_graph(spark, d), "kg:folder:src0").select("id", "edge_id")


@query(_g("SELECT n.* FROM nodes n JOIN edges e ON n.id = e.target WHERE e.source = 'kg:folder:src0/en' AND e.type = 'contains'"))
def graph_children(spark, d):
    return graph.children(*_graph(spark, d), "kg:folder:src0/en")


@query(_g("SELECT n.id, n.label, n.type, count(e.id)::BIGINT AS degree FROM (SELECT * FROM nodes WHERE label ILIKE '%doc_1%' OR file ILIKE '%doc_1%' OR id ILIKE '%doc_1%' ORDER BY id LIMIT 30) n LEFT JOIN edges e ON n.id IN (e.source, e.target) GROUP BY ALL"))
def graph_search(spark, d):
    return graph.search_with_degree(*_graph(spark, d), "doc_1").select("id", "label", "type", "degree")


@query(_g("SELECT * FROM nodes ORDER BY id OFFSET 20 LIMIT 25"))
def graph_page(spark, d):
    return graph.page(_graph(spark, d)[0], 20, 25)


@query(_g("SELECT type, count(*)::BIGINT AS n FROM nodes GROUP BY type"))
def graph_stats(spark, d):
    return graph.stats(_graph(spark, d)[0])


@query(_g("SELECT id, count(*)::BIGINT AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE target <> source) GROUP BY id"))
def graph_degree(spark, d):
    return graph.degrees(_graph(spark, d)[1])


@query(_g(", p AS (SELECT id FROM nodes WHERE type <> 'class') SELECT id FROM edges WHERE source IN (FROM p) AND target IN (FROM p)"))
def graph_dangling(spark, d):
    n, e = _graph(spark, d)
    return graph.attached(n.filter("type <> 'class'"), e).select("id")


@query(_g("SELECT e.type AS edge_type, count(*)::BIGINT AS n, array_to_string(list_slice(list(n.label ORDER BY n.label, n.id), 1, 5), ', ') AS labels FROM edges e JOIN nodes n ON n.id = CASE WHEN source = 'kg:folder:src1' THEN target ELSE source END WHERE 'kg:folder:src1' IN (source, target) GROUP BY 1"))
def graph_connected(spark, d):
    return graph.connected(*_graph(spark, d), "kg:folder:src1")


@query(_g("SELECT 'kg:folder:src2' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM nodes WHERE type = 'folder' AND file LIKE 'src2/%' UNION ALL SELECT id, 2 FROM nodes WHERE type = 'file' AND file LIKE 'src2/%'"))
def graph_subtree(spark, d):
    return graph.subtree(_graph(spark, d)[1], "kg:folder:src2")


@query(_g("SELECT * FROM nodes WHERE id IN ('kg:workspace', 'kg:folder:src0', 'kg:folder:src1/en', 'kg:none')"))
def graph_lookup(spark, d):
    return graph.lookup(_graph(spark, d)[0], ["kg:workspace", "kg:folder:src0", "kg:folder:src1/en", "kg:none"])


@query(_g(", one AS (SELECT min(file) AS f FROM nodes WHERE type = 'file') SELECT * FROM nodes, one WHERE file = f AND type = 'file'").replace("SELECT * FROM nodes, one", "SELECT nodes.* FROM nodes, one"))
def graph_find(spark, d):
    n = _graph(spark, d)[0]
    return graph.find(n, n.filter("type = 'file'").agg(F.min("file").alias("f")).first().f)


@query(f"SELECT 'kg:sym:' || rel_path || ':top|contains|kg:sym:' || rel_path || ':part' || i AS id, 'kg:sym:' || rel_path || ':top' AS source, 'kg:sym:' || rel_path || ':part' || i AS target, 'contains' AS type FROM {FILES}, range(3) r(i)")
def graph_nested(spark, d):
    """Each file has a symbol and three below it; the parent of a fourth is in no file."""
    f = corpus(spark, d).select(F.col("rel_path").alias("file"))
    part = lambda i: F.struct(F.lit(f"part{i}").alias("symbol"), F.lit("top").alias("parent"))
    of = F.array(F.struct(F.lit("top").alias("symbol"), F.lit(None).cast("string").alias("parent")), *map(part, range(3)), F.struct(F.lit("lost").alias("symbol"), F.lit("1-9").alias("parent")))
    return graph.nested(f.select("file", F.explode(of).alias("c")).select("file", "c.symbol", "c.parent"))


@query("SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages")
def path_normalise(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t(spark, d, "pages").select("page_id", graph.normalised(F.concat(F.lit("./a/../"), path)).alias("path"))


# Every page is a file whose name is the first word that it links to, with an ending by its number; its links are what it imports, as
# statements of three forms: beside one of a package, with an ending that is another's, and over several lines. Each fifth is exported.
_WORD = """regexp_extract(html, 'href="/([A-Za-z]+)"', 1)"""
_MODULE = f"concat('w/', CASE WHEN {_WORD} = '' THEN concat('page', page_id) ELSE {_WORD} END, CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '/index.js' ELSE '.tsx' END)"
_MODULES = f"""h AS (SELECT {_MODULE} AS file, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
u AS (SELECT file, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS i FROM h),
texts AS (
  SELECT file, 'imports' AS type, CASE i % 3 WHEN 0 THEN 'import a from ''a''; import ''.' || h || '''' WHEN 1 THEN 'const x = require(''fs''), y = require(''.' || h || '.js'')' ELSE 'import {{' || chr(10) || '  a,' || chr(10) || '}} from ''.' || h || '''' END AS text FROM u
  UNION ALL SELECT file, 'exports', 'export {{ a }} from ".' || h || '"' FROM u WHERE i % 5 = 0),
lines AS (SELECT file, type, unnest(string_split(text, chr(10))) AS line FROM texts),
raws AS (
  SELECT file, type, coalesce(nullif(regexp_extract(line, 'from\\s+[''"](\\.[^''"]*)[''"]', 1), ''), nullif(regexp_extract(line, 'require\\s*\\(\\s*[''"](\\.[^''"]*)[''"]\\s*\\)', 1), ''), nullif(regexp_extract(line, 'import\\s+[''"](\\.[^''"]*)[''"]', 1), '')) AS raw
  FROM lines),
found AS (SELECT * FROM raws WHERE raw IS NOT NULL),
full_ AS (SELECT DISTINCT file, type, raw, array_to_string(list_filter(string_split(regexp_replace(file, '/[^/]*$', '') || '/' || raw, '/'), lambda p: p <> '' AND p <> '.'), '/') AS f FROM found),
tried AS (
  SELECT file, type, raw, [f] || CASE WHEN f LIKE '%.js' THEN [f[:-4], f[:-4] || '.ts', f[:-4] || '.tsx'] ELSE [] END
      || list_transform(string_split('{" ".join(graph.EXTENSIONS)}', ' '), lambda x: f || x) || list_transform(string_split('{" ".join(graph.INDEXES)}', ' '), lambda x: f || '/' || x) AS c
  FROM full_),
each AS (SELECT file, type, raw, unnest(c) AS target, generate_subscripts(c, 1) AS ord FROM tried),
resolved AS (SELECT file, type, raw, arg_min(target, ord) AS target FROM each WHERE target IN (SELECT file FROM h) GROUP BY file, type, raw)"""


def _modules(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rel_path of the files; file, text of their imports and of their exports."""
    p = t(spark, d, "pages").select(F.expr(_MODULE).alias("file"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l"))
    u = p.select("file", F.posexplode("l").alias("i", "h"))
    text = lambda before, after: F.concat(F.lit(before), "h", F.lit(after))
    form = F.when(F.col("i") % 3 == 0, text("import a from 'a'; import '.", "'")).when(F.col("i") % 3 == 1, text("const x = require('fs'), y = require('.", ".js')")).otherwise(text("import {\n  a,\n} from '.", "'"))
    return p.select(F.col("file").alias("rel_path")).distinct(), u.select("file", form.alias("text")), u.filter("i % 5 = 0").select("file", text('export { a } from ".', '"').alias("text"))


def _resolved(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    known, *texts = _modules(spark, d)
    return known, *[graph.resolve(graph.import_paths(x), known) for x in texts]


@query(f"WITH {_MODULES} SELECT file, raw FROM found WHERE type = 'imports'")
def import_parse(spark, d):
    return graph.import_paths(_modules(spark, d)[1])


@query(f"WITH {_MODULES} SELECT file, raw, target FROM resolved WHERE type = 'imports'")
def import_resolve(spark, d):
    return _resolved(spark, d)[1]


@query(f"WITH {_MODULES} SELECT DISTINCT 'kg:file:' || file || '|' || type || '|kg:file:' || target AS id, type FROM resolved")
def graph_imports_exports(spark, d):
    known, imports, exports = _resolved(spark, d)
    none = known.select(F.col("rel_path").alias("file"), F.lit("").alias("symbol"))
    return graph.edges(known, none, imports, exports).filter("type IN ('imports', 'exports')").select("id", "type")


@query(f"WITH {_MODULES} SELECT DISTINCT file AS source, target FROM resolved WHERE type = 'imports' AND file <> target")
def dep_graph(spark, d):
    known, imports, _ = _resolved(spark, d)
    files_ = known.withColumn("file", F.col("rel_path")).withColumn("language", files.language(F.col("rel_path")))
    return graph.dependencies(files_, files_, imports)[1]


@query(_g(", p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT id FROM nodes ORDER BY id LIMIT 200)) SELECT id, round(600 + 340 * cos(2 * pi() * i / (SELECT count(*) FROM p) - pi() / 2), 4) AS x, round(400 + 340 * sin(2 * pi() * i / (SELECT count(*) FROM p) - pi() / 2), 4) AS y FROM p"))
def layout_circle(spark, d):
    return graph.circle(graph.drawn(_graph(spark, d)[0])).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"SELECT file, round(greatest(4.0, 3 * sqrt(count(*))), 6) AS radius, CASE WHEN length(file) > 45 THEN '...' || right(file, 42) ELSE file END AS label FROM {CHUNKS} GROUP BY file")
def node_radius(spark, d):
    c = packed_chunks(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return c.select("file", F.round(graph.radius(F.col("n")), 6).alias("radius"), graph.short_label(F.col("file")).alias("label"))


_KIND = "CASE doc_id % 7 WHEN 0 THEN 'struct' WHEN 1 THEN 'trait' WHEN 2 THEN 'property' WHEN 3 THEN 'namespace' WHEN 4 THEN 'import' WHEN 5 THEN 'method' END"


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'variable' WHEN 5 THEN 'method' ELSE 'module' END AS type FROM documents")
def kind_map(spark, d):
    return t(spark, d, "documents").select("doc_id", graph.node_type(F.expr(_KIND)).alias("type"))


# Statistics and streams ------------------------------------------------------------------------------------------------


@query(f"SELECT count(*)::BIGINT AS n_chunks, count(DISTINCT file)::BIGINT AS n_files, count(DISTINCT language)::BIGINT AS n_languages FROM {CHUNKS}")
def stats_status(spark, d):
    return stats.status(packed_chunks(spark, d))


@query(f"SELECT file, count(*)::BIGINT AS n, arg_min(language, id) AS language, min(id) AS first_id FROM {CHUNKS} GROUP BY file")
def stats_by_file(spark, d):
    return stats.by_file(packed_chunks(spark, d))


@query("SELECT * FROM (VALUES ('light', 384, 46), ('balanced', 768, 109), ('max', 1024, 1100)) v(tier, dimension, size_mb)")
def model_catalog(spark, d):
    return stats.models(spark)


def _events(spark, d):
    return t(spark, d, "events").select("event_id", F.concat(F.lit("u/"), "user_id").alias("path"), F.col("event_type").alias("action"), "ts")


@query("""WITH e AS (SELECT ts, 'u/' || user_id AS path, ts - lag(ts) OVER (ORDER BY ts) >= INTERVAL 5 MINUTE AS gap FROM events),
s AS (SELECT *, sum(coalesce(gap, true)::INTEGER) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n_events, count(DISTINCT path)::BIGINT AS n_paths FROM s GROUP BY k""")
def stream_debounce(spark, d):
    b = changes.quiet_periods(_events(spark, d), "5 minutes")
    return b.select(F.unix_micros("start").alias("start_us"), "n_events", "n_paths")


@query("SELECT 'u/' || user_id AS path, arg_max(event_type, (ts, event_id)) AS action FROM events GROUP BY 1")
def stream_last_event(spark, d):
    return changes.last_events(_events(spark, d)).select("path", "action")


# Symbols ---------------------------------------------------------------------------------------------------------------


_SECTIONS = f"""l AS (SELECT rel_path AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM {FILES}),
u AS (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY i) AS under FROM l),
h AS (SELECT file, trim(line) AS name, i, n FROM u WHERE length(trim(line)) >= 3 AND (trim(line) = upper(trim(line)) AND regexp_matches(line, '[A-Z]') OR regexp_matches(trim(coalesce(under, '')), '^[=-]{{3,}}$'))),
sections AS (SELECT file, name, i::INTEGER AS start_line, coalesce(lead(i) OVER (PARTITION BY file ORDER BY i) - 1, n)::INTEGER AS end_line FROM h)"""


@query(f"WITH {_SECTIONS} SELECT * FROM sections")
def sym_text_sections(spark, d):
    return adapters.text_sections(corpus(spark, d).select(F.col("rel_path").alias("file"), "text"))


@query(f"""WITH RECURSIVE {_SECTIONS},
s AS (SELECT file, name, start_line AS a, list_slice(string_split(text, chr(10)), start_line, end_line) AS l FROM sections JOIN {FILES} f ON f.rel_path = file),
big AS (SELECT * FROM s WHERE ceil(length(array_to_string(l, chr(10))) / 4) > 512),
r AS (
  SELECT file, name, a, l, 1 AS s, 1 AS e, length(l[1]) AS n FROM big
  UNION ALL
  SELECT file, name, a, l, CASE WHEN n + 1 + length(l[e + 1]) <= 2048 THEN s ELSE e + 1 END, e + 1,
         CASE WHEN n + 1 + length(l[e + 1]) <= 2048 THEN n + 1 + length(l[e + 1]) ELSE length(l[e + 1]) END
  FROM r WHERE e < len(l)),
cut AS (SELECT file, name, a + s - 1 AS first, a + max(e) - 1 AS last, array_to_string(list_slice(any_value(l), s, max(e)), chr(10)) AS content FROM r GROUP BY file, name, a, s),
free AS (SELECT rel_path AS file, text, list_slice(string_split(text, chr(10)), 1, coalesce((SELECT min(start_line) FROM sections x WHERE x.file = rel_path) - 1, 1000000000)) AS l, len(string_split(text, chr(10))) AS n FROM {FILES}),
rest AS (SELECT file, 'file_' || regexp_replace(file, '[^a-zA-Z0-9]', '_', 'g') AS name, 1 AS first, n AS last, array_to_string(l, chr(10)) AS content FROM free
         WHERE ceil(length(text) / 4) <= 1024 AND len(l) > 0 AND ceil(length(array_to_string(l, chr(10))) / 4) <= 512),
whole AS (SELECT file, name, a AS first, a + len(l) - 1 AS last, array_to_string(l, chr(10)) AS content FROM s WHERE ceil(length(array_to_string(l, chr(10))) / 4) <= 512)
SELECT file || ':' || first || '-' || last AS id, name AS symbol, sha256(content) AS hash
FROM (FROM cut UNION ALL FROM rest UNION ALL FROM whole)""")
def chunk_sections(spark, d):
    """The documents cut along their headed sections: choice, split and remainder as the index does it."""
    f = corpus(spark, d)
    s = adapters.text_sections(f.select(F.col("rel_path").alias("file"), "text"))
    s = s.select("file", F.col("start_line").alias("seq"), "name", F.lit("section").alias("type"), "start_line", "end_line")
    return chunking.chunks(f, s).select("id", "symbol", "hash")


_PARAGRAPHS = f"""pl AS (SELECT rel_path AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {FILES}),
pb AS (SELECT *, regexp_matches(line, '^\\s*$') AS blank, lag(regexp_matches(line, '^\\s*$'), 1, true) OVER o AS before, lead(regexp_matches(line, '^\\s*$'), 1, true) OVER o AS after FROM pl WINDOW o AS (PARTITION BY file ORDER BY i)),
pa AS (SELECT file, line, i, row_number() OVER (PARTITION BY file ORDER BY i) AS k FROM pb WHERE NOT blank AND before),
pz AS (SELECT file, i AS j, row_number() OVER (PARTITION BY file ORDER BY i) AS k FROM pb WHERE NOT blank AND after),
paragraphs AS (SELECT file, (k - 1)::INTEGER AS seq, substr(trim(line), 1, 80) AS name, i::INTEGER AS start_line, j::INTEGER AS end_line FROM pa JOIN pz USING (file, k))"""


@query(f"WITH {_PARAGRAPHS} SELECT * FROM paragraphs")
def sym_paragraphs(spark, d):
    return adapters.paragraphs(corpus(spark, d).select(F.col("rel_path").alias("file"), "text"))


@query(f"""WITH {_SECTIONS}, {_PARAGRAPHS},
first AS (SELECT file, min(start_line) AS a FROM sections GROUP BY file)
SELECT file, name, start_line, end_line FROM sections
UNION ALL SELECT rel_path, 'whole', 1, len(string_split(text, chr(10)))::INTEGER FROM {FILES} WHERE rel_path NOT IN (SELECT file FROM first)
UNION ALL SELECT p.file, name, start_line, end_line FROM paragraphs p JOIN first USING (file) WHERE end_line < a""")
def chunk_overlap(spark, d):
    """Symbols that overlap: each document is a class, its headed sections are functions, its paragraphs modules. What a preferred one
    overlaps goes: the class where there are sections, and the paragraphs that these, or the class, cover."""
    f = corpus(spark, d).select(F.col("rel_path").alias("file"), "text")
    cols = lambda df, kind, seq: df.select("file", seq.cast("int").alias("seq"), "name", F.lit(kind).alias("type"), "start_line", "end_line")
    whole = f.select("file", F.lit("whole").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    s = cols(whole, "class", F.lit(0)).unionByName(cols(adapters.text_sections(f), "function", F.col("start_line"))).unionByName(cols(adapters.paragraphs(f), "module", F.col("seq")))
    return chunking.choose(s).select("file", F.explode("kept").alias("k")).select("file", F.col("k.name").alias("name"), F.col("k.start_line").alias("start_line"), F.col("k.end_line").alias("end_line"))


@query("SELECT page_id, len(regexp_extract_all(html, '<(nav|article|footer|script|style|main|header|section|form|aside|dialog|details|template)[\\s>]'))::BIGINT AS n FROM pages WHERE n > 0")
def sym_html_elements(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"), F.lit("html").alias("language"))
    s = adapters.symbols(p).filter(~F.col("name").contains("-"))
    return s.groupBy(F.col("file").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


#: Languages and what begins a comment of theirs that goes to the end of the line.
_COMMENTED = dict.fromkeys("ts js go rs java c cpp csharp php swift kotlin dart scala solidity salesforce".split(), "// ") | dict.fromkeys("py rb dockerfile yaml toml terraform config".split(), "# ") | dict.fromkeys("sql lua haskell".split(), "-- ")
#: Others, and what begins and ends a comment over lines, and what of a text would end it.
_BLOCKS = dict.fromkeys("css json".split(), ("/* ", " */", "/")) | dict.fromkeys("html xml vue svelte svg markdown astro documentation".split(), ("<!-- ", " -->", ">"))


def _snippet(key: str, expected: list[tuple]) -> None:
    """A query that extracts symbols, and as SQL what they must be: of files that begin with the lines of a document as a comment, where the
    language has any, so that the lines of all symbols follow from the documents; else of a snippet alone."""
    [(file, code)] = [(f, c) for k, f, c in SNIPPETS if k == key]
    mark, block = _COMMENTED.get(key), _BLOCKS.get(key)
    whole = mark or block

    def run(spark, d):
        if whole:
            lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(mark), x)) if mark else F.array(F.concat(F.lit(block[0]), F.replace("text", F.lit(block[2]), F.lit(" ")), F.lit(block[1])))
            s = t(spark, d, "documents").select(F.lit(key).alias("language"), F.concat(F.lit("d"), "doc_id", F.lit(f"/{file}")).alias("file"), F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.lit(code)).alias("text"))
        else:
            s = spark.createDataFrame([(key, file, code)], "language string, file string, text string")
        return adapters.symbols(s).select("file", "seq", "name", "type", "start_line", "end_line")

    QUERIES[f"sym_{key}"] = run
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(file)}, {i}, {quoted(n)}, '{k}', {a}, {b})" for i, (n, k, a, b) in enumerate(expected))
    found = f"(VALUES {rows}) v(file, seq, name, type, start_line, end_line)"
    above = "len(string_split(text, chr(10)))"
    ORACLE_SQL[f"sym_{key}"] = f"SELECT 'd' || doc_id || '/' || v.file AS file, seq, name, type, (start_line + {above})::INTEGER AS start_line, (end_line + {above})::INTEGER AS end_line FROM documents, {found}" if whole else f"SELECT * FROM {found}"


def _register_snippets() -> None:
    from .fixtures import EXPECTED

    for key, expected in EXPECTED.items():
        _snippet(key, expected)


_register_snippets()
