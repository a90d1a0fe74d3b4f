"""What a client calls: build or update an index, search it, and query its graph. Each query is one small plan."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from contextlib import ExitStack
from datetime import UTC, datetime, timedelta
from functools import reduce
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, graph, hybrid, inverted, keyword, stats, vector
from .shipping import ship
from .sources import adapters, files
from .sources.segments import Segments
from .sources.store import Config, Conflict, Store
from .streaming import changes
from .streaming.running import Running

log = logging.getLogger("lodestone")
_DIMENSION = {t[0]: t[1] for t in vector.TIERS}


def _chunks(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks of files, by what was parsed of them."""
    sym = parsed.select("file", F.posexplode("symbols").alias("seq", "s")).select("file", "seq", F.col("s.name").alias("name"), F.col("s.type").alias("type"), F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"))
    return chunking.chunks(found, sym).join(parsed.select("file", "imports", "exports"), "file", "left")


def _vectors(chunks: DataFrame, model: str, provider: vector.EmbeddingProvider | None = None) -> DataFrame:
    """vec_id, embedding. Texts of a batch that the provider fails on have the zero vector."""
    ship(chunks.sparkSession)
    provider = provider or vector.HashingProvider(_DIMENSION[model])

    @F.pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd

        try:
            return pd.Series(provider.embed([t or "" for t in texts]))
        except Exception:  # noqa: BLE001  a model that fails stops no index
            return pd.Series([[0.0] * provider.dimension] * len(texts))

    return chunks.select(F.col("id").alias("vec_id"), embed("content").alias("embedding"))


def _posted(chunks: DataFrame) -> DataFrame:
    return inverted.gathered(chunks, "id", [F.col("content"), F.col("symbol")])


#: The tables of an index and the columns by which their rows go; terms add up; how rows lie in a segment, so that scans skip the rest.
KEYS = {
    "chunks": "id", "vectors": "vec_id", "postings": "id", "made": "id", "file_state": "rel_path", "stats": "rel_path", "errors": "rel_path",
    "graph_nodes": "file", "graph_edges": "owner", "graph_links": "file",
}
SUMS = {"terms": ("term", "df")}
LAYOUT = {
    "postings": inverted.clustered,
    "chunks": lambda df: df.repartitionByRange("file").sortWithinPartitions("file", "start_line"),
    "terms": lambda df: df.repartitionByRange("term").sortWithinPartitions("term"),
    "graph_nodes": lambda df: df.repartitionByRange("id").sortWithinPartitions("id"),
    "graph_edges": lambda df: df.repartitionByRange("at", "id").sortWithinPartitions("at", "id"),  # a hub is spread over files
}
#: The tables of so few files are one task each, and need no ranges.
FEW_FILES = 100
LAYOUT_FEW = {
    "postings": inverted.clustered_few,
    "chunks": lambda df: df.coalesce(1).sortWithinPartitions("file", "start_line"),
    "terms": lambda df: df.coalesce(1).sortWithinPartitions("term"),
    "graph_nodes": lambda df: df.coalesce(1).sortWithinPartitions("id"),
    "graph_edges": lambda df: df.coalesce(1).sortWithinPartitions("at", "id"),
}
for _name in ("vectors", "made", "file_state", "stats", "errors", "graph_links"):
    LAYOUT_FEW[_name] = lambda df: df.coalesce(1)
#: So many paths are looked up as values, which reach the scans; more are joined.
FEW_PATHS = 1_000
#: A file changed so shortly before it was listed may change again within the same tick of its clock: it is read again next time.
TICK_S = 2
RETRIES = 3
#: Seconds after which what cancelled jobs still wrote is deleted.
LEFT_S = 5


def _segments(store: Store, few: bool = False) -> Segments:
    return Segments(store, KEYS, SUMS, LAYOUT_FEW if few else LAYOUT)


def _graph(changed: DataFrame, chunks: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """The graph's tables for some files: nodes and edges that belong to them, and the paths that they import and export from."""
    own = changed.select("rel_path", "language")
    s = parsed.select("file", F.explode("symbols").alias("s")).select("file", F.col("s.name").alias("symbol"), F.col("s.start").alias("start"), F.col("s.parent").alias("above"))
    below = s.filter("above IS NOT NULL").join(s.select("file", F.col("start").alias("above"), F.col("symbol").alias("parent")), ["file", "above"]).select("file", "symbol", "parent")
    named = chunks.select("file", "symbol").distinct()
    nested = graph.nested(named.join(below, ["file", "symbol"], "left").select("file", "symbol", "parent"))
    owner = lambda df: df.withColumn("owner", F.regexp_extract("target", "^kg:(?:file|sym):(.*)$", 1))
    plain = graph.file_edges(own, chunks)
    owned = chunks.filter("symbol <> ''").select(graph.symbol_id().alias("target"), F.col("file").alias("owner")).distinct()
    edges = owner(plain.filter("type = 'contains'")).unionByName(plain.filter("type = 'defines'").unionByName(nested).join(owned, "target").select("id", "source", "target", "type", "owner"))
    raws = [graph.import_paths(parsed.select("file", F.explode(c).alias("text")).distinct()).withColumn("type", F.lit(c)) for c in ("imports", "exports")]
    return {"graph_nodes": graph.file_nodes(own, chunks), "graph_edges": graph.both_ways(edges), "graph_links": raws[0].unionByName(raws[1]).distinct()}


def _apply(store: Store, got: DataFrame, removed: DataFrame, counts: dict[str, int], began: datetime, whole: bool = False, unlisted: DataFrame | None = None, no_more: DataFrame | None = None, provider: vector.EmbeddingProvider | None = None, phase: Callable[[str], None] = lambda name: None) -> None:
    """One new segment. got: read files with their status, staged; removed: rel_path of files that are no more; unlisted: what could not
    be listed; no_more: rel_path of errors that do not hold any more.

    What is written is in proportion to got, to what the index held of these files, and to removed; a merge of segments comes now and then."""
    changed = got.filter("status IN ('added', 'modified')")
    out = removed.unionByName(got.filter("status IN ('modified', 'unreadable')").select("rel_path"))
    n_out = sum(counts[k] for k in ("modified", "unreadable", "removed"))
    with ExitStack() as passing:
        staged = lambda df: passing.enter_context(store.written(df))
        parsed = staged(adapters.parsed(changed.select(F.col("rel_path").alias("file"), "language", "text")))
        chunks = staged(_chunks(changed, parsed))
        posted = staged(_posted(chunks))
        unposted, gone = None, {}
        if n_out and not whole:
            held = store.read("chunks")
            if n_out <= FEW_PATHS:
                stale = held.filter(F.col("file").isin([r.rel_path for r in out.collect()]))
            else:
                stale = held.join(out.select(F.col("rel_path").alias("file")), "file", "left_semi")
            stale = staged(stale.select("id", "content", "symbol"))
            unposted = staged(_posted(stale))
            ids = stale.select("id")
            owners = out.select(F.col("rel_path").alias("file"))
            gone = {"chunks": ids, "vectors": ids.select(F.col("id").alias("vec_id")), "postings": ids, "made": ids, "file_state": out}
            gone |= {"graph_nodes": owners, "graph_edges": owners.withColumnRenamed("file", "owner"), "graph_links": owners}
        if not whole:
            told = got.filter("status <> 'same'").select("rel_path").unionByName(removed)
            gone |= {"stats": got.select("rel_path").unionByName(removed), "errors": told if no_more is None else told.unionByName(no_more)}
        sure = F.col("mtime") < F.lit(began - timedelta(seconds=TICK_S))
        errors = [got.filter("error IS NOT NULL").select("rel_path", "error"), got.filter("malformed").select("rel_path", F.lit("not UTF-8: bytes replaced").alias("error")), parsed.filter("error IS NOT NULL").select(F.col("file").alias("rel_path"), "error")]
        errors += [unlisted.select("rel_path", "error")] if unlisted is not None else []
        terms, numbers = inverted.change(posted, unposted)
        new = {
            "chunks": chunks, "vectors": _vectors(chunks, store.model, provider), "postings": posted, "made": chunks.select("id", F.lit(store.model).alias("model"), F.lit(began).alias("last_indexed")), "terms": terms, "file_state": changed.select("rel_path", "hash"),
            "stats": got.filter("error IS NULL").select("rel_path", "size", F.when(sure, F.col("mtime")).alias("mtime")), "errors": reduce(DataFrame.unionByName, errors),
        } | _graph(changed, chunks, parsed)
        phase("building_fts")
        _segments(store, sum(counts.values()) <= FEW_FILES).append(new, gone, numbers, whole)
    _segments(store).compact()


def _counted(rows: DataFrame, column: str = "status") -> dict[str, int]:
    found = {r[0]: r[1] for r in rows.groupBy(column).agg(F.count(F.lit(1))).collect()}
    return {k: found.get(k, 0) for k in ("added", "modified", "removed", "same", "unreadable")}


def _told(got: DataFrame, old: DataFrame) -> DataFrame:
    """Read files with their status: added, modified, same or unreadable; old: rel_path, hash."""
    status = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") == F.col("hash"), "same").otherwise("modified")
    return got.join(old.select("rel_path", F.col("hash").alias("old_hash")), "rel_path", "left").withColumn("status", status).drop("old_hash")


def _retried(store: Store, change: Callable[[], dict]) -> dict:
    """change(), made again on what another writer has made of the index meanwhile."""
    for left in reversed(range(RETRIES)):
        try:
            return change()
        except Conflict:
            if not left:
                raise
            log.info("another writer was first; the change is made again")
            store.refresh()
    raise AssertionError


def index(spark: SparkSession, root: str, store: Store, ignore: list[str] | None = None, config: Config | None = None, stop: Callable[[], bool] = lambda: False, reporter: changes.Reporter | None = None, provider: vector.EmbeddingProvider | None = None) -> dict:
    """Index root into the store: whole, if there is no index or its settings differ, else only what changed. Returns the mode and counts.

    Files whose size and time are those of the last run are not opened; of the others, those with the same hash are not indexed anew.
    config: its languages (none: all) and whether generated files are skipped. stop is asked all the time; once it says so, the running
    jobs are cancelled and the store stays as it is. reporter hears of the phases. provider: another source of vectors. What could not be read or parsed is in the index's table of errors, and counts as unreadable."""
    config = config or Config(skip_generated=False)

    def keep(path: Column) -> Column:
        out = files.language(path).isin(*config.languages) if config.languages else F.lit(True)
        return out & ~files.generated(path) if config.skip_generated else out

    stopped = {"mode": "stopped", "added": 0, "modified": 0, "removed": 0, "unreadable": 0}

    def change(run: Running) -> dict:
        began = datetime.now(UTC)
        run.phase("scanning")
        whole = not store.has("postings") or store.needs_rebuild()
        with ExitStack() as passing:
            listed = passing.enter_context(store.written(files.listing(spark, root, ignore, keep)))
            there = listed.filter("error IS NULL")
            run.phase("embedding")
            if whole:
                none = spark.createDataFrame([], "rel_path string, hash string")
                got = passing.enter_context(store.written(_told(files.read(spark, root, there), none)))
                counts = _counted(got)
                _apply(store, got, none.select("rel_path"), counts, began, True, listed.filter("error IS NOT NULL"), None, provider, run.phase)
                return {"mode": "full"} | {k: counts[k] for k in ("added", "modified", "removed", "unreadable")}
            old, seen = store.read("file_state"), store.read("stats")
            known = there.join(seen.select("rel_path", F.col("size").alias("s"), F.col("mtime").alias("m")), "rel_path", "left")
            open_ = known.filter("s IS NULL OR m IS NULL OR s <> size OR m <> mtime").select("rel_path", "size", "mtime", "error")
            got = passing.enter_context(store.written(_told(files.read(spark, root, open_), old)))
            removed = passing.enter_context(store.written(old.join(there, "rel_path", "left_anti").select("rel_path")))
            counts = _counted(got) | {"removed": removed.count()}
            if any(counts.values()):
                no_more = store.read("errors").join(there, "rel_path", "left_anti").select("rel_path")
                _apply(store, got, removed, counts, began, unlisted=listed.filter("error IS NOT NULL"), no_more=no_more, provider=provider, phase=run.phase)
            return {"mode": "incremental"} | {k: counts[k] for k in ("added", "modified", "removed", "unreadable")}

    with Running(spark, stop, reporter) as run:
        done = _retried(store, lambda: change(run))
        run.phase("ready")
        return done
    store.refresh().clear_left(LEFT_S)
    return stopped


def reindex(spark: SparkSession, root: str, store: Store, paths: list[str], ignore: list[str] | None = None) -> dict:
    """Index a few files anew, by their paths below root: those that are gone, empty or ignored leave the index. What a watcher calls.

    Nothing but these files is listed or read, and only their rows of the index."""
    if not all(files.inside(root, p) for p in paths):
        raise ValueError("a path is outside of the root")

    def change() -> dict:
        began = datetime.now(UTC)
        old = store.read("file_state").filter(F.col("rel_path").isin(paths))
        with ExitStack() as passing:
            read = files.read(spark, root, files.listing(spark, root, ignore, only=paths), max(1, min(len(paths), 8)))
            got = passing.enter_context(store.written(_told(read, old)))
            found = {r.rel_path: r.status for r in got.select("rel_path", "status").collect()}
            gone = [(r.rel_path,) for r in old.select("rel_path").collect() if r.rel_path not in found]
            counts = {k: sum(s == k for s in found.values()) for k in ("added", "modified", "same", "unreadable")} | {"removed": len(gone)}
            if found or gone:
                _apply(store, got, spark.createDataFrame(gone, "rel_path string"), counts, began)
        indexed = sum(s != "unreadable" for s in found.values())
        return {"indexed": indexed, "removed": len(set(paths)) - indexed}

    return _retried(store, change)


def errors(store: Store) -> DataFrame:
    """rel_path, error: what could not be listed, read or parsed, and files whose bytes were replaced."""
    return store.read("errors")


def watch(spark: SparkSession, root: str, store: Store, events: DataFrame, checkpoint: str, ignore: list[str] | None = None, gap: str = "300 milliseconds"):
    """Apply a stream of change events (path, action, ts) to the index, until the query that this returns is stopped.

    The paths of a period that a quiet time of `gap` ends are indexed anew together, those that are gone leave the index. Ignored paths
    do not come through. After more than FEW_PATHS paths the tree is looked through, which opens only what changed. A batch that is
    repeated after a failure gives the same index."""

    def handle(paths: DataFrame, _: int) -> None:
        found = [r.path for r in paths.limit(FEW_PATHS + 1).collect()]
        if len(found) > FEW_PATHS:
            index(spark, root, store.refresh(), ignore)
        elif found:
            reindex(spark, root, store.refresh(), sorted(found), ignore)

    return changes.on_quiet(events.filter(~files.pruned(F.col("path"), ignore)), handle, f"{store.root}/watch", checkpoint, gap)


def search(spark: SparkSession, store: Store, query: str, max_results: int | None = None, file: str | None = None, language: str | None = None, rerank: bool | None = None, config: Config | None = None, provider: vector.EmbeddingProvider | None = None) -> DataFrame:
    """id, file, language, symbol, kind, start_line, end_line, content, score, match_type, the best first.

    Keywords are sought in the stored index, where what is no ASCII letter, digit or _ parts words and AND, OR and NOT join them; no
    text is read but that of the results. Filters (file is a glob) hold before the best are taken. config gives how many results and
    whether they are reranked where that is not said. A provider that fails leaves the keywords, a reranker that fails their order."""
    n, q = hybrid.clamp(config.max_results if max_results is None and config else max_results), keyword.normalise(query)
    rerank = config.rerank if rerank is None and config else bool(rerank)
    if not q:
        raise ValueError("the query is empty")
    chunks, vectors, ids = store.read("chunks"), store.read("vectors"), None
    if language:
        chunks = chunks.filter(F.col("language") == language)
    if file:
        chunks = chunks.filter(F.col("file").rlike(f"(?i)^{files.glob_regex(file)}$"))
    if language or file:
        ids = chunks.select("id")
        vectors = vectors.join(ids.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    n_rows, n_words = (_segments(store).number(x) for x in ("n", "words"))
    asked_words = {"q": keyword.sanitise(q)}
    kw = keyword.minmax(inverted.search(spark, store.read("postings"), store.read("terms"), (n_rows, n_words / max(1, n_rows)), asked_words, ids=ids)).select("id", "score", "pos")
    try:
        asked = (provider or vector.HashingProvider(_DIMENSION[store.model])).embed([q])[0]
    except Exception:
        log.exception("the query has no vector")
        asked = []
    if any(asked):
        near = vector.knn_batch(vectors, [(0, asked)]).select(F.col("vec_id").alias("id"), (1 / (1 + F.col("distance"))).alias("score"), "pos")
    else:
        log.warning("only keywords are searched")
        near = kw.limit(0)
    merged = hybrid.merge(kw, near)
    meta = chunks.select("id", "file", "language", "symbol", "kind", "start_line", "end_line", "content")
    if rerank:
        about = chunks.select(*meta.columns, F.concat_ws(" ", F.array_join("imports", " "), F.array_join("exports", " "), "symbol").alias("text"))
        best = hybrid.rerank(merged, about, hybrid.overlap(q), n)
        return best.orderBy(F.desc("score"), "order_key").select(*meta.columns, "score", "match_type")
    return hybrid.enrich(hybrid.first(merged, n), meta).orderBy("order_key").select(*meta.columns, "score", "match_type")


def get_chunk(store: Store, id_: str) -> DataFrame:
    return store.read("chunks").filter(F.col("id") == id_)


def chunks_for_file(store: Store, file: str) -> DataFrame:
    return store.read("chunks").filter(F.col("file") == file)


class Graph(tuple):
    """(nodes, edges) of an index. around: its stored edges by either end, which is how they lie; others: the edges that are made up from
    the files (folders, imports, exports)."""

    around: DataFrame
    others: DataFrame


def graph_tables(spark: SparkSession, store: Store) -> Graph:
    """nodes and edges of the index. What belongs to a file is stored and changes with it; folders and the targets of imports follow from
    which files there are."""
    known = store.read("file_state").select("rel_path", files.language(F.col("rel_path")).alias("language"))
    links, around = store.read("graph_links"), store.read("graph_edges").drop("owner")
    found = [graph.resolve(links.filter(F.col("type") == kind).select("file", "raw"), known) for kind in ("imports", "exports")]
    others = graph.folder_edges(known).unionByName(graph.link_edges(*found))
    nodes = graph.workspace(spark).unionByName(graph.folder_nodes(known)).unionByName(store.read("graph_nodes"))
    out = Graph((nodes, others.unionByName(around.filter("outwards").select("id", "source", "target", "type"))))
    out.around, out.others = around, others
    return out


def get_graph(g: tuple[DataFrame, DataFrame], offset: int = 0, limit: int = 100, type_: str | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = graph.page(g[0], offset, limit)
    nodes = nodes.filter(F.col("type") == type_) if type_ else nodes
    return nodes, graph.attached(nodes, g[1])


def get_nodes(g: tuple[DataFrame, DataFrame], ids: list[str]) -> DataFrame:
    return graph.lookup(g[0], ids)


def find_node(g: tuple[DataFrame, DataFrame], file: str, label: str | None = None) -> DataFrame:
    return graph.find(g[0], file, label)


def get_node(g: tuple[DataFrame, DataFrame], id_: str) -> DataFrame:
    """The node's neighbours with the edges to them; of a stored graph only the node's own edges are read."""
    return graph.neighbors_stored(g[0], g.around, g.others, id_) if isinstance(g, Graph) else graph.neighbors(*g, id_)


def search_graph(g: tuple[DataFrame, DataFrame], q: str) -> DataFrame:
    return graph.search_with_degree(*g, q)


def get_graph_stats(g: tuple[DataFrame, DataFrame]) -> DataFrame:
    return graph.stats(g[0]).orderBy(F.desc("n"), "type")


def svg(g: tuple[DataFrame, DataFrame]) -> str:
    return graph.svg(*g)


def dependency_svg(spark: SparkSession, store: Store) -> str:
    """The files and their imports, by force layout."""
    known = store.read("file_state").select("rel_path", files.language(F.col("rel_path")).alias("language"))
    found = graph.resolve(store.read("graph_links").filter("type = 'imports'").select("file", "raw"), known)
    return graph.dependency_svg(*graph.dependencies(known, store.read("chunks"), found))


def answer(g: tuple[DataFrame, DataFrame], path: str) -> tuple[int, str]:
    """Status and JSON of a graph request: /api/graph?offset=&limit= (a page of nodes and the edges among them), /api/stats,
    /api/search?q=, /api/node/<id>; anything else is not found. Numbers that are none are a bad request, with an error to read."""
    url = urlsplit(path)
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    said = lambda x: (200, json.dumps(x))
    if url.path == "/api/graph":
        asked = parse_qs(url.query)
        try:
            offset, limit = (int(asked.get(k, [d])[0]) for k, d in (("offset", "0"), ("limit", "1000")))
            if offset < 0 or limit < 0:
                raise ValueError("offset and limit are not below 0")
        except ValueError as e:
            return 400, json.dumps({"error": str(e)})
        nodes = graph.page(g[0], offset, limit).cache()
        try:
            return said({"nodes": rows(nodes), "edges": rows(graph.attached(nodes, g[1]))})
        finally:
            nodes.unpersist()
    if url.path == "/api/stats":
        return said({r["type"]: r["n"] for r in rows(get_graph_stats(g))})
    if url.path == "/api/search":
        q = parse_qs(url.query).get("q", [""])[0]
        return said(rows(graph.search(g[0], q).orderBy("id").limit(30)) if q else [])
    if url.path.startswith("/api/node/"):
        id_ = unquote(url.path.removeprefix("/api/node/"))
        node = rows(graph.lookup(g[0], [id_]))
        if node:
            return said({"node": node[0], "neighbors": rows(get_node(g, id_)), "children": rows(graph.children(*g, id_))})
    return 404, "Not found"


def status(store: Store) -> DataFrame:
    """n_chunks, n_files, n_languages, n_vectors, n_terms, n_nodes and n_edges (those that belong to files)."""
    count = lambda name: store.read(name).agg(F.count(F.lit(1)).alias("n")).scalar()
    return stats.status(store.read("chunks")).withColumn("n_vectors", count("vectors")).withColumn("n_terms", count("terms")).withColumn("n_nodes", count("graph_nodes")).withColumn("n_edges", store.read("graph_edges").filter("outwards").agg(F.count(F.lit(1))).scalar())


def doctor(spark: SparkSession, root: str, store: Store, config_text: str | None = None) -> DataFrame:
    """name, status (ok, warn or error), message of each check of a workspace and its index."""
    return stats.doctor(spark, stats.checks(spark, root, store, config_text))
