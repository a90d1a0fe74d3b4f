"""The knowledge graph as two tables, nodes and edges, and the queries on it.

nodes: id, label, type, language, file, start_line, end_line; edges: id, source, target, type.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Node types of symbol kinds; any other kind is a module.
KINDS = {"struct": "class", "trait": "interface", "constant": "variable", "property": "variable", "namespace": "module"} | {
    k: k for k in "class interface enum function method variable module package constructor extension field type_alias document section table selector rule actor object protocol".split()
}
#: Endings that an import path may lack, in order.
EXTENSIONS = ".ts .tsx .js .jsx .py .go .mts .cts .mjs .cjs".split()
INDEXES = "index.ts index.tsx index.js index.jsx __init__.py index.py".split()
_NODE = ["id", "label", "type", "language", "file", "start_line", "end_line"]


def node_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return F.coalesce(F.element_at(table, kind), F.lit("module"))


def _node(id_: Column, label: Column, type_: Column, language=None, file=None, start=None, end=None) -> list[Column]:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    number = lambda c: F.lit(0) if c is None else c.cast("int")
    return [id_.alias("id"), label.alias("label"), type_.alias("type"), text(language).alias("language"), text(file).alias("file"), number(start).alias("start_line"), number(end).alias("end_line")]


def _edge(source: Column, target: Column, type_: str) -> list[Column]:
    return [F.concat_ws("|", source, F.lit(type_), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(type_).alias("type")]


def folder_id(path: Column) -> Column:
    return F.when(path == "", F.lit("kg:workspace")).otherwise(F.concat(F.lit("kg:folder:"), path))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders(files: DataFrame) -> DataFrame:
    """path: every folder on the way to a file."""
    parts = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).filter("path <> ''").distinct()


def workspace(spark) -> DataFrame:
    return spark.range(1).select(*_node(F.lit("kg:workspace"), F.lit("workspace"), F.lit("workspace")))


def folder_nodes(files: DataFrame) -> DataFrame:
    nested = files.filter(F.col("rel_path").contains("/"))
    return folders(nested).select(*_node(folder_id(F.col("path")), F.substring_index("path", "/", -1), F.lit("folder"), file=F.col("path")))


def file_nodes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nodes that belong to a file: its own, and one for each symbol (of repeats the last)."""
    own = files.select(*_node(F.concat(F.lit("kg:file:"), "rel_path"), F.substring_index("rel_path", "/", -1), F.lit("file"), F.col("language"), F.col("rel_path")))
    last = chunks.filter("symbol <> ''").groupBy("file", "symbol").agg(F.max_by(F.struct("kind", "language", "start_line", "end_line"), F.struct("start_line", "end_line")).alias("s"))
    sym = last.select(*_node(symbol_id(), F.col("symbol"), node_type(F.col("s")["kind"]), F.col("s")["language"], F.col("file"), F.col("s")["start_line"], F.col("s")["end_line"]))
    return own.unionByName(sym)


def nodes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Workspace, folders, files, and one node for each file and symbol."""
    return workspace(files.sparkSession).unionByName(folder_nodes(files)).unionByName(file_nodes(files, chunks))


def symbol_id() -> Column:
    return F.concat(F.lit("kg:sym:"), "file", F.lit(":"), "symbol")


def folder_edges(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return folders(files.filter(F.col("rel_path").contains("/"))).select(*_edge(folder_id(parent_path(path)), folder_id(path), "contains"))


def file_edges(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The edges that belong to a file: from its folder, and to its symbols."""
    out = files.select(*_edge(folder_id(parent_path(F.col("rel_path"))), F.concat(F.lit("kg:file:"), "rel_path"), "contains"))
    return out.unionByName(chunks.filter("symbol <> ''").select("file", "symbol").distinct().select(*_edge(F.concat(F.lit("kg:file:"), "file"), symbol_id(), "defines")))


def link_edges(imports: DataFrame, exports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(*_edge(F.concat(F.lit("kg:file:"), "file"), F.concat(F.lit("kg:file:"), "target"), kind)).distinct() for x, kind in ((imports, "imports"), (exports, "exports"))])


def edges(files: DataFrame, chunks: DataFrame, imports: DataFrame | None = None, exports: DataFrame | None = None) -> DataFrame:
    """contains (folder to folder and file), defines (file to symbol), imports and exports (file to file, from what was resolved: file, target)."""
    out = folder_edges(files).unionByName(file_edges(files, chunks))
    none = files.select(F.col("rel_path").alias("file"), F.col("rel_path").alias("target")).limit(0)
    return out if imports is None and exports is None else out.unionByName(link_edges(none if imports is None else imports, none if exports is None else exports))


def both_ways(edges_: DataFrame) -> DataFrame:
    """Edges as they are stored: each once at its source (outwards) and once at its target. at: that end."""
    ends = F.array(F.struct(F.col("source").alias("at"), F.lit(True).alias("outwards")), F.struct(F.col("target").alias("at"), F.lit(False).alias("outwards")))
    return edges_.select("*", F.explode(ends).alias("e")).select(F.col("e.at").alias("at"), F.col("e.outwards").alias("outwards"), *edges_.columns)


def neighbors_stored(nodes_: DataFrame, around: DataFrame, others: DataFrame, id_: str) -> DataFrame:
    """neighbors() of edges as both_ways() has them, whose scan reads the one node's, and of a few other kinds of edges."""
    own = around.filter(F.col("at") == id_).filter("outwards OR source <> target")
    own = own.select(F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.when(F.col("outwards"), F.col("target")).otherwise(F.col("source")).alias("id"))
    return own.unionByName(_at(others, id_)).join(nodes_, "id")


def updated(nodes_: DataFrame, edges_: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame | None = None, exports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after files were indexed anew: their nodes and what starts at them are replaced, edges of other files to them stay."""
    n, e = nodes(files, chunks), edges(files, chunks, imports, exports)
    own = nodes_.filter("type <> 'folder'").join(files.select(F.col("rel_path").alias("file")), "file", "left_semi").select("id")
    kept = nodes_.join(own.unionByName(n.select("id")), "id", "left_anti")
    still = edges_.join(own.select(F.col("id").alias("source")), "source", "left_anti").join(e.select("id"), "id", "left_anti")
    return n.unionByName(kept), e.unionByName(still)


def import_paths(texts: DataFrame) -> DataFrame:
    """file, raw: quoted relative paths of import lines (from '..', require('..'), import '..'), the first form of a line with such a path.
    Statements over several lines have their path on one of them."""
    line = texts.select("file", F.explode(F.split("text", "\n")).alias("line"))
    path = r"['\"](\.[^'\"]*)['\"]"
    forms = (rf"from\s+{path}", rf"require\s*\(\s*{path}\s*\)", rf"import\s+{path}")
    raw = F.coalesce(*[F.nullif(F.regexp_extract("line", f, 1), F.lit("")) for f in forms])
    return line.select("file", raw.alias("raw")).filter(F.col("raw").isNotNull())


def normalised(path: Column) -> Column:
    """A path without empty and . parts; .. takes the part before it."""
    pop = lambda a: F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", pop(a)).otherwise(F.array_append(a, p))), "/")


def resolve(raws: DataFrame, files: DataFrame, extensions: list[str] = EXTENSIONS, indexes: list[str] = INDEXES) -> DataFrame:
    """file, raw, target: the first candidate path that is a file. Candidates are made for each import and meet the files in one join."""
    full = normalised(F.concat_ws("/", parent_path(F.col("file")), "raw"))
    r = raws.select("file", "raw", full.alias("full"))
    swap = lambda ext: F.when(F.col("full").endswith(ext), F.array(*[F.concat(F.expr(f"substr(full, 1, length(full) - {len(ext)})"), F.lit(e)) for e in ("", ".ts", ".tsx")])).otherwise(F.array().cast("array<string>"))
    options = F.concat(F.array("full"), swap(".js"), swap(".jsx"), F.array(*[F.concat("full", F.lit(e)) for e in extensions]), F.array(*[F.concat("full", F.lit(f"/{i}")) for i in indexes]))
    tried = r.select("file", "raw", F.posexplode(options).alias("ord", "target"))
    met = tried.join(files.select(F.col("rel_path").alias("target")).distinct(), "target")
    return met.groupBy("file", "raw").agg(F.min_by("target", "ord").alias("target"))


def dependencies(files: DataFrame, chunks: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, language, chunk_count) of files, and distinct (source, target) without loops."""
    counts = chunks.groupBy(F.col("file").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    n = files.select(F.col("rel_path").alias("id"), "language").join(counts, "id", "left").fillna(0, ["chunk_count"])
    return n, resolved.filter("file <> target").select(F.col("file").alias("source"), "target").distinct()


def _at(edges_: DataFrame, id_: str) -> DataFrame:
    """edge_id, edge_type, id: the edges at a node with their other end; a loop once."""
    out = edges_.filter(F.col("source") == id_).select(F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("target").alias("id"))
    back = edges_.filter((F.col("target") == id_) & (F.col("source") != id_)).select(F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("source").alias("id"))
    return out.unionByName(back)


def neighbors(nodes_: DataFrame, edges_: DataFrame, id_: str) -> DataFrame:
    """The nodes one edge away, either way, with the edge; a loop once."""
    return _at(edges_, id_).join(nodes_, "id")


def children(nodes_: DataFrame, edges_: DataFrame, id_: str) -> DataFrame:
    return nodes_.join(edges_.filter((F.col("source") == id_) & (F.col("type") == "contains")).select(F.col("target").alias("id")), "id", "left_semi")


def lookup(nodes_: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes with these ids, a few; they reach the scan as a filter."""
    return nodes_.filter(F.col("id").isin(ids))


def find(nodes_: DataFrame, file: str, label: str | None = None) -> DataFrame:
    """The first node by id of a file with this label; without a label the file's own node."""
    own = F.col("type") == "file" if label is None else F.col("label") == label
    return nodes_.filter((F.col("file") == file) & own).orderBy("id").limit(1)


def nested(chunks: DataFrame) -> DataFrame:
    """Edges from a symbol to those of the same file whose parent it is."""
    c = chunks.filter("symbol <> ''").select("file", "symbol", "parent").distinct()
    holder = c.select("file", F.col("symbol").alias("parent")).distinct()
    met = c.filter(F.col("parent") != F.col("symbol")).join(holder, ["file", "parent"])
    return met.select(*_edge(F.concat(F.lit("kg:sym:"), "file", F.lit(":"), "parent"), symbol_id(), "contains")).distinct()


def search(nodes_: DataFrame, q: str, type_: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose label, file or id holds q (% and _ are wildcards), the first by id; the type is tested after the limit."""
    like = f"%{q}%"
    hit = nodes_.filter(F.col("label").ilike(like) | F.coalesce(F.col("file").ilike(like), F.lit(False)) | F.col("id").ilike(like)).orderBy("id").limit(limit)
    return hit.filter(F.col("type") == type_) if type_ else hit


def degrees(edges_: DataFrame) -> DataFrame:
    """id, degree: edges at a node; a loop counts once."""
    ends = edges_.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def search_with_degree(nodes_: DataFrame, edges_: DataFrame, q: str, limit: int = 30) -> DataFrame:
    """The first hits by id with the number of their edges. The hits, `limit` at most, are found once; their ids then reach the edges' scan."""
    found = search(nodes_, q).orderBy("id").limit(limit).collect()
    hit, ids = nodes_.sparkSession.createDataFrame(found, nodes_.schema), [r.id for r in found]
    ends = edges_.filter(F.col("source").isin(ids)).select(F.col("source").alias("id")).unionByName(edges_.filter(F.col("target").isin(ids) & (F.col("source") != F.col("target"))).select(F.col("target").alias("id")))
    return hit.join(F.broadcast(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))), "id", "left").fillna(0, ["degree"])


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy("id").offset(offset).limit(limit)


def stats(nodes_: DataFrame) -> DataFrame:
    return nodes_.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def attached(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    a = nodes_.select(F.col("id").alias("source"))
    return edges_.join(a, "source", "left_semi").join(a.withColumnRenamed("source", "target"), "target", "left_semi")


#: Parts into which a hub's neighbours are dealt before their first labels are sought.
HUB_PARTS = 64


def connected(nodes_: DataFrame, edges_: DataFrame, id_: str, most: int = 5) -> DataFrame:
    """edge_type, n, labels: the neighbours by kind of edge, and the first five labels.

    A hub's neighbours are dealt to HUB_PARTS groups of each kind; each keeps its first few, and only these meet."""
    n = neighbors(nodes_, edges_, id_).withColumn("part", F.pmod(F.xxhash64("edge_id"), F.lit(HUB_PARTS)))
    few = n.withColumn("r", F.row_number().over(Window.partitionBy("edge_type", "part").orderBy("label", "id"))).filter(F.col("r") <= most)
    first = few.groupBy("edge_type").agg(F.slice(F.array_sort(F.collect_list(F.struct("label", "id"))), 1, most).alias("l"))
    labels = first.select("edge_type", F.array_join(F.transform("l", lambda x: x["label"]), ", ").alias("labels"))
    return n.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).join(labels, "edge_type")


def subtree(edges_: DataFrame, root: str) -> DataFrame:
    """id, depth: what root contains, each node at its least depth, level by level until no new one is found. Levels are written to the
    shared folder, so that the plan does not grow with them and a lost executor costs one level at most."""
    spark = edges_.sparkSession
    step = edges_.filter("type = 'contains'").select("source", "target")
    path, kind = shared_folder(spark, "subtree"), "id string, depth int"
    level = spark.createDataFrame([(root, 0)], kind)
    for depth in count(1):
        level.select("id").write.parquet(f"{path}/depth={depth - 1}")
        seen = spark.read.schema(kind).parquet(path)
        last = seen.filter(F.col("depth") == depth - 1).select(F.col("id").alias("source"))
        if last.isEmpty():
            return seen
        level = step.join(last, "source", "left_semi").select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")


def circle(nodes_: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    """id, x, y on a circle in order of id. The drawing holds few nodes (see drawn)."""
    radius = min(width / 2, height / 2) - 60
    angle = 2 * math.pi * F.col("i") / F.col("n") - math.pi / 2
    placed = nodes_.withColumn("i", F.row_number().over(Window.orderBy("id")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return placed.select("id", (width / 2 + radius * F.cos(angle)).alias("x"), (height / 2 + radius * F.sin(angle)).alias("y"))


def drawn(nodes_: DataFrame, n: int = 200) -> DataFrame:
    """The first n nodes: what a drawing shows."""
    return nodes_.orderBy("id").limit(n)


def force_layout(ids: list[str], links: list[tuple[str, str]], width: float = 1200, height: float = 800, rounds: int = 150, seed: int = 1) -> dict[str, tuple[float, float]]:
    """Positions of a drawing's few nodes: repulsion 8000/d^2, springs d/80, gravity 0.005, cooling in a straight line, fitted with a margin of 60."""
    rng, at = np.random.default_rng(seed), {i: k for k, i in enumerate(ids)}
    p = rng.random((len(ids), 2)) * [width, height]
    ends = np.array([(at[a], at[b]) for a, b in links if a in at and b in at], int).reshape(-1, 2)
    for r in range(rounds):
        d = p[:, None] - p[None, :]
        far = np.maximum(np.sqrt((d**2).sum(2)), 1)
        move = (d / far[..., None] * (8000 / far**2)[..., None]).sum(1)
        pull = p[ends[:, 1]] - p[ends[:, 0]]
        pull = pull * (np.sqrt((pull**2).sum(1, keepdims=True)) / 80 / np.maximum(np.sqrt((pull**2).sum(1, keepdims=True)), 1))
        np.add.at(move, ends[:, 0], pull)
        np.add.at(move, ends[:, 1], -pull)
        move += (np.array([width / 2, height / 2]) - p) * 0.005
        p += move * (1 - r / rounds)
    lo, hi = p.min(0), p.max(0)
    p = 60 + (p - lo) / np.maximum(hi - lo, 1e-9) * (np.array([width, height]) - 120)
    return {i: (float(x), float(y)) for i, (x, y) in zip(ids, p, strict=True)}


def radius(chunk_count: Column) -> Column:
    return F.greatest(F.lit(4.0), 3 * F.sqrt(chunk_count))


def short_label(label: Column) -> Column:
    return F.when(F.length(label) > 45, F.concat(F.lit("..."), F.right(label, F.lit(42)))).otherwise(label)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _drawing(dots: DataFrame, edges_: DataFrame, width: float, height: float) -> str:
    """dots: id, label, x, y, r of a drawing's few nodes; all edges among them are drawn, once for each pair, below the nodes."""
    a, b = dots.select(F.col("id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1")), dots.select(F.col("id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = edges_.select("source", "target").join(F.broadcast(a), "source").join(F.broadcast(b), "target").distinct()
    lines = pairs.select(F.lit(0).alias("o"), F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', "x1", "y1", "x2", "y2").alias("s"))
    marks = dots.select(F.lit(1).alias("o"), F.format_string('<circle cx="%.1f" cy="%.1f" r="%.1f"/><text x="%.1f" y="%.1f">%s</text>', "x", "y", "r", "x", "y", escaped(short_label(F.col("label")))).alias("s"))
    rows = [r.s for r in lines.unionByName(marks).orderBy("o", "s").collect()]  # bounded by the pairs of a drawing's nodes
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" stroke="#999">' + "".join(rows) + "</svg>"


def svg(nodes_: DataFrame, edges_: DataFrame, width: float = 1200, height: float = 800) -> str:
    """A drawing of the first 200 nodes and the edges among them."""
    few = drawn(nodes_)
    return _drawing(few.select("id", "label").join(circle(few, width, height), "id").withColumn("r", F.lit(5.0)), edges_, width, height)


def dependency_svg(nodes_: DataFrame, edges_: DataFrame, width: float = 1200, height: float = 800) -> str:
    """A drawing of the first 200 files by force layout, their size after their chunks. nodes_ and edges_: as from dependencies()."""
    few = drawn(nodes_).collect()
    ids = [r.id for r in few]
    links = edges_.filter(F.col("source").isin(ids) & F.col("target").isin(ids)).collect()
    at = force_layout(ids, [(r.source, r.target) for r in links], width, height) if ids else {}
    dots = nodes_.sparkSession.createDataFrame([(r.id, r.id, *at[r.id], r.chunk_count) for r in few], "id string, label string, x double, y double, n long")
    return _drawing(dots.withColumn("r", radius(F.col("n"))), edges_, width, height)
