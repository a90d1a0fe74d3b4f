"""Operators that SQL cannot check, and properties."""

import json
import os
import random
import sqlite3
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from lodestone import api
from lodestone.functions.memory import slices
from lodestone.functions.text import stem, stems, trimmed
from lodestone.operators import chunking, delta, graph, inverted, keyword, stats, vector
from lodestone.plans.fixtures import EXPECTED, SNIPPETS
from lodestone.sources import adapters, files
from lodestone.sources.store import Config, Store
from lodestone.streaming import changes


def until(done, query, seconds=100):
    """Wait for a running query to bring something about."""
    end = time.monotonic() + seconds
    while not done():
        assert query.exception() is None and time.monotonic() < end
        time.sleep(0.3)


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "rho", "sigma"]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(n)]


@pytest.mark.parametrize("q", ["alpha", "alpha beta", "rho", "gamma sigma delta"])
def test_bm25_equals_fts5(spark, q):
    rows = corpus() + [(100 + i, "filler words only") for i in range(30)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, id UNINDEXED, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(id, content) VALUES (?, ?)", rows)
    want = {int(i): r for i, r in db.execute("SELECT id, rank FROM f WHERE f MATCH ? ORDER BY rank", (q,))}
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r["rank"] for r in keyword.bm25(df, "id", F.col("text"), keyword.query_terms(spark, {"q": q}), 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 for i in got)


@pytest.mark.parametrize("q", ["notes", "running dogs", "a_b", "crème brulee", "dogs a_b", "the the", "b_a", "zebra"])
def test_stored_index_equals_fts5(spark, tmp_path, q):
    """Stems, marks, phrases, two fields: ranks as the full-text engine's own; also after rows were taken out and added."""
    rng = random.Random(9)
    vocabulary = ["note", "noted", "running", "runs", "dog", "dogs", "a", "b", "Crème", "brûlée", "the", "a b", "b, a"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), rng.choice(["dog", "a", "", None])) for i in range(80)] + [(200 + i, "filler only", "x") for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, symbol, id UNINDEXED, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(id, content, symbol) VALUES (?, ?, ?)", rows)
    match = " ".join(f'"{p}"' for p in q.replace("_", " _").replace(" _", "_").split())
    want = {int(i): r for i, r in db.execute("SELECT id, rank FROM f WHERE f MATCH ?", (match.replace("_", " "),))}
    schema, fields = "id long, text string, symbol string", [F.col("text"), F.col("symbol")]
    half = spark.createDataFrame(rows[:70] + [(500, "dogs a b notes", "b")], schema)
    posted = inverted.postings(half, "id", fields).unionByName(inverted.postings(spark.createDataFrame(rows[70:], schema), "id", fields))
    posted = inverted.without(posted, spark.createDataFrame([(500,)], "id long"))
    store = Store(spark, str(tmp_path / "s"))
    store.write(postings=inverted.clustered(posted))
    p = store.read("postings")
    got = {r.id: r["rank"] for r in inverted.search(spark, p, inverted.terms(p), inverted.totals(p), {"q": q}, 1000).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 for i in got)
    kept = inverted.search(spark, p, inverted.terms(p), inverted.totals(p), {"q": q}, 1000, ids=spark.createDataFrame([(i,) for i in list(got)[::2]], "id long")).collect()
    assert {r.id: r["rank"] for r in kept} == {i: got[i] for i in list(got)[::2]}


def test_index_scan_is_pruned(spark, sf):
    """A search reads postings of its terms, and no text."""
    from lodestone.plans import catalog

    df = catalog.QUERIES["kw_bm25_batch"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "In(term, [" in plan and "documents.parquet" not in plan and "text" not in plan.split("Physical Plan")[1]


def test_store_keeps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda n: spark.range(n).select(F.col("id").alias("k"))
    store.write(a=rows(1), b=rows(9))
    reader = Store(spark, str(tmp_path))
    old = reader.read("a")
    for n in (2, 3):
        store.write(a=rows(n))
    assert old.count() == 1 and reader.refresh().count("a") == 3 and reader.count("b") == 9
    other = Store(spark, str(tmp_path))
    store.write(a=rows(4))
    with pytest.raises(RuntimeError):
        other.write(a=rows(5))
    store.delete("a", "k", [0, 3])
    assert Store(spark, str(tmp_path)).count("a") == 2 and store.count("b") == 9
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("manifest")]) == 3 and len(list((tmp_path / "a").iterdir())) <= 4


def test_code_reaches_executors(tmp_path):
    """From a folder where the package cannot be imported, workers still get it."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return 'okapi'\n")
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {top!r})
from lodestone import api
from lodestone.sources.store import Store
store = Store(spark, {str(tmp_path / "store")!r})
api.index(spark, {str(src)!r}, store)
print("found", [r.file for r in api.search(spark, store, "okapi").collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "found ['a.py'" in done.stdout, done.stderr[-2000:]


def test_reindex_watch_and_lookups(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(4):
        (src / f"m{i}.py").write_text(f"def f{i}():\n    return 'beast{i}'\n")
    store = Store(spark, str(tmp_path / "store"))
    assert api.index(spark, str(src), store, stop=lambda: True)["mode"] == "stopped" and not store.has("chunks")
    api.index(spark, str(src), store)
    (src / "m0.py").write_text("def zebras():\n    return 1\n")
    (src / "m1.py").unlink()
    (src / "node_modules").mkdir()
    events = [("m0.py", "change", 0), ("m1.py", "unlink", 1), ("node_modules/x.js", "add", 2)]
    spark.createDataFrame(events, "path string, action string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(1).write.parquet(str(tmp_path / "events"))
    q = api.watch(spark, str(src), store, changes.source(spark, str(tmp_path / "events"), "path string, action string, ts timestamp"), str(tmp_path / "check"), gap="1 second")
    until(lambda: "m1.py" not in {r.rel_path for r in store.refresh().read("file_state").collect()}, q)
    assert q.isActive
    q.stop()
    again = Store(spark, str(tmp_path / "other"))
    api.index(spark, str(src), again)
    rows = lambda s, t: sorted(map(str, s.read(t).collect()))
    for t in ("chunks", "file_state", "terms", "totals"):
        assert rows(store, t) == rows(again, t)
    assert api.search(spark, store, "zebra").first().file == "m0.py" and api.search(spark, store, "beast1").filter("match_type <> 'vector'").count() == 0
    with pytest.raises(ValueError):
        api.reindex(spark, str(src), store, ["../x"])
    one = api.chunks_for_file(store, "m2.py").first()
    assert api.get_chunk(store, one.id).first() == one
    g = api.graph_tables(spark, store)
    node = api.find_node(g, "m2.py").first()
    assert node.id == "kg:file:m2.py" and api.find_node(g, "m2.py", "f2").first().type == "function" and api.get_nodes(g, [node.id, "none"]).count() == 1
    code, page = api.answer(g, "/api/node/kg%3Afile%3Am2.py")
    assert api.answer(g, "/api/graph?offset=x")[0] == 400 and "error" in json.loads(api.answer(g, "/api/graph?limit=-1")[1])
    assert code == 200 and json.loads(page)["node"]["id"] == node.id and len(json.loads(page)["neighbors"]) >= 2
    assert api.answer(g, "/api/node/none") == (404, "Not found") and api.answer(g, "/x")[0] == 404
    assert json.loads(api.answer(g, "/api/stats")[1])["file"] == 3 and json.loads(api.answer(g, "/api/search?q=m2")[1])[0]["file"] == "m2.py"
    whole = json.loads(api.answer(g, "/api/graph")[1])
    assert len(whole["nodes"]) == g[0].count() and len(whole["edges"]) == g[1].count()
    assert api.status(store).first().n_vectors == store.count("chunks")
    report = api.doctor(spark, str(src), store)
    assert {r.status for r in report.collect()} == {"ok", "warn"} and stats.summary(report).filter("status = 'warn'").first().n == 1
    bad = {r.name: r.status for r in api.doctor(spark, str(tmp_path / "nowhere"), Store(spark, str(tmp_path / "empty")), "{broken").collect()}
    assert bad["workspace"] == "error" and bad["index folder"] == "warn" and bad["configuration"] == "error"
    assert api.dependency_svg(spark, store).count("<circle") == 3
    skipped = Store(spark, str(tmp_path / "third"))
    (src / "a.min.js").write_text("x")
    (src / "b.g.ts").write_text("let x")
    api.index(spark, str(src), skipped, config=Config(languages=("ts", "py")))
    assert {r.rel_path for r in skipped.read("file_state").collect()} == {"m0.py", "m2.py", "m3.py"}


def test_drawing_keeps_all_edges(spark):
    n = 30
    nodes = spark.createDataFrame([(f"n{i:02d}", f"n{i}") for i in range(n)], "id string, label string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(n) if i != j], "source string, target string")
    assert graph.svg(nodes, edges).count("<line") == n * (n - 1) and graph.svg(nodes, edges).count("<circle") == n


def test_subtree_of_any_depth(spark):
    edges = spark.createDataFrame([(f"d{i}", f"d{i + 1}", "contains") for i in range(6)] + [("d6", "d0", "contains")], "source string, target string, type string")
    assert {(r.id, r.depth) for r in graph.subtree(edges, "d0").collect()} == {(f"d{i}", i) for i in range(7)}


def test_levels_and_registry():
    changes.set_level("verbose")
    assert changes.log.isEnabledFor(15) and not changes.log.isEnabledFor(10)
    changes.set_level("info")
    with pytest.raises(ValueError):
        changes.set_level("loud")
    assert files.extensions(["py", "none", "go"]) == [".py", ".pyw", ".go"]


def test_stems_equal_fts5():
    words = "caresses ponies cats feed agreed plastered motoring sing conflated sized hopping falling hissing failing filing happy sky relational conditional rational digitizer radically formalize electrical hopeful goodness revival allowance airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate effective probate rate cease controlling rolling generalizations oscillators".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter ascii')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    for w in words:
        db.execute("DELETE FROM f")
        db.execute("INSERT INTO f VALUES (?)", (w,))
        assert [stem(w)] == [r[0] for r in db.execute("SELECT term FROM v")], w
    assert stems("Crème BRÛLÉE_x") == ["creme", "brule", "x"]


def test_phrases():
    assert keyword.phrases("  a_b  c!  é ") == [["a", "b"], ["c"]]


def test_trimmed(spark):
    assert [r.x for r in spark.createDataFrame([("\t a \n",), (" b",)], "s string").select(trimmed(F.col("s")).alias("x")).collect()] == ["a", "b"]


def test_ignore_and_language(spark):
    cases = {"a/node_modules/x.js": True, "src/a.min.js": True, "a/B.PNG": True, "src/a.ts": False, "x/keep.log": False, "x/b.log": True, "docs/y.md": True}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.i for r in df.select("p", files.ignored(F.col("p"), ["# c", "*.log", "!keep.log", "docs/"]).alias("i")).collect()}
    assert got == cases
    langs = {"a.ts": "ts", "b.PY": "py", "Dockerfile": "dockerfile", "Dockerfile.test": "dockerfile", "x.profile-meta.xml": "salesforce", "a.xml": "xml", "Dockerfile-guide.md": "markdown", "Dockerfile.prod": "dockerfile", "dockerfiles.py": "py", "b.h": "c", "n.xyz": "generic"}
    got = {r.p: r.i for r in spark.createDataFrame([(p,) for p in langs], "p string").select("p", files.language(F.col("p")).alias("i")).collect()}
    assert got == langs
    assert files.inside("/tmp", "a/b") and not files.inside("/tmp", "../etc")


def test_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src").mkdir()
    for name, text in (("src/a.ts", "let x"), ("node_modules/b.ts", "x"), ("src/empty.ts", ""), ("src/c.png", "x"), ("src/d.py", "def f():\n    pass\n")):
        (tmp_path / name).write_text(text)
    assert sorted((r.rel_path, r.language, r.size) for r in files.scan(spark, str(tmp_path)).collect()) == [("src/a.ts", "ts", 5), ("src/d.py", "py", 18)]


def test_chunks_never_overlap_and_fit(spark):
    rng = random.Random(2)
    texts, syms = [], []
    for f in range(12):
        lines = ["z" * rng.choice((3, 80, 900, 3000)) for _ in range(rng.randint(1, 40))]
        texts.append((f"f{f}", "\n".join(lines), "ts"))
        for s in range(rng.randint(0, 6)):
            a = rng.randint(1, len(lines))
            syms.append((f"f{f}", s, f"n{s}", rng.choice(("class", "function", "method", "other")), a, rng.randint(a, len(lines))))
    c = chunking.chunks(spark.createDataFrame(texts, "rel_path string, text string, language string"), spark.createDataFrame(syms, "file string, seq int, name string, type string, start_line int, end_line int")).collect()
    for f in {r.file for r in c}:
        own = sorted((r.start_line, r.end_line) for r in c if r.file == f and not r.symbol.startswith("file_"))
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
    assert all(len(r.content) <= 2048 or r.start_line == r.end_line for r in c if not r.symbol.startswith("file_"))


def test_incremental_equals_full(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        (src / f"m{i}.py").write_text(f"def f{i}():\n    return {i}\n")
    store = Store(spark, str(tmp_path / "store"))
    assert api.index(spark, str(src), store)["mode"] == "full"
    (src / "m1.py").write_text("def g():\n    return 9\n")
    (src / "m2.py").unlink()
    (src / "m7.py").write_text("def h():\n    pass\n")
    done = api.index(spark, str(src), store)
    assert (done["mode"], done["added"], done["modified"], done["removed"]) == ("incremental", 1, 1, 1)
    again = Store(spark, str(tmp_path / "other"))
    api.index(spark, str(src), again)
    rows = lambda s, t: sorted(map(str, s.read(t).collect()))
    assert rows(store, "chunks") == rows(again, "chunks") and rows(store, "file_state") == rows(again, "file_state")
    assert api.index(spark, str(src), store)["modified"] == 0
    found = api.search(spark, store, "return 9").collect()
    assert [r.file for r in found][:1] == ["m1.py"] and found[0].match_type in ("keyword", "hybrid")
    assert api.search(spark, store, "return", language="go").count() == 0
    g = api.graph_tables(spark, store)
    assert api.get_graph_stats(g).filter("type = 'file'").first().n == 6
    # The function, and the rest of the file (its empty last line).
    assert {r.label for r in api.get_node(g, "kg:file:m1.py").filter("edge_type = 'defines'").collect()} == {"g", "file_m1_py"}
    assert api.svg(g).startswith("<svg")
    assert Store(spark, str(tmp_path / "store"), model="max").needs_rebuild()


def test_delta_partitions_keys(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, hash string")
    assert {r.k: r.status for r in delta.delta(old, new, "k").collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}


@pytest.mark.parametrize("case", SNIPPETS, ids=lambda c: c[0])
def test_adapters(case):
    key, file, text = case
    s, *_, error = adapters.parse(key, file, text)
    assert error is None and [(x["name"], x["type"], x["start"], x["end"]) for x in s] == EXPECTED[key]


def test_adapter_errors_stay_in_their_row(spark):
    got = adapters.parsed(spark.createDataFrame([("a.py", "py", "def ("), ("b.py", "py", "import os  \n# c"), ("c", None, None)], "file string, language string, text string")).collect()
    by = {r.file: r for r in got}
    assert by["a.py"].error.startswith("SyntaxError") and by["b.py"].imports == ["import os"] and by["b.py"].comments == ["# c"] and by["c"].error is None


def test_text_sections(spark):
    f = spark.createDataFrame([("t", "TITLE\nbody\nNEXT\nmore\nUnder\n-----\nx")], "file string, text string")
    assert [(r.name, r.start_line, r.end_line) for r in adapters.text_sections(f).orderBy("start_line").collect()] == [("TITLE", 1, 2), ("NEXT", 3, 4), ("Under", 5, 7)]
    p = spark.createDataFrame([("t", "a b\nc\n\n \nd")], "file string, text string")
    assert [(r.name, r.start_line, r.end_line) for r in adapters.paragraphs(p).collect()] == [("a b", 1, 2), ("d", 5, 5)]


def test_plain_text_and_unknown_files_are_indexed(spark, tmp_path):
    """Long .txt files and files of unknown kind get symbols, chunks and vectors for all their text, and are found."""
    src = tmp_path / "src"
    src.mkdir()
    filler = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(130)]
    (src / "headed.txt").write_text("intro zebra\n\nFIRST PART\n" + "\n".join(filler) + "\nSecond\n------\n" + "\n".join(filler) + "\nwalrus")
    (src / "loose.txt").write_text("\n\n".join(filler) + "\n\nocelot here")
    (src / "unknown.xyz").write_text("\n\n".join(filler) + "\n\n\nsame\n\nsame\n\nmarmot here\n")
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(src), store)
    text = {f: "\n".join(r.content for r in store.read("chunks").filter(F.col("file") == f).collect()) for f in ("headed.txt", "loose.txt", "unknown.xyz")}
    for f, found in text.items():
        assert not set((src / f).read_text().split()) - set(found.split()), f
    assert store.read("vectors").count() == store.read("chunks").count()
    for word, f in (("zebra", "headed.txt"), ("walrus", "headed.txt"), ("ocelot", "loose.txt"), ("marmot", "unknown.xyz")):
        assert api.search(spark, store, word).first().file == f
    of = lambda *a: [(s["name"], s["type"], s["start"], s["end"]) for s in adapters.parse(*a)[0]]
    assert of("text", "a.txt", "TITLE\nbody\nUnder\n-----\nx") == [("TITLE", "section", 1, 2), ("Under", "section", 3, 5)]
    assert of("text", "a.txt", "a b\nc\n\n \nd\n") == [("a b c", "section", 1, 2), ("d", "section", 5, 5)]
    assert of("generic", "a.xyz", "a b\nc\n\n \nd\n\na b\nc") == [("a b", "module", 1, 2), ("d", "module", 5, 5), ("a b", "module", 7, 8)]


def test_json_of_many_tokens(spark):
    """Keys of a large JSON file keep their own lines, and each has its chunk."""
    n = 9000
    text = "{\n" + ",\n".join(f'  "k{i}": "v{i}"' for i in range(n - 1)) + ',\n  /* of\n two lines */ "last": {\n    "inner": 1\n  }\n}\n'
    s, *_, error = adapters.parse("json", "big.json", text)
    assert error is None and [(x["name"], x["start"]) for x in s] == [(f"k{i}", i + 2) for i in range(n - 1)] + [("last", n + 2), ("inner", n + 3)]
    assert s[-1]["parent"] == n + 2
    f = spark.createDataFrame([("big.json", "json", text)], "file string, language string, text string")
    c = chunking.chunks(f.withColumnRenamed("file", "rel_path"), adapters.symbols(f)).select("symbol", "start_line", "content").collect()
    assert len(c) == n + 1 and {r.symbol for r in c} == {x["name"] for x in s} and all(f'"{r.symbol}"' in r.content for r in c)


def test_knn_of_many_queries(spark, monkeypatch):
    """Every fiftieth vector of a table that takes several blocks and slabs, with many equal vectors, against plain NumPy."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(5000, 8)).astype(np.float32)
    v[1000:4000] = v[0]
    rows = [(f"v{i:05d}", [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([*rows, ("none", None)], "vec_id string, embedding array<float>").repartition(3)
    asked = list(range(0, 5000, 50))
    assert len(asked) > vector.BLOCK and len(rows) > vector.SLAB
    got = {}
    for r in vector.knn_batch(df, [(i, rows[i][1]) for i in asked], 7).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.vec_id, round(r.distance, 9)))
    d = ((v[asked].astype(float)[:, None, :] - v.astype(float)) ** 2).sum(-1)
    for q, i in enumerate(asked):
        want = np.lexsort((np.arange(5000), d[q]))[:7]
        assert sorted(got[i]) == [(p + 1, rows[j][0], round(float(d[q, j]), 9)) for p, j in enumerate(want)]
    # The same in tiles: a grid of several rows and columns, and lists that meet in two steps.
    monkeypatch.setattr(vector, "TILE", 8 * 40)
    monkeypatch.setattr(vector, "MEET", 16)
    asked_df = df.filter(F.col("vec_id").isin([rows[i][0] for i in asked])).withColumnRenamed("vec_id", "query_id").unionByName(spark.createDataFrame([("nothing", None)], "query_id string, embedding array<float>"))
    tiled = {}
    for r in vector.knn_join(df, asked_df, 7).collect():
        tiled.setdefault(int(r.query_id[1:]), []).append((r.pos, r.vec_id, round(r.distance, 9)))
    assert {i: sorted(x) for i, x in tiled.items()} == {i: sorted(x) for i, x in got.items()}
    assert vector.knn_join(df.limit(0), asked_df).count() == 0 and vector.knn_join(df, asked_df.limit(0)).count() == 0


IMPORTS = [("src/a/m.ts", "import { a } from '../b/n.js'\nconst z = require(\"./q\")\nimport './s.css'\nimport fs from 'fs'\nconst x = require('fs'), y = require('./y')\nimport c from 'c'; import '../m'"), ("src/m.ts", "import {\n  x,\n} from './lib'"), ("src/b/n.ts", ""), ("src/lib/index.ts", "import '../m'"), ("src/a/q.py", "")]


def test_imports_of_all_forms(spark):
    f = spark.createDataFrame(IMPORTS, "file string, text string")
    raws = graph.import_paths(f)
    assert sorted(map(tuple, raws.collect())) == [("src/a/m.ts", "../b/n.js"), ("src/a/m.ts", "../m"), ("src/a/m.ts", "./q"), ("src/a/m.ts", "./s.css"), ("src/a/m.ts", "./y"), ("src/lib/index.ts", "../m"), ("src/m.ts", "./lib")]
    got = graph.resolve(raws, f.select(F.col("file").alias("rel_path")))
    assert sorted((r.file, r.target) for r in got.collect()) == [("src/a/m.ts", "src/a/q.py"), ("src/a/m.ts", "src/b/n.ts"), ("src/a/m.ts", "src/m.ts"), ("src/lib/index.ts", "src/m.ts"), ("src/m.ts", "src/lib/index.ts")]


def test_imports_over_lines_reach_the_graph(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.ts").write_text("import {\n  b,\n  c,\n} from './b'\nexport {\n  d\n} from './d'\nexport function f() {\n  return `}`\n}\n")
    (src / "b.ts").write_text("export const b = 1\n")
    (src / "d.ts").write_text("export const d = 1\n")
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(src), store)
    nodes, edges = api.graph_tables(spark, store)
    assert {(r.source, r.type, r.target) for r in edges.filter("type IN ('imports', 'exports')").collect()} == {("kg:file:a.ts", "imports", "kg:file:b.ts"), ("kg:file:a.ts", "exports", "kg:file:d.ts")}
    assert "import {" not in {r.label for r in nodes.collect()}


def test_statements_members_and_templates():
    of = lambda *a: [(s["name"], s["type"], s["start"], s["end"]) for s in adapters.parse(*a)[0]]
    assert of("ts", "a.ts", "function f() {\n  return `}`\n}\nfunction g() {\n  return `\n}\n`\n}\n") == [("f", "function", 1, 3), ("g", "function", 4, 8)]
    java = "class A {\n  String foo() {\n    return bar(1);\n  }\n  void bar(int x)\n  {\n    if (x > 0) { go(x); }\n    x = y(2);\n  }\n  public int baz() { return 1; }\n}\n"
    assert of("java", "A.java", java) == [("A", "class", 1, 11), ("foo", "method", 2, 4), ("bar", "method", 5, 9), ("baz", "method", 10, 10)]
    assert adapters.parse("go", "a.go", 'import (\n  "fmt"\n)\nfunc F() {\n}\n')[1] == ['import (\n  "fmt"\n)']
    assert adapters.parse("py", "a.py", "from a import (\n  b,\n)\nimport os\n")[1] == ["from a import (\n  b,\n)", "import os"]


def test_a_hub_is_dealt_out(spark):
    """All of many nodes at one: the first labels and the count, by groups of bounded size."""
    nodes = spark.range(5000).select(F.format_string("n%04d", "id").alias("id"), F.format_string("l%04d", F.lit(5000) - F.col("id")).alias("label"))
    edges = nodes.select(F.concat(F.lit("e"), "id").alias("id"), F.lit("hub").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("type"))
    assert [tuple(r) for r in graph.connected(nodes, edges, "hub").collect()] == [("defines", 5000, "l0001, l0002, l0003, l0004, l0005")]


def test_fiftieth_asks_every_stated_query(spark, sf):
    from lodestone.plans import catalog

    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert n > 8 and catalog.QUERIES["vec_knn_batch"](spark, sf).select("query_id").distinct().count() == n


def test_embedding_and_layout():
    e = vector.HashingProvider(64)
    a, b, c = e.embed(["running fast", "run fast", ""])
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and a == b and not any(c)
    at = graph.force_layout(["a", "b", "c"], [("a", "b")])
    assert at == graph.force_layout(["a", "b", "c"], [("a", "b")]) and all(60 <= x <= 1140 and 60 <= y <= 740 for x, y in at.values())


def test_config():
    assert Config.load("{broken").model == "balanced"
    c = Config.load('{"model": "max", "unknown": 1}').put("rerank", "false").put("languages", "py,go")
    assert Config.load(c.save()) == c and c.languages == ("py", "go")
    for bad in (("nope", "1"), ("model", "huge"), ("rerank", "maybe")):
        with pytest.raises(ValueError):
            c.put(*bad)


def test_quiet_periods_equal_a_plain_pass(spark, monkeypatch):
    """Any number of ranges, periods over many borders, one hot moment, gaps of just the waiting time."""
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 0, 1, 2, 4, 5, 6, 30])
        rows.append((f"p{rng.randrange(9)}", at))
    rows += [(f"q{i}", 200) for i in range(150)] + [(None, 3)] + [("none", None)]
    want, last = [], None
    for t in sorted({t for _, t in rows if t is not None}):
        if last is None or t - last >= 5:
            want.append([t, t, 0, set()])
        own = [p for p, s in rows if s == t]
        want[-1][1], want[-1][2], last = t, want[-1][2] + len(own), t
        want[-1][3] |= set(own)
    df = spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("ts")).repartition(4)
    for slices in (1, 2, 7, 64):
        monkeypatch.setattr(changes, "SLICES", slices)
        got = changes.quiet_periods(df, "5 seconds").select(F.unix_timestamp("start"), F.unix_timestamp("end"), "n_events", "n_paths").collect()
        assert sorted(map(tuple, got)) == [(a, b + 5, n, len(p)) for a, b, n, p in want]
    assert changes.quiet_periods(df.limit(0), "5 seconds").count() == 0


def test_stream_waits_for_quiet(spark, tmp_path):
    """A running query calls once for each quiet period, also when nothing follows it; a burst of old events is cut into its periods."""
    folder, calls = tmp_path / "in", []

    def happen(*events):
        rows = [(p, "change", s) for p, s in events]
        spark.createDataFrame(rows, "path string, action string, s long").select("path", "action", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))

    happen(("a", 0), ("b", 1))
    stream = changes.source(spark, str(folder), "path string, action string, ts timestamp")
    q = changes.on_quiet(stream, lambda paths, n: calls.append({r.path for r in paths.collect()}), str(tmp_path / "quiet"), str(tmp_path / "check"), "3 seconds")
    happen(("a", 2), ("c", 3))
    until(lambda: calls, q)
    assert calls == [{"a", "b", "c"}] and q.isActive
    happen(("d", 60), ("d", 61), ("e", 62), ("f", 100))
    until(lambda: len(calls) == 3, q)
    q.stop()
    assert calls == [{"a", "b", "c"}, {"d", "e"}, {"f"}]
    # What was pending when a query stopped is not lost.
    happen(("g", 200))
    start = lambda: changes.on_quiet(stream, lambda paths, n: calls.append({r.path for r in paths.collect()}), str(tmp_path / "quiet"), str(tmp_path / "check"), "3 seconds")
    q = start()
    until(lambda: Store(spark, str(tmp_path / "quiet")).has("pending"), q)
    q.stop()
    assert len(calls) == 3
    q = start()
    until(lambda: len(calls) == 4, q)
    q.stop()
    assert calls[3] == {"g"}


def test_reporter():
    seen = []
    r = changes.Reporter()
    r.listeners = [lambda p: 1 / 0, lambda p: seen.append(p.percent)]
    r.report("scanning", 1, 4)
    assert seen == [25]


def test_rst_underlines_are_runs():
    """A line of prose that begins with a character of underlines, and is longer than the line above, makes no heading."""
    text = "Released.\n+1 (486) 555-1619 Des oile mentoi des aiai.\n# a list of words\n\nTitle\n+++++\nx"
    assert [(s["name"], s["start"], s["end"], s["meta"]["level"]) for s in adapters.parse("documentation", "a.rst", text)[0]] == [("Title", 5, 6, "7")]


def test_parsing_holds_a_part_of_a_batch():
    """A batch of long files is parsed a bounded part at a time, and what nobody asks for is not made: else Python holds it all, some times over."""
    import tracemalloc

    import pyarrow as pa

    text = "\n".join(["// " + "word " * 40] * 100) + "\npublic class A {\n}"
    n = 800
    batch = pa.RecordBatch.from_pydict({"file": [f"{i}.cs" for i in range(n)], "language": ["csharp"] * n, "text": [text if i else None for i in range(n)]})
    got, most = 0, 0
    tracemalloc.start()
    for b in adapters.parse_batches(iter([batch]), lists=False):
        assert b.schema.names == ["file", "language", "symbols", "error"]
        got, most = got + b.num_rows, max(most, b.num_rows)
        assert all([s["name"] for s in x] == ["A"] for f, x in zip(b.column("file").to_pylist(), b.column("symbols").to_pylist(), strict=True) if f != "0.cs")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and most * len(text) < 2_000_000 and peak < n * len(text) / 3
    assert sum(b.num_rows for b in adapters.parse_batches(iter([batch.slice(0, 9)]))) == 9
    parts = [b.num_rows for b in slices(batch, "text", len(text))]
    assert parts == [2, *[1] * (n - 2)] and list(slices(batch.slice(0, 0), "text")) == []
