"""The index: files as they are found, segments, queries with operators, writers that race."""

import os
import random
import sqlite3
import threading
import time

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from lodestone import api
from lodestone.operators import graph, inverted, match
from lodestone.sources import files, tree
from lodestone.sources.segments import Segments
from lodestone.sources.store import Config, Conflict, Store


def put(top, rel, data=b"x = 1\n"):
    path = top / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


class Spy:
    """A file system that tells which folders were listed."""

    def __init__(self):
        self.own, self.listed = arrow_fs.LocalFileSystem(), []

    def get_file_info(self, what):
        self.listed.append(what.base_dir)
        return self.own.get_file_info(what)


ODD = {
    "src/latin.py": b"name = 'caf\xe9'\n", "src/__init__.py": b"import os\n", ".gitignore": b"*.log\n", "a b/c%20+d[1].ts": b"let zebra = 1\n", "src/empty.py": b"", "src/pic.png": b"x",
    "src/node_modules/x/y.js": b"let hidden\n", "node_modules/z.js": b"let hidden\n", "node_modules/keep.log": b"x", "docs/deep/er/page.md": b"# Zebra\n", "logs/a.log": b"x", "logs/keep.log": b"kept zebra\n",
}


@pytest.mark.parametrize("walked", [256, 1])
def test_scan_prunes_and_tolerates(spark, tmp_path, monkeypatch, walked):
    """Odd bytes are replaced, names that begin with . or _ are files like others, ignored folders are not entered; on the driver or in tasks."""
    monkeypatch.setattr(tree, "FOLDERS", walked)
    for rel, data in ODD.items():
        put(tmp_path, rel, data)
    (tmp_path / "dangling.py").symlink_to(tmp_path / "nowhere.py")
    rules = ["*.log", "!keep.log", "!node_modules/keep.log"]
    got = {r.rel_path: r for r in files.scan(spark, str(tmp_path), rules).collect()}
    assert set(got) == {"src/latin.py", "src/__init__.py", ".gitignore", "a b/c%20+d[1].ts", "docs/deep/er/page.md", "logs/keep.log"}
    assert got["src/latin.py"].text == "name = 'caf�'\n" and got["src/latin.py"].malformed and not got[".gitignore"].malformed
    assert {r.rel_path for r in files.scan(spark, str(tmp_path), rules, only=["a b/c%20+d[1].ts", "node_modules/z.js", "none.py", "src"]).collect()} == {"a b/c%20+d[1].ts"}
    assert {r.rel_path for r in files.scan(spark, str(tmp_path), rules, keep=lambda p: files.language(p) == "py").collect()} == {"src/latin.py", "src/__init__.py"}
    spy = Spy()
    list(tree._walk(spy, str(tmp_path), [""], tree.matcher(files._rules(rules))))
    assert len(spy.listed) == 7 and not any("node_modules" in x for x in spy.listed)


def test_scan_by_sparks_own_listing(spark, tmp_path, monkeypatch):
    """Where Arrow opens no file system: the same files, but for names that Spark hides; no task gets an ignored one."""
    for rel, data in ODD.items():
        put(tmp_path, rel, data)
    monkeypatch.setattr(tree, "opened", lambda root: None)
    df = files.scan(spark, str(tmp_path), ["*.log"])
    assert {r.rel_path for r in df.collect()} == {"src/latin.py", "a b/c%20+d[1].ts", "docs/deep/er/page.md"}
    assert [r.text for r in df.filter("malformed").collect()] == ["name = 'caf�'\n"]


def test_what_cannot_be_read_has_an_error(spark, tmp_path):
    for i in range(4):
        put(tmp_path, f"m{i}.py", f"def f{i}(): return 'beast{i}'\n")
    listed = spark.createDataFrame(files.listing(spark, str(tmp_path)).toArrow())
    (tmp_path / "m1.py").unlink()
    got = {r.rel_path: (r.text, r.error) for r in files.read(spark, str(tmp_path), listed).collect()}
    assert got["m1.py"][0] is None and got["m1.py"][1].startswith("unreadable: ") and got["m0.py"] == ("def f0(): return 'beast0'\n", None)
    assert [e[4] for e in tree._entries(arrow_fs.LocalFileSystem(), str(tmp_path), "gone", lambda p: False)] == ["unreadable folder: FileNotFoundError"]
    (tmp_path / "out.py").symlink_to("/etc/hostname")
    (tmp_path / "loop").symlink_to(tmp_path)
    assert {(r.rel_path, r.error) for r in files.listing(spark, str(tmp_path)).filter("error IS NOT NULL").collect()} == {("out.py", "a link out of the root")}
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tmp_path / "nowhere"))


def test_index_of_an_odd_tree(spark, tmp_path):
    """The index takes what can be read and tells what it could not, or not wholly."""
    src = tmp_path / "src"
    for rel, data in (ODD | {"bad.py": b"def (\n"}).items():
        put(src, rel, data)
    (src / "out.py").symlink_to("/etc/hostname")
    store = Store(spark, str(tmp_path / "store"))
    done = api.index(spark, str(src), store)
    assert done["mode"] == "full" and done["added"] == store.count("file_state") == 8
    told = {r.rel_path: r.error for r in api.errors(store).collect()}
    assert set(told) == {"src/latin.py", "bad.py", "out.py"} and told["bad.py"].startswith("SyntaxError") and told["src/latin.py"].startswith("not UTF-8")
    assert "a b/c%20+d[1].ts" in {r.file for r in api.search(spark, store, "zebra").collect()}
    (src / "src/latin.py").write_bytes(b"name = 'plain'\n")
    (src / "out.py").unlink()
    assert api.index(spark, str(src), store)["modified"] == 1
    assert {r.rel_path for r in api.errors(store).collect()} == {"bad.py"}
    assert "totals" not in store.manifest["tables"] and store.read("totals").first().n == store.count("chunks")


def live(store, name):
    return sorted(map(str, store.read(name).collect()))


def test_segments_follow_every_change(spark, tmp_path, monkeypatch):
    """After each of many changes, with merges in between, the tables are those of an index made anew; untouched segments are not written again."""
    rng = random.Random(6)
    src = tmp_path / "src"
    for i in range(30):
        put(src, f"m{i}.py", f"def f{i}():\n    return 'beast{i}'\n")
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(src), store)
    base = store.manifest["segments"][0]
    seen = []
    for k in range(5):
        for i in rng.sample(range(30), 2):
            put(src, f"m{i}.py", f"def g{k}():\n    return 'other{k}x{i}'\n")
        put(src, f"new{k}.py", f"def new{k}(): pass\n")
        gone = src / f"m{rng.randrange(30)}.py"
        gone.unlink(missing_ok=True)
        api.index(spark, str(src), store)
        seen.append(len(store.manifest["segments"]))
        assert store.manifest["segments"][0] == base
    assert seen == [2, 3, 4, 5, 6]
    segments = api._segments(store, True)
    monkeypatch.setattr("lodestone.sources.segments.RATIO", 0.2)
    segments.compact(3)
    assert len(store.manifest["segments"]) == 2 and store.manifest["segments"][0] == base
    again = Store(spark, str(tmp_path / "again"))
    api.index(spark, str(src), again)
    for name in ("chunks", "file_state", "terms", "totals", "postings", "vectors"):
        assert live(store, name) == live(again, name), name
    segments.compact(1)
    assert len(store.manifest["segments"]) == 1 and not store.manifest["segments"][0]["gone"]
    for name in ("chunks", "file_state", "terms", "totals", "postings", "vectors"):
        assert live(store, name) == live(again, name), name
    # Nothing changed: nothing is read or written.
    number = store.manifest["number"]
    for p in src.iterdir():
        os.utime(p, (1e9, 1e9))
    api.index(spark, str(src), store)
    assert api.index(spark, str(src), store)["modified"] == 0 and store.manifest["number"] == number + 1


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    for i in range(6):
        put(tmp_path, f"src/m{i}.py", f"x = {i}\n")
        os.utime(tmp_path / f"src/m{i}.py", (1e9 + i, 1e9 + i))
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(tmp_path / "src"), store)
    put(tmp_path, "src/m3.py", "x = 'three'\n")
    opened = []
    real = files.read
    monkeypatch.setattr(files, "read", lambda s, root, listed, *a: opened.extend(r.rel_path for r in listed.collect()) or real(s, root, listed, *a))
    assert api.index(spark, str(tmp_path / "src"), store)["modified"] == 1 and opened == ["m3.py"]
    del opened[:]
    assert api.reindex(spark, str(tmp_path / "src"), store, ["m1.py", "none.py"]) == {"indexed": 1, "removed": 1} and opened == ["m1.py"]


def test_hidden_keys_and_sums(spark, tmp_path):
    """Rows go in older segments only; a key may come again; sums add up; a table need not be in every segment."""
    store = Store(spark, str(tmp_path / "s"))
    s = Segments(store, {"a": "k"}, {"t": ("w", "n")})
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    sums = lambda *x: spark.createDataFrame(list(x), "w string, n long")
    s.append({"a": rows((1, "x"), (2, "y"), (3, "z")), "t": sums(("p", 2), ("q", 1))}, numbers={"n": 3})
    reader = Store(spark, str(tmp_path / "s"))
    s.append({"a": rows((2, "new"), (4, "w"))}, {"a": keys(2, 3)}, {"n": 0})
    s.append({"t": sums(("q", -1), ("p", 3))}, {"a": keys(1)}, {"n": -1})
    s.append({"a": rows((1, "back"))}, {"a": keys(9)}, {"n": 1})
    want = [(1, "back"), (2, "new"), (4, "w")]
    read = lambda st: sorted(tuple(r) for r in st.read("a").collect())
    assert read(store) == want and store.read("t").collect() == [("p", 5)] and s.number("n") == 3
    assert read(reader) == [(1, "x"), (2, "y"), (3, "z")] and read(reader.refresh()) == want
    assert [r.v for r in store.read("a").filter("k = 2").collect()] == ["new"]
    for most in (3, 2, 1):
        s.compact(most)
        assert read(store) == want and store.read("t").collect() == [("p", 5)] and len(s.all) <= most
    s.append({"a": rows((7, "only")), "t": sums(("r", 1))}, whole=True)
    assert read(store) == [(7, "only")] and store.read("t").collect() == [("r", 1)]
    for i in range(Store.KEPT):
        s.append({"a": rows((i, "only"))}, whole=True)
    assert len(list((tmp_path / "s" / "a").iterdir())) == Store.KEPT  # older versions are deleted


def test_one_of_two_racing_writers_wins(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).write(a=spark.range(1))
    writers, out, gate = [Store(spark, root) for _ in range(4)], [], threading.Barrier(4)
    real = Store._flip

    def flip(self, manifest):
        gate.wait()  # all have written their tables and take the number at the same time
        return real(self, manifest)

    def run(i):
        try:
            writers[i].write(a=spark.range(10 + i))
            out.append(i)
        except Conflict:
            pass

    Store._flip = flip
    try:
        threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        Store._flip = real
    assert len(out) == 1 and Store(spark, root).count("a") == 10 + out[0]
    assert not [p for p in tmp_path.joinpath("s").iterdir() if p.name.count(".") > 1 and not p.name.startswith(".")]


def test_a_change_that_loses_is_made_again(spark, tmp_path):
    """Another writer is first while a file is indexed: both changes are in the index."""
    for i in range(3):
        put(tmp_path, f"src/m{i}.py", f"x = 'beast{i}'\n")
    src, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))
    api.index(spark, src, store)
    other = Store(spark, str(tmp_path / "store"))
    put(tmp_path, "src/m0.py", "x = 'zebra'\n")
    put(tmp_path, "src/m1.py", "x = 'ocelot'\n")
    assert api.reindex(spark, src, other, ["m0.py"])["indexed"] == 1
    assert api.reindex(spark, src, store, ["m1.py"])["indexed"] == 1
    assert {api.search(spark, store, w).first().file for w in ("zebra", "ocelot")} == {"m0.py", "m1.py"}


def test_queries_with_operators_equal_fts5(spark):
    """Random queries of words, phrases and operators, malformed ones too: rows and ranks as the full-text engine's own."""
    rng = random.Random(3)
    words = ["note", "noted", "runs", "dog", "dogs", "a", "b", "the", "cat", "a_b", "_", "zebra"]
    rows = [(i, " ".join(rng.choice(words[:9]) for _ in range(rng.randint(0, 9))), rng.choice(["dog", "a", "", None])) for i in range(120)] + [(200 + i, "filler only", "x") for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, symbol, id UNINDEXED, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(id, content, symbol) VALUES (?, ?, ?)", rows)
    queries = {f"q{k}": " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(["AND", "OR", "NOT"]) for _ in range(rng.randint(1, 6))) for k in range(120)}
    queries |= {"e0": "", "e1": "AND", "e2": "dog OR", "e3": "NOT dog", "e4": "dog OR AND cat", "e5": "_"}
    want, malformed = {}, 0
    for q, text in queries.items():
        try:
            want[q] = {int(i): r for i, r in db.execute("SELECT id, rank FROM f WHERE f MATCH ?", (text,))} if text else {}
        except sqlite3.OperationalError:
            want[q], malformed = {}, malformed + 1
    p = inverted.postings(spark.createDataFrame(rows, "id long, text string, symbol string"), "id", [F.col("text"), F.col("symbol")]).cache()
    got = {q: {} for q in queries}
    for at in range(0, len(queries), 42):
        for r in inverted.search(spark, p, inverted.terms(p), inverted.totals(p), dict(list(queries.items())[at : at + 42]), 1000).collect():
            got[r.query_id][r.id] = r["rank"]
    p.unpersist()
    assert malformed > 20 and sum(map(bool, want.values())) > 40
    for q in queries:
        assert got[q].keys() == want[q].keys() and all(abs(got[q][i] - want[q][i]) < 1e-7 for i in got[q]), queries[q]


def test_api_search_with_operators(spark, tmp_path):
    for name, text in (("a", "zebra ocelot"), ("b", "zebra"), ("c", "ocelot café")):
        put(tmp_path, f"src/{name}.md", f"{text}\n")
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(tmp_path / "src"), store)
    found = lambda q: {r.file for r in api.search(spark, store, q).filter("match_type <> 'vector'").collect()}
    assert found("zebra NOT ocelot") == {"b.md"} and found("zebra OR ocelot") == {"a.md", "b.md", "c.md"} and found("zebra AND") == set()
    assert found('"zebra" (ocelot)') == {"a.md"} and found("café") == set()


def test_precedence():
    cut = lambda w: [w] if w != "_" else []
    show = lambda m: str(m.phrase) if m.kind == "phrase" else m.kind + "(" + ",".join(map(show, m.parts)) + ")"
    for text, want in (("a b OR c", "OR(AND(0,1),2)"), ("a AND b OR c NOT d e", "OR(AND(0,1),NOT(2,AND(3,4)))"), ("a NOT b NOT c", "NOT(0,1,2)"), ("a _", "0"), ("_ OR a", "OR(none(),0)")):
        assert show(match.parsed(text, cut)[1]) == want
    for bad in ("a AND", "OR", "a OR OR b", "NOT a"):
        with pytest.raises(match.Malformed):
            match.parsed(bad, cut)


def test_a_running_index_can_be_stopped(spark, tmp_path):
    """Jobs at work are cancelled within seconds, the store stays as it was, and listeners heard of the phases."""
    from lodestone.sources import adapters
    from lodestone.streaming.changes import Reporter

    def slow(text):
        import time

        time.sleep(1.5)
        return []

    for i in range(60):
        put(tmp_path, f"src/m{i}.slow", f"x {i}\n")
        put(tmp_path, f"src/n{i}.py", f"x = {i}\n")
    store = Store(spark, str(tmp_path / "store"))
    real, heard, reporter = adapters.PARSERS["py"], [], Reporter()
    reporter.listeners.append(heard.append)
    adapters.register("py", slow)
    began = time.monotonic()
    try:
        # 60 files of 1.5 s each on 4 cores take more than 20 s.
        done = api.index(spark, str(tmp_path / "src"), store, stop=lambda: any(p.phase == "embedding" and p.total for p in heard), reporter=reporter)
    finally:
        adapters.register("py", real)
    assert done["mode"] == "stopped" and time.monotonic() - began < 20
    assert not store.manifest["number"] and not store.has("chunks") and {p.phase for p in heard} == {"scanning", "embedding"}
    left = lambda: [p for p in (tmp_path / "store").iterdir() if p.name.startswith(("manifest", "chunks", "passing"))]
    end = time.monotonic() + 4 * api.LEFT_S
    while left() and time.monotonic() < end:
        time.sleep(0.5)
    assert not left()
    del heard[:]
    assert api.index(spark, str(tmp_path / "src"), store, reporter=reporter)["added"] == 120
    assert [p.phase for p in heard if not p.total] == ["scanning", "embedding", "building_fts", "ready"]


def test_the_graph_is_stored_and_follows(spark, tmp_path):
    """Nodes and edges change with their files; a node's neighbours come from a scan of its own edges; symbols contain those inside them."""
    src = tmp_path / "src"
    put(src, "pkg/a.ts", "import { b } from './b'\nexport { c } from './c'\nexport function f() {\n  return 1\n}\n")
    put(src, "pkg/b.ts", "export class B {\n}\n")
    put(src, "doc.json", '{\n  "outer": {\n    "inner": 1\n  }\n}\n')
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(src), store)
    edges = lambda g: {(r.source, r.type, r.target) for r in g[1].collect()}
    g = api.graph_tables(spark, store)
    assert ("kg:file:pkg/a.ts", "imports", "kg:file:pkg/b.ts") in edges(g) and ("kg:folder:pkg", "contains", "kg:file:pkg/a.ts") in edges(g) and ("kg:workspace", "contains", "kg:folder:pkg") in edges(g)
    put(src, "pkg/c.ts", "export const c = 1\n")
    put(src, "pkg/a.ts", "import { b } from './b'\nexport { c } from './c'\nexport function g() {\n  return 1\n}\n")
    (src / "doc.json").unlink()
    api.index(spark, str(src), store)
    again = Store(spark, str(tmp_path / "again"))
    api.index(spark, str(src), again)
    g, fresh = api.graph_tables(spark, store), api.graph_tables(spark, again)
    assert len(store.manifest["segments"]) == 2
    assert edges(g) == edges(fresh) and sorted(map(str, g[0].collect())) == sorted(map(str, fresh[0].collect()))
    assert ("kg:file:pkg/a.ts", "exports", "kg:file:pkg/c.ts") in edges(g)
    near = api.get_node(g, "kg:file:pkg/a.ts")
    assert {(r.edge_type, r.id) for r in near.collect()} == {(r.edge_type, r.id) for r in graph.neighbors(*fresh, "kg:file:pkg/a.ts").collect()}
    assert "EqualTo(at,kg:file:pkg/a.ts)" in g.around.filter(F.col("at") == "kg:file:pkg/a.ts")._jdf.queryExecution().toString()
    r = api.status(store).first()
    assert r.n_nodes == store.count("graph_nodes") > 3 and r.n_edges * 2 == store.count("graph_edges")


def test_symbols_contain_symbols(spark, tmp_path):
    text = '{\n  "outer": {\n    "inner": 1,\n    "more": 2\n  },\n  "last": 3\n}\n'
    put(tmp_path, "src/a.json", text)
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(tmp_path / "src"), store)
    labels = {r.symbol for r in store.read("chunks").collect()}
    got = {(r.source.rsplit(":", 1)[1], r.target.rsplit(":", 1)[1]) for r in api.graph_tables(spark, store)[1].filter("type = 'contains' AND source LIKE 'kg:sym:%'").collect()}
    assert got == {(a, b) for a, b in (("outer", "inner"), ("outer", "more")) if {a, b} <= labels}


class Failing:
    dimension = 8

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no model")
        return [[1.0] + [0.0] * 7 for _ in texts]


def test_what_fails_degrades(spark, tmp_path):
    """A provider that fails gives zero vectors and leaves the keywords; settings say how many results come; each chunk tells when and by which model it was made."""
    for i in range(5):
        put(tmp_path, f"src/m{i}.md", f"zebra {'bad' if i == 3 else ''} {i}\n")
    store = Store(spark, str(tmp_path / "store"))
    api.index(spark, str(tmp_path / "src"), store, provider=Failing())
    vectors = {r.vec_id.split(":")[0]: list(r.embedding) for r in store.read("vectors").collect()}
    assert len(vectors) == 5 and vectors["m3.md"] == [0.0] * 8
    assert api.search(spark, store, "zebra", provider=Failing()).count() == 5
    found = api.search(spark, store, "zebra bad", provider=Failing()).collect()
    assert [(r.file, r.match_type) for r in found] == [("m3.md", "keyword")]
    assert api.search(spark, store, "zebra", config=Config(max_results=2, rerank=False), provider=Failing()).count() == 2
    made = store.read("made").collect()
    assert len(made) == 5 and {r.model for r in made} == {"balanced"} and all(r.last_indexed for r in made)


def test_gathered_postings(spark):
    """What is shuffled for the index is a row for many postings, of a frequent term too; spread again they are the postings of the texts."""
    rows = [(i, f"of the {'w' + str(i % 7)} of" if i % 10 else None) for i in range(3000)]
    blocks = inverted.gathered(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", [F.col("text")], "plain").cache()
    want = set()
    for i, text in rows:
        words = (text or "").split()
        want |= {(w, i, len(words), words.count(w), tuple(k for k, x in enumerate(words) if x == w)) for w in words} or {("", i, 0, 0, ())}
    for made in (inverted.spread(blocks), inverted.clustered(blocks), inverted.clustered_few(blocks)):
        got = [(r.term, r.id, r.dl, r.tf, tuple(r.positions)) for r in made.collect()]
        assert len(got) == len(want) and set(got) == want
    assert [r.term for r in inverted.clustered_few(blocks).collect()] == sorted(w[0] for w in want)
    assert blocks.count() * 20 < len(want) and blocks.select(F.max(F.size("ids"))).first()[0] == inverted.BLOCK
    assert {r.term: r.df for r in inverted.terms(blocks).collect()} == {r.term: r.df for r in inverted.terms(inverted.spread(blocks)).collect()}
    assert inverted.sizes(blocks) == inverted.sizes(inverted.spread(blocks)) == (3000, 2700 * 4)
    assert inverted.totals(blocks).first() == inverted.totals(inverted.spread(blocks)).first() == (3000, 3.6)
    blocks.unpersist()
