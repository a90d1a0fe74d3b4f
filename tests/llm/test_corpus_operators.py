"""SimHash, WARC, decontamination, sharding: against plain versions."""

import glob
import json
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import components, decontaminate, sharding, simhash, vptree, warc

from . import plain


def test_vptree_links_dense_and_sparse():
    rng = np.random.default_rng(3)
    sparse = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    centre = np.uint64(12345678901234)
    dense = np.unique(np.array([int(centre) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(2500)], np.uint64))
    points = np.unique(np.concatenate([sparse, dense]))
    for leaf in (200, 10_000):
        pairs = []
        for half in vptree.HALVES:
            tree = vptree.fit(points[::3], len(points), leaf, 3, half)
            at, i, home = vptree.route(tree, points, 3, half)
            assert sorted(i[home]) == list(range(len(points)))
            for x in np.unique(at):
                m = at == x
                a, b, _ = vptree.leaf_links(points[i[m]], home[m], 3, half)
                assert np.all(points[i[m]][a] != points[i[m]][b])
                pairs += zip(i[m][a].tolist(), i[m][b].tolist(), strict=True)
        assert _partition(len(points), pairs) == _partition(len(points), _all_pairs(points))


def test_vptree_prunes():
    """Of unrelated fingerprints, where pruning is hardest, few pairs are compared and few guests made; links over any border are found."""
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 2**64 - 1, 60_000, dtype=np.uint64))
    moved = np.array([int(p) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for p in points[::100]], np.uint64)
    points = np.unique(np.concatenate([points, moved]))
    pairs, rows, compared = set(), 0, 0
    for half in vptree.HALVES:
        at, i, home = vptree.route(vptree.fit(points[::7], len(points), 2000, 3, half), points, 3, half)
        rows += len(at)
        for x in np.unique(at):
            m = at == x
            a, b, c = vptree.leaf_links(points[i[m]], home[m], 3, half)
            compared += c
            pairs |= {frozenset(p) for p in zip(points[i[m]][a].tolist(), points[i[m]][b].tolist(), strict=True)}
    assert len(pairs) >= 600 and rows < 8 * len(points) and compared < len(points) ** 2 / 12


def _all_pairs(p):
    out = []
    for s in range(0, len(p), 500):
        a, b = np.nonzero(np.bitwise_count(p[s : s + 500, None] ^ p[None, :]) <= 3)
        out += [(x + s, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x + s < y]
    return out


def _partition(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(5)
    e = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = _partition(2100, e)
    assert all(got[x] == want[x] for x in got) and set(got) == {x for p in e if p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_tables(spark, sf):
    messy = spark.createDataFrame(plain.MESSY, plain.SCHEMA)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (messy, real):
        own = [(r.doc_id, r.text) for r in df.collect()]
        assert plain.rows(simhash.near_duplicates(df)) == sorted(plain.near(own), key=repr)
    assert simhash.near_duplicates(messy.limit(0)).count() == 0
    kept = simhash.keep_one(real)
    assert kept.columns == real.columns
    assert plain.rows(kept.select("doc_id")) == sorted({(c,) for _, _, c in plain.near([(r.doc_id, r.text) for r in real.collect()])}, key=repr)
    assert simhash.keep_one(messy).count() == len({c for _, _, c in plain.near([(r[0] if r[0] is not None else -1, r[1]) for r in plain.MESSY])})


def test_simhash_shared_tree(spark, sf, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "UNIQUE_BYTES", -1)
    monkeypatch.setattr(common, "HOT", 50)
    monkeypatch.setattr(simhash, "LEAF_MOST", 7)
    monkeypatch.setattr(simhash, "OTHERS_MOST", 11)
    monkeypatch.setattr(simhash, "SLAB", 255)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    own = [(r.doc_id, r.text) for r in real.collect()]
    assert plain.rows(simhash.near_duplicates(real)) == sorted(plain.near(own), key=repr)
    assert plain.rows(simhash.keep_one(real).select("doc_id")) == sorted({(c,) for _, _, c in plain.near(own)}, key=repr)


def test_hot_keys_apart(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "UNIQUE_BYTES", -1)
    left = common.stage(spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, v long"), "left")
    right = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = plain.rows(common.join_unique(left, right, "k", 1))
    assert got == sorted(((k, v, 2 * k) for k, v in ((1 if i % 3 else i, i) for i in range(3000)) if k < 2000), key=repr)
    with common.passing(spark) as keep:
        a, b = common.stage(right, "a"), keep(common.stage(right, "b"))
    assert b.count() == 2000
    import pytest

    with pytest.raises(Exception):
        a.count()


PAGES = [(3, "http://a/1", "x" * 200), (1, "http://a/2", "x" * 200), (2, None, "short"), (5, "u\r\nv", "short"), (4, "http://a", None), (None, "n", "x" * 200), (6, "é", "é" * 60), (7, "é", "é" * 60), (7, "é", "é" * 60)]


def test_warc_table(spark):
    got = plain.rows(warc.round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))))
    first = {"x" * 200: 1, "é" * 60: 6}
    want = []
    for p, _, h in PAGES:
        to = first.get(h or "")
        to = None if to is None or to == p else to
        want.append((p, len((h or "").encode()), plain.sha(h or ""), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_frames(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archives = warc.write(spark, pages)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.lookup(archives, [7, 11]).collect()} == {r.page_id: r.html for r in pages.filter("page_id in (7, 11)").collect()}
    warc.export(archives, str(tmp_path)).collect()
    data = open(glob.glob(f"{tmp_path}/*.warc.zst")[0], "rb").read()
    table = warc.seek_table(data)
    assert b"".join(warc.frame(data, table, i) for i in range(len(table))).startswith(b"WARC/1.1\r\n")
    packed = warc.pack([b"a" * 10, b"b" * 20])
    assert [warc.frame(packed, warc.seek_table(packed), i) for i in (1, 0)] == [b"b" * 20, b"a" * 10]


def test_warc_lookup_and_export(spark, tmp_path, monkeypatch):
    """Nulls, repeats, long payloads and empty tables; an exported file is sought by its record index."""
    long = "lorem ipsum " * 800_000
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, None, None), (None, "u", "n" * 150), (4, "u", long), (5, "u", "twice"), (5, "v", "again")], "page_id long, url string, html string")
    archives = warc.write(spark, pages)
    got = sorted((r.page_id, bytes(r.payload).decode()) for r in warc.lookup(archives, [1, 2, 3, 4, 5, 99]).collect())
    assert got == [(1, "x" * 200), (3, ""), (4, long), (5, "again"), (5, "twice")]
    assert warc.lookup(archives, []).count() == 0 and warc.lookup(archives.limit(0), [1]).count() == 0
    warc.export(archives, str(tmp_path / "out")).collect()
    assert warc.export(archives.limit(0), str(tmp_path / "none")).count() == 0
    seen = 0
    for path in glob.glob(f"{tmp_path}/out/*.json"):
        data = open(path.removesuffix(".json") + ".warc.zst", "rb").read()
        table = warc.seek_table(data)
        for name, (i, at, n) in json.load(open(path)).items():
            r = warc.parse(warc.frame(data, table, i)[at : at + n])
            assert name.endswith(f":{'' if r['page_id'] is None else r['page_id']}")
            seen += 1
    assert seen == 6  # the two records of page 5 share a name
    from lodestone.llm import common

    monkeypatch.setattr(common, "UNIQUE_BYTES", -1)
    assert warc.round_trip(pages).filter("record_type = 'revisit'").select("page_id", "payload_bytes").collect() == [(2, 200)]


def test_sharding_without_ids(spark):
    rows = [(None, f"text {i % 50}", "s") for i in range(400)] + [(i, None, None) for i in range(30)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 430 and sorted(Counter(r.shard for r in got).values()) == [53, 53] + [54] * 6


ITEMS = [(1, "the cat sat on the mat the cat sat on the mat"), (2, "line one of it"), (2, "other line here line"), (3, None), (4, "..."), (None, "two words"), (5, "absent terms zzzz"), (6, "Éa é ñ"), (7, "the cat sat on the mat the cat sat on the mat the")]


def test_contamination_tables(spark, sf):
    messy, items = spark.createDataFrame(plain.MESSY, plain.SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    named = [(i, t) for i, t in ITEMS]
    want = []
    for d, t, *_ in plain.MESSY:
        n, hit, ids = plain.contamination(t, named)
        ids = [i for i in ids if i != "None"]
        want.append((d, n, hit, len(ids), plain.sha(",".join(ids)), hit > 0))
    required = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert plain.rows(decontaminate.contamination(messy, items).select(required)) == sorted(want, key=repr)
    assert decontaminate.contamination(messy.limit(0), items).count() == 0
    assert decontaminate.contamination(messy, items.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(messy, items)
    assert kept.columns == messy.columns and kept.count() == sum(not w[-1] for w in want)


def test_contamination_without_broadcast(spark, sf, monkeypatch):
    from lodestone.llm import common

    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    one = plain.rows(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert plain.rows(decontaminate.contamination(docs, bench)) == one


NEAR = [(1, "a b c d e f"), (2, "a x x b x c d"), (3, "a x x x b c d"), (4, "b a d c"), (4, "b a d c"), (5, "d c b a"), (None, "z a b c d"), (6, None), (7, ""), (8, "a b c d a b c d"), (9, "a b c")]


def test_proximity(spark, monkeypatch):
    """Every word of an item within two words of where the phrase would have it, seen from its rarest word (the first of equally rare ones)."""
    docs, item = [(d, t) for d, t in NEAR], "a b c d"
    phrases = [("p", item), ("none", "a b c q"), (None, "c d"), ("empty", ""), ("null", None), ("p", item)]
    counts = Counter(w for _, t in docs for w in (t or "").split())

    def near(text, item, slop=2):
        w, b = (text or "").split(), item.split()
        if not b or not all(counts[x] for x in b):
            return False
        o = min(range(len(b)), key=lambda j: (counts[b[j]], j))
        return any(x == b[o] and all(any(y == b[j] and abs((q - j) - (p - o)) <= slop for q, y in enumerate(w)) for j in range(len(b))) for p, x in enumerate(w))

    want = sorted(((d, plain.sha("p" if near(t, item) else "")) for d, t in docs), key=repr)
    df, items = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tid", F.lit(1)), spark.createDataFrame(phrases, "item_id string, text string")
    assert len({h for _, h in want}) == 2 and sum(h == plain.sha("p") for _, h in want) > sum(item in (t or "") for _, t in docs)
    from lodestone.llm import common

    for _ in range(2):
        got = decontaminate.contamination(df, items)
        assert plain.rows(got.select("doc_id", "near_items_sha256")) == want
        assert got.filter("n_near_items < n_items").count() == 0
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert decontaminate.contamination(df.limit(0), items).count() == 0
    assert decontaminate.contamination(df, items.limit(0)).filter("n_near_items > 0").count() == 0


def test_sharding(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (real, spark.createDataFrame(plain.MESSY, plain.SCHEMA)):
        rows = sharding.interleave(df).collect()
        n = len(rows)
        assert n == df.count()
        by = Counter(r.shard for r in rows)
        assert max(by.values()) - min(by[s] for s in range(8)) <= 1
        for s in by:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
        whole = Counter(r.source for r in rows)
        for s in by:
            here = Counter(r.source for r in rows if r.shard == s)
            assert all(abs(here[k] - whole[k] * by[s] / n) <= 2 for k in whole)
    assert sharding.interleave(real.limit(0)).count() == 0
    assert plain.rows(sharding.interleave(real)) == plain.rows(sharding.interleave(real.repartition(5)))
