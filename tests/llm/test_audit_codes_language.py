"""Filter audit, vector codes and language mixtures: against plain versions."""

import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, language_id, vector_codes
from lodestone.llm.common import unstage

from . import plain


def audited(docs, labels):
    """The contract, one document and order at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    failed = []
    for d, t, lang in docs:
        t = t or ""
        w = plain.WORDS.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > firsts[t]}
        failed.append((lang or "", {c for c, x in f.items() if x}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                own = [(f, g, x) for p, f, g, x in failed if p == part]
                gone = [(f, g, x) for f, g, x in own if c in f and not f & before]
                out[part, order, step] = [sum(not f & (before | {c}) for f, *_ in own), len(gone), sum(c in f and bool(f & before) for f, *_ in own), sum(f == {c} for f, *_ in own), sum(g for _, g, _ in gone), sum(x for *_, x in gone)]
    for part, c in {(p, o[s - 1]) for p, o, s in out}:
        steps = [k for k in out if k[0] == part and k[1][k[2] - 1] == c]
        total = sum(out[k][1] for k in steps)
        for k in steps:
            out[k].append(total)
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit_equals_plain(spark):
    """Nulls, repeats, copies over parts, repeated labels, and a column whose name differs in case only."""
    rows = [r[:3] for r in plain.MESSY] + [(20 + i, "Word%d UPPER " % (i % 3) * (90 + i), ["en", "de", ""][i % 3]) for i in range(12)] + [(9, "x " * 300, "en"), (8, "x " * 300, "de"), (None, "x " * 300, "en"), (8, "x " * 300, "de"), (8, "x " * 300, "en")]
    labels = [(1, 1, 0), (1, 0, 1), (8, 1, 1), (9, None, 1), (None, 1, 1), (21, 1, 0), (22, 0, 0)]
    docs = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, lang string, Text string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(docs, lab)
    assert got.columns == names and sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), lab).count() == 0
    none = filter_audit.audit(docs, lab.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none) == (0, 0, 600 * len({r[2] or "" for r in rows}))


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(i, "abcdef"[: i % 4], "x") for i in range(40)], "doc_id int, text string, lang string")
    lab = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    got = filter_audit.audit(docs, lab, {"S": lambda text, words: F.length(text) < 2}, "R")
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()) == [
        ("RS", 1, 4, 36, 0, 18, 54), ("RS", 2, 2, 2, 18, 2, 22), ("SR", 1, 20, 20, 0, 2, 22), ("SR", 2, 2, 18, 18, 18, 54)
    ]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, lab, {"R": lambda text, words: F.lit(True)}, "R")


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Codes and errors with Python's integers, comparing every part with every entry."""
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in ok]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, r[1]))[:entries]
    w = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in ints:
                members.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out = []
    for i, v, label in ints:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("case", ["spread", "ties", "few", "wide"])
def test_vector_codes_equal_plain_lloyd(spark, monkeypatch, case):
    rng = np.random.default_rng(5)
    n = {"few": 7}.get(case, 300)
    v = rng.normal(size=(n, 16)) * {"wide": 900.0}.get(case, 0.1)
    if case == "ties":  # few different values: many equal distances and equal vectors
        v = rng.integers(-2, 3, size=(n, 16)) / 4096
    rows = [(int(i * 7 % 311) if i % 13 else int(i // 26), [float(np.float32(x)) for x in r], None if i % 5 == 0 else i % 3) for i, r in enumerate(v)]
    rows += [(3, None, 1), (900, [0.1] * 15 + [None], 1), (901, [float("nan")] + [0.0] * 15, 2), (902, [float("inf")] + [0.0] * 15, 2), (None, [0.25] * 16, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, Label string").repartition(3)
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert plain.rows(got) == lloyd(rows)


def test_vector_codes_skip_groups(spark, sf):
    """Bounds spare scans: the later rounds compute a part of all distances; and each row of a group that is skipped keeps its nearest entry."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    state, books, small = vector_codes.train(vector_codes.kept(e))
    n = state.agg(F.sum(F.size("ids")).alias("n"), F.sum("scanned").alias("s")).first()
    assert n.s < 0.8 * n.n * 8 * 16
    unstage(state)
    rng = np.random.default_rng(2)
    x, c = rng.integers(-300, 300, (4000, 4)), rng.integers(-300, 300, (16, 4))
    books = vector_codes.Codebooks.start(c[None])
    code, _, bounds, _ = vector_codes.assign(x, c, books.group[0], books.drift[0], None, None)
    scanned = []
    for _ in range(8):
        sums, counts = vector_codes._sums(x, code, 16)
        books = books.moved(sums[None], counts[None])
        code, best, bounds, k = vector_codes.assign(x, books.entries[0], books.group[0], books.drift[0], code, bounds)
        d = ((x[:, None] - books.entries[0]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        scanned.append(k)
    assert scanned[-1] < 0.5 * 4000 * 16


def test_vector_codes_of_odd_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(df).count() == 0 and vector_codes.compress(spark.createDataFrame([(1, None, 1)], df.schema)).count() == 0
    for bad in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, df.schema))
    none = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], df.schema)).collect()
    assert [(r.code, r.error) for r in none] == [("00" * 8, 0)] * 2 and none[0].codebooks_sha256 == plain.sha("")
    one = vector_codes.compress(spark.createDataFrame([(None, [0.5] * 8, None)], df.schema)).first()
    assert one.code == "00" * 8 and one.error == 0 == one.label_error


def test_trigrams_of_pieces(monkeypatch):
    """Whole texts, piece by piece: the same cells; one for each letter."""
    texts = ["", "123 ...", "a", "Ab cd", "Éa é ñ 𝄞 word " * 40, "x" * 300 + " ЖЖ 漢字", "İi" * 90, None, "\ud800 lone"]
    whole = [language_id.cells(t) for t in texts]
    for t, (_, n) in zip(texts, whole, strict=True):
        assert n.sum() == sum(c.isalpha() for c in (t or "").lower())
    for size in (1, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", size)
        for t, (c, n) in zip(texts, whole, strict=True):
            again = language_id.cells(t)
            assert again[0].tolist() == c.tolist() and again[1].tolist() == n.tolist()


def test_mixture_equals_plain_em():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, (language_id.CELLS, 3)).astype(float) * (rng.random((language_id.CELLS, 3)) < 0.02)
    m = language_id.Model.of(["a", "b", "c"], counts)
    docs = []
    for mix in ((1, 0, 0), (0.5, 0.5, 0), (0, 0.2, 0.8), (0.34, 0.33, 0.33)):
        p = counts / counts.sum(0) @ np.array(mix)
        docs.append(np.unique(rng.choice(language_id.CELLS, 3000, p=p), return_counts=True))
    docs.append((np.zeros(0, int), np.zeros(0, int)))
    got = language_id.mixtures(m, docs)
    assert [sorted(i for i, _ in g) for g in got] == [[0], [0, 1], [1, 2], [0, 1, 2], []]
    for (cell, n), found, mix in zip(docs[:-1], got, ((1, 0, 0), (0.5, 0.5, 0), (0, 0.2, 0.8), (0.34, 0.33, 0.33)), strict=False):
        langs = [i for i, _ in found]
        share = {i: 1 / len(langs) for i in langs}
        for _ in range(200):
            new = dict.fromkeys(langs, 0.0)
            for c, k in zip(cell, n, strict=True):
                total = sum(share[i] * m.likelihood[c, i] for i in langs)
                for i in langs:
                    new[i] += k * share[i] * m.likelihood[c, i] / total
            share = {i: v / n.sum() for i, v in new.items()}
        assert all(abs(share[i] - s) < 0.01 and abs(share[i] - mix[i]) < 0.05 for i, s in found)
    # What a document is fitted with does not matter.
    assert got == [language_id.mixtures(m, [d])[0] for d in docs]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


def test_language_id_held_out(spark, documents):
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert share.a > 0.99 and share.n > 1500 and got.count() == documents.count()
    bad = got.filter("score < 0 OR score > 1 OR held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)")
    assert bad.count() == 0


def test_two_languages_in_one_document(spark, documents):
    """Texts of two languages, one after the other, need both; the larger part is the language."""
    of = lambda lang: [r.text for r in documents.filter(f"lang = '{lang}' AND n_chars BETWEEN 1000 AND 3000 AND doc_id < 3000").orderBy("doc_id").limit(40).collect()]
    model = language_id.learn(documents)
    for one, other in (("de", "fr"), ("es", "en")):
        docs = [language_id.cells(a + "\n" + b[: len(a) // 2]) for a, b in zip(of(one), of(other), strict=True)]
        found = [[model.languages[i] for i, _ in x] for x in language_id.mixtures(model, docs)]
        assert np.mean([f[:2] == [one, other] for f in found]) >= 0.9


def test_language_labels_of_held_out_rows_do_not_matter(spark, documents):
    docs = documents.filter("doc_id < 600")
    other = docs.withColumn("lang", F.expr("CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 'xx' ELSE lang END"))
    assert plain.rows(language_id.identify(docs.repartition(3))) == plain.rows(language_id.identify(other))


def test_language_id_of_messy_tables(spark):
    docs = spark.createDataFrame([(*r, "z") for r in plain.MESSY], plain.SCHEMA + ", TEXT string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(plain.MESSY)
    for r, d in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(plain.MESSY, key=lambda r: repr(r[0])), strict=True):
        assert r.doc_id == d[0] and (r.lang_pred == "und") == (not any(c.isalpha() for c in d[1] or "")) and (r.lang_pred != "und" or r.score == 0)
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0
