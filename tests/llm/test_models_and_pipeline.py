"""The trained classifiers by held-out accuracy; the pipeline against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import pii, quality_gam, quality_rules, toxicity

from . import plain


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_gam(spark, tables):
    docs, labels = tables
    got = quality_gam.classify(docs, labels)
    held = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    order = held["score"].rank()
    y = held["quality"] == 1
    auc = (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.98 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert got.count() == docs.count()


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels = (t.filter("doc_id < 1500") for t in tables)
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert plain.rows(quality_gam.classify(docs, labels)) == plain.rows(quality_gam.classify(docs, other))


def test_toxicity(spark, tables):
    docs, labels = tables
    held = toxicity.grade(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    y = held["toxic"] == 1
    assert held["predicted"][y].mean() >= 0.9 and held["predicted"][~y].mean() < 0.02
    assert held["severity"].between(0, 3).all() and held["severity"][y].mean() > 10 * held["severity"][~y].mean()


def test_toxicity_scores_by_hand(spark, tables):
    """Scores of a table against the formulas, written out for one text at a time."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    assert model.weights and list(model.cuts) == sorted(model.cuts)
    for r, t in zip(toxicity.grade(docs, labels).filter("doc_id < 400").orderBy("doc_id").collect(), docs.filter("doc_id < 400").orderBy("doc_id").collect(), strict=True):
        found = re.findall(r"[^\W\d_]+", t.text.lower())
        features = Counter(f for w in found for f in [w] + [w[:k] + "~" for k in (5, 7) if len(w) > k])
        leaning = sum(any(f in model.lean and f in model.weights for f in [w] + [w[:k] + "~" for k in (5, 7) if len(w) > k]) for w in found)
        x = sum(w * math.log(1 + features[f]) for f, w in model.weights.items()) + model.density * math.log(1 + 100 * leaning / max(1, len(found)))
        above = [1 / (1 + math.exp(-(x - c))) for c in model.cuts]
        assert r.doc_id == t.doc_id and abs(r.score - above[0]) < 1e-9 and abs(r.severity - sum(above)) < 1e-9 and r.predicted == (above[0] >= 0.5)


def test_quality_scores_by_hand(spark, tables):
    docs, labels = tables
    docs = docs.filter("doc_id < 400")
    model = quality_gam.train(docs, labels)
    for r, t in zip(quality_gam.classify(docs, labels).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        x = quality_gam.measure(t.text)
        place = [sum(c < v for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
        margin = model.start + sum(table[p] for table, p in zip(model.single, place, strict=True)) + sum(table[place[i]][place[j]] for i, j, table in model.pairs)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, margin))))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_sample_is_bounded(spark):
    """Repeated documents and labels count once, so the bound holds."""
    docs = spark.createDataFrame([(2, "b"), (2, "a"), (2, None), (4, "c")] * 30 + [(None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0), (2, 1), (4, 0), (4, None), (None, 1), (9, 1)] * 3, "doc_id long, quality int")
    kept = [d for d in (2, 4, 9) if quality_gam.fold(d) != 1]
    got = {r.doc_id: (r.text, r.y) for r in quality_gam.sample(docs, labels, "quality").collect()}
    assert got == {d: v for d, v in {2: ("", 1), 4: ("c", 0)}.items() if d in kept}
    assert quality_gam.sample(docs, labels, "quality", 1).count() <= 1


def test_grades_need_both_parts():
    share, toxic = np.array([0.0, 0.1, 0.2, 0.3, 0.9, 0.9]), np.array([0, 1, 1, 1, 0, 1])
    assert toxicity.grades(share, toxic).tolist() == [0, 1, 1, 2, 0, 3] and not toxicity.grades(share, toxic * 0).any()


def test_models_on_messy_tables(spark):
    docs = spark.createDataFrame(plain.MESSY, plain.SCHEMA)
    for labels in ([(1, 1, 0), (2, 0, 1), (4, 0, 0), (None, 1, 1), (7, None, None), (8, 0, 1)], []):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for f in (quality_gam.classify, toxicity.grade):
            got = f(docs, lab).collect()
            assert len(got) == len(plain.MESSY) and all(0 <= r.score <= 1 for r in got)
            assert f(docs.limit(0), lab).count() == 0


def test_cumulative_link_is_ordered():
    rng = np.random.default_rng(1)
    texts = [["good"] * 20 + ["bad", "vile"] * int(k) + [f"w{rng.integers(50)}" for _ in range(30)] for k in rng.choice(4, 1500, p=(0.85, 0.05, 0.05, 0.05))]
    toxic = np.array([int("bad" in t) for t in texts])
    seen: dict = {}
    for i, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        for f in toxicity.contexts(t):
            seen.setdefault(f, [0, 0])[y] += 1
    terms, lean = toxicity.leaning({f: tuple(c) for f, c in seen.items()}, tuple(map(sum, zip(*seen.values(), strict=True))))
    assert {"bad", "vile"} <= lean
    place = {f: i for i, f in enumerate(terms)}
    m = toxicity.fit([toxicity.row(". ".join(t), place, lean) for t in texts], toxic, terms, lean)
    assert list(m.cuts) == sorted(m.cuts)
    p = m.probabilities(np.array([m.margin("good day"), m.margin("bad vile " * 3)]))
    assert np.allclose(p.sum(1), 1) and p[1] @ np.arange(4) > p[0] @ np.arange(4) + 0.5


def test_pipeline(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string")).filter("kept").collect()}
    docs = [d for d in docs if d[0] in good]
    assert all(not plain.quality(t)[-1] for _, t in docs)
    firsts = {c for _, _, c in plain.near(docs)}
    docs = [d for d in docs if d[0] in firsts and not plain.contamination(d[1], items)[1]]
    model = pii.train()
    want = []
    for d, t in docs:
        base, added = pii.find(t, model)
        want.append((d, plain.sha(pii.redact_text(t, base + added))))
    got = corpus_pipeline.run(spark, sf)
    assert plain.rows(got.select("doc_id", "decoded_sha256")) == sorted(want, key=repr)


def test_stages_on_messy_tables(spark, sf):
    docs = spark.createDataFrame(plain.MESSY, plain.SCHEMA)
    for df in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, df, sf).columns == docs.columns
            f(spark, df, sf).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()
