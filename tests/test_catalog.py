"""Every query of the engine's catalog against its DuckDB SQL."""

import os
import re
import warnings

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as e

    real = e.import_module

    def without(missing: str, of: str):
        def imported(n):
            if n.startswith(of):
                raise ModuleNotFoundError("gone", name=missing)
            return real(n)

        return imported

    monkeypatch.setattr(e, "import_module", without("lodestone.llm", "lodestone.llm"))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert "kw_bm25_topk" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
    # A library that only the training-data operators need is not installed: said, and the other queries work.
    monkeypatch.setattr(e, "import_module", without("zstandard", "lodestone.llm"))
    with pytest.warns(UserWarning, match="left out"):
        assert "kw_bm25_topk" in e.queries() and "kw_bm25_topk" in e.oracle_sql()


def test_nothing_imports_llm():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(top, "lodestone")):
        if "llm" not in os.path.relpath(folder, top).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read())
