"""Every registered query of the library itself against its SQL."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from scriptorium import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted("|".join(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted("|".join(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_llm(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def gone(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("scriptorium.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", gone)
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("scriptorium.llm")]:
        monkeypatch.delitem(sys.modules, m)
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
