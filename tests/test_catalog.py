"""Every query that SQL can express gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from pagelift.plans import catalog, markup, more, pages, parts, replay, words  # noqa: F401  (register further queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows(spark, views, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = views.execute(catalog.ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == names
    want = sorted(map(repr, (tuple(dict(zip((d[0] for d in cur.description), r, strict=True))[c] for c in names) for r in cur.fetchall())))
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
