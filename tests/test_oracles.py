"""Registered queries against their SQL, over the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from helixframe.plans.oracles import ORACLES
from helixframe.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, query, sql, data=DATA):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = query(spark, str(data))
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(str([r[n] for n in sorted(names)]) for r in df.collect())
    order = [names.index(n) for n in sorted(names)]
    assert got == sorted(str([r[i] for i in order]) for r in result.fetchall())
    assert got


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])
