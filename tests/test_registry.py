"""Every query with SQL gives the SQL's rows on the smallest test tables."""

import math
import os

import duckdb
import pytest

from lakeaudit.jobs.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6g}" if math.isfinite(float(v)) and not isinstance(v, str) else str(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
