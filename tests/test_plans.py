"""Every plan with an oracle against DuckDB, at the smallest scale."""

import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from studymill.plans.plan import SOURCES, in_dialect

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in SOURCES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_markers_nest():
    assert in_dialect("SIZE(WORDS(SWAP(a, '[,(]', ' ')))", 0) == "CAST(size(filter(split(regexp_replace(a, '[,(]', ' '), ' '), x -> x <> '')) AS BIGINT)"
    assert glob.glob(f"{SF}/*.parquet")
