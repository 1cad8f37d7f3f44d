"""The registered queries against their SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = db.sql(entry.oracle_sql()[name])
    assert names == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in names)
    rows = [tuple(map(plain, r)) for r in db.sql(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()]
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_flagship(spark):
    assert entry.entry(spark).columns == ["lang", "type", "spans", "docs"]


def test_streams(spark):
    q = entry.queries()
    assert q["stream_vault"](spark, SF).count() > 0


def test_runs_are_over_the_whole_plan(spark):
    strata = {r.stratum: r for r in entry.queries()["corpus_strata"](spark, SF).collect()}
    assert sum(r.value for k, r in strata.items() if k.startswith("family:")) == 314
    assert all(strata[f"family:{f}"].ok for f in ("create_order", "decompose", "refund"))
