"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from posttrain_spark.plans.base import sql_r6

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(dicts):
    return sorted(str(sorted((k, str(normal(v))) for k, v in d.items())) for d in dicts)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = [r.asDict() for r in entry.queries()[name](spark, str(DATA)).collect()]
    r = duck.sql(entry.oracle_sql()[name])
    assert rows(got) == rows(dict(zip(r.columns, x, strict=True)) for x in r.fetchall())


def test_six_digits_as_sql_rounds(spark, duck):
    """Overlaps whose seventh digit is a lone 5, among others."""
    scores = [j / u * s / n for u in range(1, 129) for n in range(1, 1300, 7) for j, s in ((1, 1), (1, 3), (3, 7)) if j <= u and s <= n and 2 * 10**6 * j * s % (u * n) == 0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in scores], "s double").select(sql_r6("s")).collect()]
    assert got == [duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in scores]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
