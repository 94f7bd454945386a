"""Every query with SQL gives DuckDB's rows on the shared tables; the others run and keep their properties."""

import os

import duckdb
import pytest

from weftspark.plans.registry import oracle_sql, queries
from weftspark.sources.tables import TABLE_NAMES

SF = os.environ.get("WEFT_TEST_SF", "/root/testdata/sf0.001")


def rounded(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    told = duck.sql(oracle_sql()[name])
    assert columns == sorted(told.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_others_run(spark, name):
    assert queries()[name](spark, SF).count() > 0
