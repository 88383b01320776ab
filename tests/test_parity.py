"""Every query that SQL can express gives the same rows in Spark and in DuckDB; the others give rows."""

import math

import duckdb
import pytest

from parchmint.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return "null" if v is None else str(v)


ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    assert len(set(columns)) == len(columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = lambda rs: sorted([plain(x) for x in r] for r in rs)
    assert rows(tuple(r) for r in found.select(*columns).collect()) == rows(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES) - {"flagship"}))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
