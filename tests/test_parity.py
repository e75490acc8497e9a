"""Every registered query with SQL against DuckDB on a small scale."""

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = driver.queries()[name](spark, SF)
    found = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in frame.collect())
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_native_plans(spark):
    for name in ("lex_native_rank", "blend_grid", "entity_build", "hard_negatives"):
        plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
