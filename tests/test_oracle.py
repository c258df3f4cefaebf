"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from memlake.plans import decisions, gating, knowledge, lifecycle, ranking, redactions, relational, statements
from memlake.plans.sqlpair import TABLES

SF = "/root/testdata/sf0.001"


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 6) + 0.0 if type(v).__name__ in ("float", "Decimal") else v
    return sorted(tuple(str(plain(r[k])) for k in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [*ranking.ORACLE, *knowledge.ORACLE, *gating.ORACLE, *lifecycle.ORACLE, *decisions.ORACLE, *redactions.ORACLE, *statements.ORACLE, *relational.SQL])
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    c = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(got, df.columns) == rows(c.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
