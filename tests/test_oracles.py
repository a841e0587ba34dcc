"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from lodestar import queries as Q
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, np.bool_)):
        return v if not isinstance(v, np.bool_) else bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows_of(rows, at):
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = db.sql(SQL[name])
    assert cols == sorted(want.columns)
    got = rows_of([[r[c] for c in cols] for r in df.collect()], range(len(cols)))
    assert got == rows_of(want.fetchall(), [want.columns.index(c) for c in cols])


def test_queries_without_sql_are_tested_elsewhere():
    assert set(Q.queries()) - set(SQL) == {"all_gates", "alternatives", "beam_plan", "beam_sensitivity", "dedupe_pois", "planner_gates", "sensitivity", "speed_fit", "token_sort_ratio"}
