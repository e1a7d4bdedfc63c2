"""A cross-section of the registered queries against their check SQL; the driver runs them all."""

import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = ["segments", "action_rules", "recent_context", "run_summary", "low_skills", "best_patterns", "retrieve_levels", "granularity_rows"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(result.fetchall(), columns)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_names_the_rows_it_covers():
    from stridemill.plans.registry import QUERIES

    assert all(re.fullmatch(r"[A-Z]\d+( [A-Z]\d+)*", e.covers) for e in QUERIES.values())
    assert set(oracle_sql()) <= set(queries())
