"""Every query against its SQL on the smallest tables, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from thermalis.plans import catalogue
from thermalis.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(cursor_rows):
    clean = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(v) for v in r) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"classifier_cv", "promotion_replay"}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_promotion_replay_runs_over_whole_tables(spark):
    found = QUERIES["promotion_replay"](spark, DATA)
    rows = found.collect()
    assert len(found.columns) > 0 and len(set(rows)) == len(rows)


def test_classifier_query_predicts_every_row(spark, monkeypatch):
    whole = catalogue.model.cross_validated
    monkeypatch.setattr(catalogue.model, "cross_validated", lambda *a: whole(*a, trees=2))
    got = QUERIES["classifier_cv"](spark, DATA).collect()
    assert len({r["p_partkey"] for r in got}) == len(got) == 200 and all(1 / 3 < r["confidence"] <= 1 for r in got) and {r["fold"] for r in got} == set(range(5))


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
