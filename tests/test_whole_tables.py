"""Queries without SQL over every row of their tables."""

import inspect

import duckdb

from thermalis.operators import model, registry
from thermalis.plans import catalogue
from thermalis.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_detection_is_in_one_event(spark):
    want = sorted(r[0] for r in duckdb.sql(f"SELECT event_id FROM '{DATA}/events.parquet'").fetchall())
    assert sorted(r["detection_id"] for r in QUERIES["fire_events_linking"](spark, DATA).collect()) == want
    assert sum(r["n_detections"] for r in QUERIES["event_summaries"](spark, DATA).collect()) == len(want)


def test_ids_are_matched_over_all_labels(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    line = f"'{data}/lineitem.parquet'"
    shared = duckdb.sql(f"SELECT l_partkey, l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM {line}) JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM {line}) USING (l_orderkey) GROUP BY ALL ORDER BY n DESC, l_partkey, l_suppkey").fetchall()
    want, used = {}, set()
    for label, old, _ in shared:
        if label not in want and old not in used:
            want[label] = old
            used.add(old)
    assert max(want) >= 500
    assert {r["label"]: r["old_id"] for r in QUERIES["id_matching"](spark, data).collect()} == want


def test_classifier_trains_on_a_separable_table(spark):
    rows = spark.createDataFrame([(i, i % 4, ("kiln", "mining")[i // 4 % 2], float(i // 4 % 2 * 10 + i % 3)) for i in range(48)], "id long, block long, label string, frp_med double")
    got = model.cross_validated(rows, ["frp_med"], "block", k=2, trees=2).collect()
    assert sorted(r["id"] for r in got) == list(range(48)) and all(r["predicted"] == r["label"] for r in got)
    assert len({r["fold"] for r in got}) == 2 and all(len({r["fold"] for r in got if r["block"] == b}) == 1 for b in range(4))


def test_classifier_query_has_the_operators_trees_and_folds(spark, monkeypatch):
    seen = {}

    def trained(*args, **kwargs):
        bound = whole.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise StopIteration

    whole = inspect.signature(model.cross_validated)
    monkeypatch.setattr(catalogue.model, "cross_validated", trained)
    try:
        QUERIES["classifier_cv"](spark, DATA)
    except StopIteration:
        pass
    assert (seen["trees"], seen["k"]) == (model.TREES, model.FOLDS) == (300, 5)


def test_hulls(spark):
    square = [(1, float(x), float(y)) for x in (0, 500, 1000) for y in (0, 500, 1000)]
    points = spark.createDataFrame([*square, (2, 5.0, 5.0), (3, 0.0, 0.0), (3, 9.0, 9.0)], "source long, x double, y double")
    got = {r["source"]: r["hull"] for r in registry.hull(points, "source").collect()}
    assert got[1] == "POLYGON ((0.000 0.000, 1000.000 0.000, 1000.000 1000.000, 0.000 1000.000, 0.000 0.000))"
    assert got[2] == "POINT (5.000 5.000)" and got[3] == "LINESTRING (0.000 0.000, 9.000 9.000)"
