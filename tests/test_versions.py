"""Versioned tables, what runs write into them, the registry as of a time, and nearest places at any distance."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from thermalis.operators import asof, spatial, writes
from thermalis.sources.versions import Versions


def day(d, h=0):
    return dt.datetime(2024, 1, d, h)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, str(tmp_path / "store"))


def test_versions_change_together_and_go_back(spark, store):
    assert store.version() == 0 and store.read("a") is None
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1.5,)], "w double")
    assert store.commit({"a": a, "b": b}, run={"n": 1}) == 1
    assert store.commit({"a": a.withColumn("v", F.lit("y"))}) == 2
    assert rows(store.read("a"), "v") == [("y",)] and rows(store.read("b"), "w") == [(1.5,)] and rows(store.read("a", 1), "v") == [("x",)]
    assert store.run_of(1) == {"n": 1} and store.back_to(1) == 3 and rows(store.read("a"), "v") == [("x",)]
    assert store.commit({"a": a.limit(0)}) == 4 and store.read("a").count() == 0 and store.read("a").columns == ["k", "v"]


def test_a_run_that_dies_between_two_tables_changes_nothing(spark, store):
    good = spark.createDataFrame([(1,)], "k long")
    store.commit({"a": good, "b": good})
    broken = good.withColumn("k", F.raise_error(F.lit("dies here")).cast("long"))
    with pytest.raises(Exception, match="dies here"):
        store.commit({"a": good.withColumn("k", F.lit(2)), "b": broken})
    assert store.version() == 1 and rows(store.read("a"), "k") == [(1,)] and rows(store.read("b"), "k") == [(1,)]
    assert store.commit({"a": good.withColumn("k", F.lit(3))}) == 2


def test_parts_are_replaced_and_the_others_are_not_copied(spark, store):
    first = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3), (None, 4)], "day string, v long")
    store.commit(parts={"t": (first, "day", ["d1", "d2", "null"])})
    folders = {r["part"]: r["folder"] for r in store._entries(1)}
    store.commit(parts={"t": (spark.createDataFrame([("d1", 9)], "day string, v long"), "day", ["d1", "d3"])})
    assert rows(store.read("t"), "day", "v") == sorted([("d1", 9), ("d2", 3), (None, 4)], key=repr)
    assert {r["part"]: r["folder"] for r in store._entries(2)}["d2"] == folders["d2"]
    with pytest.raises(ValueError, match="other parts"):
        store.commit(parts={"t": (first, "day", ["d1"])})
    assert store.version() == 2
    store.commit(parts={"t": (first.limit(0), "day", ["d1", "d2", "null"])})
    assert store.read("t").count() == 0 and store.read("t").columns == ["day", "v"]


def test_numbers_go_on_in_order(spark):
    values = [(f"k{i:03}",) for i in range(200)]
    random.Random(1).shuffle(values)
    got = writes.numbered(spark.createDataFrame(values, "k string").repartition(5), ["k"], "id", 70)
    assert [(r["k"], r["id"]) for r in got.orderBy("id").collect()] == [(f"k{i:03}", 71 + i) for i in range(200)]
    assert writes.numbered(got.select("k").limit(0), ["k"], "id").count() == 0


def test_merge_takes_nulls_and_counts_what_differs(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4)], "k long, v string, w long")
    staged = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, None, 9), (7, "z", 7)], "k long, v string, w long")
    assert rows(writes.merged(target, staged, "k", ["v", "w"]), "k", "v", "w", "changed") == [(1, "a", 1, False), (2, None, 2, True), (3, None, 9, True), (4, "d", 4, False)]
    only = writes.merged(target, staged, "k", ["v", "w"], F.col("k") > 2)
    assert rows(only.filter("changed"), "k") == [(3,)]


def test_registry_keeps_ids_and_provisional_sources(spark):
    old = spark.createDataFrame([(5, False, "five"), (6, False, "six"), (8, True, "eight"), (9, True, "nine")], "source_id long, provisional boolean, cls string")
    old_cells = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 8), (5, 9)], "cell long, source_id long")
    det = spark.createDataFrame([(1, 5), (2, 6), (3, 8), (4, 9), (5, None), (6, 5)], "detection_id long, source_id long")
    sources = spark.createDataFrame([(0, "new five"), (1, "new nine"), (2, "fresh")], "label long, cls string")
    cells = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (77, 2)], "cell long, label long")
    assigned = spark.createDataFrame([(1, 0), (4, 1), (5, 2)], "detection_id long, label long")
    for _ in range(2):  # a rerun from the same version gives the same
        new = writes.next_registry(old, old_cells, det, sources, cells, assigned)
        assert rows(new["sources"], "source_id", "provisional", "cls") == [(10, False, "fresh"), (5, False, "new five"), (8, True, "eight"), (9, True, "new nine")]
        assert rows(new["cells"], "cell", "source_id") == [(1, 5), (2, 5), (4, 8), (5, 9), (77, 10)]
        assert rows(new["detections"], "detection_id", "source_id") == [(1, 5), (2, None), (3, 8), (4, 9), (5, 10), (6, None)]


def test_a_window_is_undone_and_run_again(spark):
    kinds = "source_id long, origin string, provisional boolean, promoted_at timestamp_ntz, retired_at timestamp_ntz"
    base = {
        "sources": spark.createDataFrame([(1, "registry", False, None, day(6)), (2, "registry", False, None, day(2)), (50, "promotion", True, day(5), None), (51, "promotion", True, day(3), None)], kinds),
        "cells": spark.createDataFrame([(1, 1), (2, 50), (3, 51)], "cell long, source_id long"),
        "passes": spark.createDataFrame([(1, day(4)), (1, day(5, 3))], "source_id long, acq_datetime timestamp_ntz"),
        "detections": spark.createDataFrame([(1, day(5), 50, 3), (2, day(4), 51, 2), (3, day(6, 23), None, 1)], "detection_id long, acq_datetime timestamp_ntz, source_id long, road int"),
    }
    clean = writes.without_window(base["sources"], base["cells"], base["passes"], base["detections"], "2024-01-05", "2024-01-07")
    assert rows(clean["sources"], "source_id", F.to_date("retired_at").cast("string")) == [(1, None), (2, "2024-01-02"), (51, None)]
    assert rows(clean["cells"], "cell") == [(1,), (3,)] and clean["passes"].count() == 1
    assert rows(clean["detections"], "detection_id", "source_id", "road") == [(1, None, 3), (2, 51, 2), (3, None, 1)]
    run = (
        spark.createDataFrame([(60, day(6))], "source_id long, promoted_at timestamp_ntz"),
        spark.createDataFrame([(9, 60)], "cell long, source_id long"),
        spark.createDataFrame([(51, day(6, 1))], "source_id long, retired_at timestamp_ntz"),
        spark.createDataFrame([(1, day(5, 3))], "source_id long, acq_datetime timestamp_ntz"),
        spark.createDataFrame([(1, 60, 3), (2, 99, 9), (3, None, 2)], "detection_id long, source_id long, road int"),
    )
    after = writes.after_inference(clean, *run, "2024-01-05", "2024-01-07")
    again = writes.without_window(after["sources"], after["cells"], after["passes"], after["detections"], "2024-01-05", "2024-01-07")
    twice = writes.after_inference(again, *run, "2024-01-05", "2024-01-07")
    for got in (after, twice):
        assert rows(got["sources"], "source_id", "provisional", "origin", F.to_date("retired_at").cast("string")) == sorted([(1, False, "registry", None), (2, False, "registry", "2024-01-02"), (51, True, "promotion", "2024-01-06"), (60, True, "promotion", None)], key=repr)
        assert rows(got["detections"], "detection_id", "source_id", "road") == [(1, 60, 3), (2, 51, 2), (3, None, 2)]  # the second lies before the window
        assert got["passes"].count() == 2 and got["cells"].count() == 3


def test_events_scores_and_labels_are_replaced(spark):
    events = spark.createDataFrame([(1, day(1), 0.5, "{}"), (2, day(5), 0.9, "{}")], "event_id long, first_seen timestamp_ntz, risk double, breakdown string")
    det = spark.createDataFrame([(1, day(1), 1), (2, day(5), 2), (3, day(6), 2)], "detection_id long, acq_datetime timestamp_ntz, event_id long")
    found = spark.createDataFrame([("b", day(6)), ("a", day(5))], "event string, first_seen timestamp_ntz")
    links = spark.createDataFrame([(2, "a"), (1, "b")], "detection_id long, event string")
    got = writes.after_events(events, det, found, links, "2024-01-05", "2024-01-07")
    assert rows(got["events"], "event_id", F.dayofmonth("first_seen"), "risk") == [(1, 1, 0.5), (3, 5, None), (4, 6, None)]
    assert rows(got["detections"], "detection_id", "event_id") == [(1, 1), (2, 3), (3, None)]
    scored = spark.createDataFrame([(3, 0.7, "{x}"), (99, 1.0, "")], "event_id long, risk double, breakdown string")
    assert rows(writes.after_scores(got["events"], scored), "event_id", "risk") == [(1, 0.5), (3, 0.7), (4, None)]
    sources = spark.createDataFrame([(1, "coal", "osm:1"), (2, None, None)], "source_id long, label string, evidence string")
    labels = spark.createDataFrame([(2, "gas", "osm:2")], "source_id long, label string, evidence string")
    assert rows(writes.after_labels(sources, labels)["sources"], "source_id", "label", "evidence") == [(1, None, None), (2, "gas", "osm:2")]


def test_cells_count_between_promotion_and_retirement(spark):
    sources = spark.createDataFrame([(1, False, None, day(2)), (2, True, day(5), day(9)), (3, True, None, None), (4, True, None, day(3)), (5, True, day(5), None)], "source long, provisional boolean, promoted_at timestamp_ntz, retired_at timestamp_ntz")
    cells = spark.createDataFrame([(10 * s, s, 1000.0 * s, 0.0) for s in range(1, 6)], "cell long, source long, x double, y double")
    live = asof.versioned(sources, cells)
    at = lambda t: [r[0] for r in rows(asof.live_at(live, F.lit(t).cast("timestamp_ntz")), "source")]
    assert at(day(5)) == [1, 3] and at(day(5, 1)) == [1, 2, 3, 5] and at(day(9)) == [1, 3, 5]


def test_backfill_takes_the_nearest_cell_before_its_days(spark):
    promoted = spark.createDataFrame([(1, dt.date(2024, 1, 3), day(6)), (2, dt.date(2024, 1, 1), day(9))], "source long, first_seen date, promoted_at timestamp_ntz")
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 300.0, 0.0)], "cell long, source long, x double, y double")
    det = spark.createDataFrame([(1, 10.0, 0.0, day(2), 1, None), (2, 10.0, 0.0, day(3), 1, None), (3, 10.0, 0.0, day(6), 1, None), (4, 290.0, 0.0, day(8), 1, None), (5, 290.0, 0.0, day(8), 2, None), (6, 10.0, 500.0, day(4), 1, None)], "detection_id long, x double, y double, acq_datetime timestamp_ntz, road int, source long")
    # the first would fit the second source's days, but the first source's cell is nearer
    assert rows(asof.pre_promotion(det, promoted, cells), "detection_id", "source") == [(2, 1), (4, 2)]


def test_nearest_at_any_distance(spark):
    rng = random.Random(8)
    left = [(i, rng.choice((0.0, 1e3, 3e5)) + rng.random() * 5e3, rng.random() * 4e4) for i in range(80)]
    right = [(i, rng.random() * 2e4, rng.random() * 4e4) for i in range(15)] + [(99, 5.0, 5.0), (98, 5.0, 5.0)]
    points, places = spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "place long, x double, y double")
    for first in (10.0, 1e7):
        got = {r["id"]: (r["place"], r["d"]) for r in spatial.nearest_any(points, places, "id", "place", "place", first).collect()}
        for i, x, y in left:
            d, place = min((math.hypot(x - a, y - b), p) for p, a, b in right)
            assert got[i][0] == place and got[i][1] == pytest.approx(d)
    assert {r["place"] for r in spatial.nearest_any(points, places.limit(0), "id", "place", "place").collect()} == {None}
    assert spatial.nearest_any(points.limit(0), places, "id", "place", "place").count() == 0
