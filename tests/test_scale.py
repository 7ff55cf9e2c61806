"""What grows with a table is not broadcast through the driver, and bounds of what is shuffled."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from thermalis import tables as shared_tables
from thermalis.operators import evaluate, events, registry, risk, routing, spatial, weather
from thermalis.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, n: int, name: str = "id"):
    return spark.range(n).select(F.col("id").alias(name), (F.col("id") % 10 * 100).cast("double").alias("x"), (F.expr("id div 10") * 100).cast("double").alias("y"))


def test_copies_of_places_are_merged(spark):
    pairs = spatial.near_pairs(grid(spark, 100), grid(spark, 100), 100.0)
    assert "Broadcast" not in plan(pairs)
    want = sum(abs(a // 10 - b // 10) + abs(a % 10 - b % 10) <= 1 for a in range(100) for b in range(100))
    assert pairs.count() == want == pairs.select("id", "r_id").distinct().count()


def test_reference_objects_are_merged(spark):
    pairs = evaluate.reference_scores(grid(spark, 9), grid(spark, 9).withColumn("active", F.lit(True)), 50.0)
    assert "SortMergeJoin" in plan(pairs) and pairs.first().asDict() == {"recall_active": 1.0, "recall_all": 1.0, "on_object": 1.0, "merging_sources": 0, "merged_objects": 0}


def test_only_the_least_asset_of_a_place_is_copied(spark, monkeypatch):
    events = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assets = spark.range(1000).select((F.col("id") + 7).alias("asset_id"), F.lit(30.0).alias("x"), F.lit(40.0).alias("y"), ((F.col("id") % 5 + 1) / 5.0).alias("criticality"))
    seen, pairs = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda left, right, *a, **k: seen.append(right.count()) or pairs(left, right, *a, **k))
    got = risk.asset_terms(events, assets).first().asDict()
    assert seen == [1, 1]
    assert (got["nearest_m"], got["nearest_criticality"], got["assets_10km"]) == (50.0, 0.2, 999) and abs(got["asset_weight"] - 599.8) < 1e-9


def sky(spark, routing: bool):
    """Clear sky at two places of one cell, and the plan: no row of a place and a day may be shuffled."""
    places = spark.createDataFrame([("p", 11), ("q", 11), ("r", 12)], "key string, cell long")
    cloud = spark.createDataFrame([(11, 1, "D", None), (1, 1, "D", 0.25), (12, 1, "A", 0.5), (11, 2, "N", 0.75)], "cell long, day int, daynight string, cloud_frac double")
    found = weather.clear_sky(places, cloud, 10, routing)
    assert not re.search(r"hashpartitioning\(key#\d+L?, day#", plan(found))
    return sorted((r["key"], r["day"], r["daynight"], r["clear"]) for r in found.collect())


def test_clear_sky_is_found_once_a_cell(spark):
    own = [(1, "D", 0.75), (1, "N", 0.5), (2, "N", 0.25)]
    assert sky(spark, False) == sorted([(k, *v) for k in "pq" for v in own] + [("r", 1, "D", 0.75), ("r", 1, "N", 0.5), ("r", 2, "N", 0.25)])


def test_far_points_meet_few_places(spark, monkeypatch):
    points = grid(spark, 300).withColumn("y", F.col("y") * 10 + 9e6)
    places = grid(spark, 400, "place")
    made, pairs, written = [], spatial.near_pairs, spatial.written
    monkeypatch.setattr(spatial, "near_pairs", lambda *a, **k: made.append(pairs(*a, **k).count()) or pairs(*a, **k))
    monkeypatch.setattr(spatial, "written", lambda t: made.append(t.count()) or written(t))
    got = spatial.nearest_any(points, places, "id", "place", "place", 200.0).collect()
    assert all(r["place"] == 390 + r["id"] % 10 and r["d"] == 9e6 + r["id"] // 10 * 1000 - 3900 for r in got) and len(got) == 300
    assert sum(made) < 20_000  # all pairs would be 120,000


def test_clear_sky_for_routing_is_found_once_a_cell(spark):
    assert sky(spark, True) == sorted((k, d, "A", v) for k in "pqr" for d, v in ((1, 0.5), (2, 0.25)))


def test_persistence_shuffles_no_day_of_a_key(spark):
    hits = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "source string, d int").select("source", F.date_add(F.lit("2024-01-01").cast("date"), "d").alias("day"))
    days = spark.range(1, 5).crossJoin(spark.createDataFrame([("a",), ("b",)], "source string")).select("source", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit(0.5).alias("clear"))
    found = registry.persistence(hits, days, "source")
    assert not re.search(r"Join \[source#\w+, day#", plan(found))
    assert {r["source"]: r["persistence"] for r in found.collect()} == {"a": 2 / 3, "b": 1.0}


def test_facilities_are_merged(spark):
    ring = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    facilities = grid(spark, 40, "facility_id").withColumn("group", F.lit("mining")).select("facility_id", "group", ring.alias("ring"))
    det = grid(spark, 40, "detection_id").withColumns({"landcover": F.lit(60), "acq_datetime": F.lit("2024-01-01").cast("timestamp_ntz")})
    assert "BroadcastHashJoin" not in plan(routing.facilities_near(det, facilities, 5.0)) and "BroadcastHashJoin" not in plan(routing.road_a(det, facilities))
    assert sorted((r["detection_id"], r["facility_id"], r["d"]) for r in routing.facilities_near(det, facilities, 5.0).collect()) == [(i, i, 0.0) for i in range(40)]


def test_a_sweep_keeps_one_row_a_key(spark):
    days = [("a", d) for d in ("2023-01-31", "2023-02-28", "2023-12-31", "2024-02-29", "2024-02-29")] + [("b", "1969-12-31")]
    recurring = registry.recurrence(spark.createDataFrame(days, "key string, at string").withColumn("at", F.to_date("at")), "key", "at")
    assert sorted(tuple(r) for r in recurring.collect()) == [("a", 2023, 3, 3), ("a", 2024, 1, 1), ("b", 1969, 1, 1)]
    swept = registry.gate_sweep(recurring, "key", [(1, 1, 1), (1, 1, 2), (3, 3, 1), (3, 4, 1)])
    assert not re.search(r"Generate explode.*\[key#", plan(swept)) and not re.search(r"hashpartitioning\(key#\d+, _d", plan(swept))
    assert sorted(tuple(r) for r in swept.collect()) == [(1, 1, 1, 2), (1, 1, 2, 1), (3, 3, 1, 1), (3, 4, 1, 0)]
    assert registry.gate_sweep(recurring.limit(0), "key", [(1, 1, 1)]).count() == 0


def test_overlaps_are_summed_where_they_meet(spark):
    new = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (2, None), (None, 5)], "cell long, label long")
    old = spark.createDataFrame([(1, 8), (2, 8), (2, 8), (2, 9), (None, 8)], "cell long, old_id long")
    found = registry.overlaps(new, old)
    assert plan(found).count("Exchange hashpartitioning") == 3  # each side by cell, the pairs before any sum
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted([(5, 8, 2), (5, 9, 1), (6, 8, 1), (None, 8, 1), (None, 9, 1)], key=key)


def test_matching_moves_no_pair_to_find_the_best(spark, monkeypatch):
    plans, tables = [], []
    from thermalis import tables as shared_tables

    whole = shared_tables.written
    monkeypatch.setattr(shared_tables, "written", lambda df: plans.append(plan(df)) or tables.append(df) or whole(df))
    shared = spark.createDataFrame([(1, 7, 9), (1, 8, 9), (2, 7, 9), (2, 8, 4), (3, 8, 5), (3, 7, 1), (None, 7, 10)], "label long, old_id long, n long")
    assert sorted((r["label"], r["old_id"]) for r in registry.match_ids(shared).collect()) == [(1, 7), (3, 8)]
    assert len(plans) > 2 and not any("Window" in p for p in plans)


def test_matching_writes_no_table_of_all_pairs(spark, monkeypatch):
    """Most pairs share one cell: they are made for free labels and ids only. The result is the greedy one, however pairs are sliced."""
    rng = random.Random(7)
    lines = [(rng.randrange(900), rng.randrange(2000), rng.randrange(120)) for _ in range(3000)] + [(c, 5000, 7) for c in range(90)] + [(None, 1, 1), (1, None, None)]
    cells: dict = {}
    for c, label, old in lines[:-2]:
        cells.setdefault(c, (set(), set()))
        cells[c][0].add(label)
        cells[c][1].add(old)
    shared = Counter((label, old) for labels, olds in cells.values() for label in labels for old in olds)
    want: dict = {}
    for label, old in sorted(shared, key=lambda p: (-shared[p], p)):
        if label not in want and old not in want.values():
            want[label] = old
    monkeypatch.setattr(catalogue, "table", lambda *_: spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long"))
    kept, whole = [], shared_tables.written
    monkeypatch.setattr(shared_tables, "written", lambda df: kept.append(df.count()) or whole(df))
    assert {r["label"]: r["old_id"] for r in catalogue.QUERIES["id_matching"](spark, "").collect()} == want
    assert sum(kept) < len(shared) / 2 and any(shared[p] == 1 for p in want.items())
    monkeypatch.setattr(shared_tables, "written", whole)
    monkeypatch.setattr(registry, "SETTLED", 60)
    monkeypatch.setattr(registry, "SLICES", 2)
    assert {r["label"]: r["old_id"] for r in catalogue.QUERIES["id_matching"](spark, "").collect()} == want


def test_edges_of_a_long_chain_shrink_by_a_share(spark, monkeypatch):
    chain = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept, written = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df: kept.extend([df.count()] if "a" in df.columns else []) or written(df))
    got = spatial.connected_components(spark.range(302), chain.union(chain.select("b", "a")))
    assert {r["id"]: r["comp"] for r in got.collect()} == {i: 0 if i < 300 else i for i in range(302)}
    assert kept[0] == 598 and kept[-1] == 0 and sum(kept) < 4 * 598  # one table before, all of it read each round


def test_days_of_a_square_are_linked_as_one_run(spark, monkeypatch):
    there = [(100.0, d, False) for d in range(10)] + [(840.0, 13, False), (100.0, 19, False), (50_000.0, 0, True), (50_000.0, 40, False), (50_740.0, 80, False), (50_760.0, 120, False)]
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(day)")
    det = spark.createDataFrame([(i, 7 if p else None, p, x, 100.0, d) for i, (x, d, p) in enumerate(there)], "detection_id long, source_id long, provisional boolean, x double, y double, day int").withColumns({"acq_datetime": at, "retired": F.lit(None).cast("long")})
    nodes, linked = [], spatial.connected_components
    monkeypatch.setattr(spatial, "connected_components", lambda n, e: nodes.extend(r["id"] for r in n.collect()) or linked(n, e))
    got = {r["detection_id"]: r["site"] for r in events.assemble(det.drop("day")).collect()}
    # 740 m and 4 days further is linked, 6 days is not; near a provisional source days do not count, 760 m is too far
    assert got == dict.fromkeys(range(11), 0) | {11: 11, 12: 12, 13: 12, 14: 12, 15: 15}
    assert sorted(nodes) == [0, 10, 11, 12, 14, 15]


def test_a_site_is_replayed_without_frames_and_linked_on_days_that_change_it(spark, monkeypatch):
    rows = [(i, 100.0, 100.0, i, "VIIRS", "fire") for i in range(40)]
    det = spark.createDataFrame(rows, "detection_id long, x double, y double, day long, instrument string, pred_class string")
    found = routing.promotions(det)
    assert "FlatMapGroupsInArrow" in plan(found)
    got = [tuple(r)[1:] for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, None, 0, 20, 20, "fire"), *[(1, i, None, None, None, None) for i in range(20, 40)]], key=str)
    tied, chains = [], routing._chains
    monkeypatch.setattr(routing, "_chains", lambda at: tied.append(len(at)) or chains(at))
    site = routing.candidate_groups(det).select("site", "detection_id", "cell", "x", "y", "day", "instrument", "pred_class").toArrow()
    assert routing._replay_site(site, None).num_rows == len(got) and len(tied) == 20  # captured days change no cell


def test_a_summary_assigns_detections_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def assigned(rows):
        calls.add(1)
        return rows

    at = F.lit("2024-01-01").cast("timestamp_ntz")
    det = spark.range(6).select(F.col("id").alias("detection_id"), F.lit(None).cast("long").alias("source_id"), at.alias("acq_datetime"), F.lit(5.0).alias("frp"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(None).cast("string").alias("alert"), F.lit("forest").alias("pred_class"), F.lit("forest").alias("category"))
    found = det.select((F.col("detection_id") % 2).alias("site"), F.lit(0).alias("no"), F.lit("fire").alias("kind"), "detection_id").groupBy("site").applyInArrow(assigned, events.LINKED)
    got = events.summarise(found, det, 0).collect()
    assert [(r["n_detections"], r["pred_class"]) for r in got] == [(3, "forest")] * 2 and calls.value == 2


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    java = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_density_clusters_copy_a_place_about_twice(spark):
    """Clumps of 66 places in 900 m, whose components take several rounds. No join is broadcast, as at size."""
    n = 6600
    at = spark.range(n).select("id", (F.expr("id div 66") * 5000 + F.col("id") * 7919 % 900).cast("double").alias("x"), (F.col("id") * 104729 % 900).cast("double").alias("y"), (1 + F.col("id") % 3).alias("weight"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert spatial.weighted_dbscan(at, 90.0, 5).count() == n
        assert shuffled(spark) - before < 16 * n  # 12 rows a point; 24 when places went to 4 buckets, three times over
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rounds_write_only_nodes_with_edges(spark, monkeypatch):
    chain = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept, written = [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df: kept.append(df.count()) or written(df))
    got = spatial.connected_components(spark.range(5000), chain.union(chain.select("b", "a")))
    assert {r["id"]: r["comp"] for r in got.collect()} == {i: 0 if i < 300 else i for i in range(5000)}
    assert sum(kept) < 5000  # all nodes in every round would be 30,000 and more
