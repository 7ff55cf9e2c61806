"""Hand-made cases with known answers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from thermalis.functions import geo, rules
from thermalis.operators import events, ingest, model, passes, registry, risk, routing, spatial
from thermalis.plans import read
from thermalis.sources import files

T0 = dt.datetime(2023, 1, 1)


def at(hours=0, days=0, minutes=0):
    return T0 + dt.timedelta(days=days, hours=hours, minutes=minutes)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_projection_scale_and_inverse(spark):
    d = frame(spark, [(24.0, 80.0), (8.1, 77.5), (34.9, 74.2)], "lat double, lon double")
    x, y = geo.to_metres(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_metres(x, y)
    out = d.select(x.alias("x"), y.alias("y"), (lat - F.col("lat")).alias("a"), (lon - F.col("lon")).alias("b")).collect()
    assert out[0]["x"] == pytest.approx(4e6) and out[0]["y"] == pytest.approx(4e6)
    assert all(abs(r["a"]) < 1e-9 and abs(r["b"]) < 1e-9 for r in out)
    west, south, east, north = d.limit(1).select(*geo.cell_bounds(geo.cell(F.lit(1000.0), F.lit(400.0)))).first()
    assert (west, south, east, north) == (750, 375, 1125, 750)


def test_gate_needs_months_and_days_in_enough_years(spark):
    def year(key, y, months, days):
        return [(key, dt.datetime(y, m, d)) for m in range(1, months + 1) for d in range(1, days + 1)]

    rows = year(1, 2022, 3, 4) + year(1, 2023, 3, 4) + year(2, 2022, 3, 4) + year(3, 2022, 2, 9) + year(3, 2023, 2, 9) + year(4, 2022, 3, 3) * 30
    got = registry.gated(registry.recurrence(frame(spark, rows, "key long, at timestamp"), "key", "at"), "key", 3, 10, 2)
    assert [r["key"] for r in got.collect()] == [1]


def test_clusters_and_cap(spark):
    chain = [(100 + i, 50_000.0 + 400 * i, 0.0, 30) for i in range(60)]
    cells = frame(spark, [(1, 0.0, 0.0, 30), (2, 375.0, 0.0, 30), (3, 5375.0, 0.0, 3), *chain], "id long, x double, y double, weight long")
    label, sizes = registry.clusters(cells)
    assert {r["id"]: r["cluster"] for r in label.filter("id < 10").collect()} == {1: 1, 2: 1}
    assert {r["cluster"]: r["capped"] for r in sizes.collect()} == {1: False, 100: True}


def test_assign_radius_is_exclusive_and_by_instrument(spark):
    cells = frame(spark, [(7, 0.0, 0.0, 3)], "cell long, x double, y double, source long")
    det = frame(spark, [(i, float(d), 0.0, k) for i, (d, k) in enumerate((d, k) for k in ("VIIRS", "MODIS") for d in (450, 500, 600, 900, 1000, 1200))], "detection_id long, x double, y double, instrument string")
    got = [r["source"] for r in registry.assign(det, cells).orderBy("detection_id").collect()]
    assert got == [3, None, None, None, None, None, 3, 3, 3, 3, None, None]


def test_dbscan_core_border_noise(spark):
    pts = frame(spark, [(1, 0.0, 0.0, 3), (2, 10.0, 0.0, 2), (3, 19.0, 0.0, 1), (4, 100.0, 0.0, 1), (5, 29.0, 0.0, 1)], "id long, x double, y double, weight long")
    got = {r["id"]: (r["core"], r["cluster"]) for r in spatial.weighted_dbscan(pts, 10.0, 5).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, 1), 4: (False, None), 5: (False, None)}


def test_split_wide(spark):
    pts = frame(spark, [(1, 0.0, 0.0, 9), (2, 20_000.0, 0.0, 9), (3, 5.0, 5.0, 8)], "id long, x double, y double, c long")
    got = {r["id"]: (r["c"], r["part"]) for r in spatial.split_wide(pts, "c", 10.0).collect()}
    assert got[3] == (8, 0) and got[1][0] is None and got[1][1] != got[2][1]


def test_persistence(spark):
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    clear = frame(spark, [(1, day(d), 1.0 if d < 10 else 0.0) for d in range(20)], "source long, day date, clear double")
    span = frame(spark, [(1, day(0), day(19))], "source long, first date, last date")
    for n, want in ((10, 1.0), (5, 0.5)):
        hits = frame(spark, [(1, day(d)) for d in range(n)], "source long, day date")
        assert registry.persistence(hits, clear, "source", span).first()["persistence"] == pytest.approx(want)
    few = clear.filter(F.col("day") < F.lit(day(5)))
    assert registry.persistence(hits, few, "source", span).first()["persistence"] is None


def test_month_stats(spark):
    rows = [(1, dt.date(2023, m, d)) for m in range(1, 13) for d in (1, 2)] + [(2, dt.date(2023, 11, d)) for d in range(1, 6)] * 2
    got = {r["source"]: tuple(r)[1:] for r in registry.month_stats(frame(spark, rows, "source long, day date"), "source").collect()}
    assert got[1] == pytest.approx((1.0, 1 / 12, 4 / 12)) and got[2] == pytest.approx((0.0, 1.0, 0.0))


def test_match_ids(spark):
    new = frame(spark, [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2)], "cell long, label long")
    old = frame(spark, [(1, 7), (2, 7), (3, 9), (4, 9), (6, 11)], "cell long, old_id long")
    assert {r["label"]: r["old_id"] for r in registry.match_ids(registry.overlaps(new, old)).collect()} == {0: 7, 1: 9}
    assert registry.match_ids(registry.overlaps(new.limit(0), old)).count() == 0


def judged(spark, frps, instruments=None, **kw):
    base = frame(spark, [(1, "VIIRS|D", 10.0, 2.0, 20.0, 50), (1, "*", 10.0, 2.0, 20.0, 90)], "source long, key string, med double, mad double, p99 double, n long")
    rows = [(1, "S", i, (instruments or ["VIIRS"] * len(frps))[i], "D", at(hours=12 * i), float(v)) for i, v in enumerate(frps)]
    p = frame(spark, rows, "source long, sensor string, session long, instrument string, daynight string, acq_datetime timestamp, frp double")
    return passes.tiers(passes.scored(p, base), z_extreme=7, p99_extreme=3, **kw).orderBy("session").collect()


def test_tiers(spark):
    assert [r["breach"] for r in judged(spark, [11, 35, 12, 35, 36])] == [False, True, False, True, True]
    assert [r["alert"] for r in judged(spark, [11, 90, 11])] == [None, "provisional", None]
    assert [r["alert"] for r in judged(spark, [35, 36])] == [None, "confirmed"]
    assert [r["alert"] for r in judged(spark, [35, 5, 36], ["VIIRS", "MODIS", "VIIRS"])] == [None, None, "confirmed"]
    last = frame(spark, [(1, True)], "source long, breached boolean")
    assert [r["alert"] for r in judged(spark, [36], last=last)] == ["confirmed"]


def test_passes_and_gap(spark):
    rows = [(1, 1, "A", at(), 5.0), (2, 1, "A", at(minutes=1), 9.0), (3, 1, "A", at(hours=12), 1.0), (4, 1, "B", at(), 1.0), (5, 2, "A", at(), 1.0), (6, 1, "A", at(hours=12, minutes=20), 2.0)]
    det = frame(spark, rows, "detection_id long, source long, sensor string, acq_datetime timestamp, frp double").withColumns({"instrument": F.lit("VIIRS"), "daynight": F.lit("N")})
    got = {(r["source"], r["sensor"], r["session"]): (r["frp"], r["frp_sum"], r["n_det"]) for r in passes.pass_table(det).collect()}
    assert got == {(1, "A", 1): (9.0, 14.0, 2), (1, "A", 2): (2.0, 3.0, 2), (1, "B", 1): (1.0, 1.0, 1), (2, "A", 1): (1.0, 1.0, 1)}


def test_baseline_buckets(spark):
    rows = [(1, "VIIRS", "N", dt.datetime(2023, 1, 1), 5.0)] * 40 + [(1, "VIIRS", "N", dt.datetime(2023, 7, 1), 5.0)] * 20 + [(1, "VIIRS", "D", dt.datetime(2023, 7, 1), float("nan"))] + [(1, "VIIRS", "D", dt.datetime(2023, 7, 1), 5.0)] * 10
    got = passes.baselines(frame(spark, rows, "source long, instrument string, daynight string, acq_datetime timestamp, frp double"))
    assert {r["key"]: r["n"] for r in got.collect()} == {"*": 70, "VIIRS|N": 60, "VIIRS|N|winter": 40}


def test_label_rules(spark):
    tags = [({"industrial": "refinery"}, "oil_gas"), ({"man_made": "works", "product": "steel"}, "steel_cement"), ({"power": "plant", "plant:source": "coal"}, "thermal_power"), ({"power": "plant", "plant:source": "solar"}, None), ({"landuse": "quarry"}, "mining"), ({"man_made": "kiln"}, "kiln"), ({"landuse": "industrial"}, "industrial_other"), ({"landuse": "residential"}, None)]
    got = frame(spark, [(t,) for t, _ in tags], "tags map<string,string>").select(rules.label_group(F.col("tags"))).collect()
    assert [r[0] for r in got] == [w for _, w in tags]
    kinds = frame(spark, [("oil_gas", {"name": "LNG Terminal"}), ("oil_gas", {"name": "Urea works"}), ("mining", {}), (None, {})], "g string, tags map<string,string>").select(rules.asset_type(F.col("g"), F.col("tags"))).collect()
    assert [r[0] for r in kinds] == ["lng_lpg_terminal", "fertiliser_plant", "mine", None]


def test_normalise(spark):
    raw = frame(spark, [("10.5", "77.1", "330.1", "1", "1", "2023-01-02", "821", "N", "n", "2.0NRT", "290", "bad", "D")], "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, version string, bright_ti5 string, frp string, daynight string")
    r = ingest.normalise(raw, "VIIRS").first()
    assert r["acq_datetime"] == dt.datetime(2023, 1, 2, 8, 21) and r["sensor"] == "VIIRS_SNPP" and r["product"] == "NRT" and r["frp"] is None and r["firms_type"] is None
    for bad in ({"satellite": "X"}, {"version": " "}):
        with pytest.raises(Exception):
            ingest.normalise(raw.withColumns({k: F.lit(v) for k, v in bad.items()}), "VIIRS").collect()


def test_sp_supersedes_nrt(spark):
    rows = [("S", "SP", at(1)), ("S", "NRT", at(2)), ("J", "NRT", at(3)), ("S", "NRT", at(days=1))]
    det = frame(spark, rows, "sensor string, product string, acq_datetime timestamp")
    got = ingest.drop_superseded(det, det.filter("product = 'SP'"), ["sensor"])
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[0], rows[2], rows[3]])
    full = det.withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    first = ingest.load(full.limit(0), full)
    assert first.count() == 3 and ingest.load(first, full).count() == 0


def square(x, y, half):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]


def test_road_a(spark):
    facilities = frame(spark, [("r", "oil_gas", square(0.0, 0.0, 50.0)), ("m", "mining", square(100_000.0, 0.0, 50.0)), ("mill", "industrial_other", square(200_000.0, 0.0, 100.0))], "facility_id string, group string, ring array<struct<x: double, y: double>>")
    cases = [(300.0, 40, "oil_gas"), (101_500.0, 60, "mining"), (50_000.0, 0, "offshore"), (50_000.0, 80, "unclassified"), (50_000.0, 10, "forest"), (50_000.0, 40, "agricultural"), (50_000.0, 50, "unclassified"), (50_000.0, 30, "vegetation"), (50_000.0, 60, "unclassified"), (200_250.0, 40, "agricultural"), (200_000.0, 40, "industrial"), (200_250.0, 50, "industrial"), (50_000.0, None, "unclassified")]
    det = frame(spark, [(i, x, 0.0, at(), c) for i, (x, c, _) in enumerate(cases)], "detection_id long, x double, y double, acq_datetime timestamp, landcover int")
    got = routing.road_a(det, facilities).orderBy("detection_id").collect()
    assert [r["pred_class"] for r in got] == [c[2] for c in cases] and all(r["reason"] for r in got)


def history(spark, rows):
    return frame(spark, [(i, float(x), float(y), d, "VIIRS", "vegetation") for i, (x, y, d) in enumerate(rows)], "detection_id long, x double, y double, day int, instrument string, pred_class string")


def test_clusters_against_all_pairs(spark):
    """Components, neighbours and density clusters on places with copies, a dense square and a chain."""
    rng = random.Random(4)
    pts = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(150)] + [(2000 + rng.uniform(0, 40), 50.0) for _ in range(60)] + [(3000 + 95 * k, 0.0) for k in range(20)] + [(5000.0, 5000.0)] * 7 + [(-1e-9, 0.0), (89.99, 0.0)]
    rows = [(i, float(x), float(y), 1 + i % 3, i % 4) for i, (x, y) in enumerate(pts)]
    df = frame(spark, rows, "id long, x double, y double, weight int, day int")
    close = lambda a, b, r: math.hypot(a[1] - b[1], a[2] - b[2]) <= r

    def comps(items, link):
        comp = {a[0]: a[0] for a in items}
        while True:
            new = {a[0]: min(comp[b[0]] for b in items if link(a, b)) for a in items}
            if new == comp:
                return comp
            comp = new

    got = lambda d: {tuple(r)[0]: tuple(r)[1] for r in d.collect()}
    assert got(spatial.components_within(df, 100.0)) == comps(rows, lambda a, b: close(a, b, 100))
    assert got(spatial.components_within(df, 100.0, ("day",))) == comps(rows, lambda a, b: a[4] == b[4] and close(a, b, 100))
    assert got(spatial.neighbours_within(df, 100.0)) == {a[0]: sum(close(a, b, 100) for b in rows) for a in rows}
    core = {a[0]: sum(b[3] for b in rows if close(a, b, 60)) >= 9 for a in rows}
    cluster = comps([a for a in rows if core[a[0]]], lambda a, b: close(a, b, 60))
    want = {a[0]: (core[a[0]], min((cluster[b[0]] for b in rows if core[b[0]] and close(a, b, 60)), default=None)) for a in rows}
    assert {r["id"]: (r["core"], r["cluster"]) for r in spatial.weighted_dbscan(df, 60.0, 9).collect()} == want
    assert spatial.components_within(df.limit(0), 100.0).count() == 0


def test_sites_part_no_event(spark):
    """Events found site by site are those of one replay over all detections."""
    rng = random.Random(11)
    rows = []
    for i in range(260):
        place, day = rng.randrange(5), rng.randrange(40)
        sid = rng.choice((None, None, None, float(place)))
        rows.append((i, sid, sid is not None and place == 2, None, 3000.0 * place + rng.uniform(0, 1500), rng.uniform(0, 1500), dt.datetime(2024, 1, 1) + dt.timedelta(days=day, minutes=rng.randrange(1440))))
    det = frame(spark, rows, "detection_id long, source_id double, provisional boolean, retired long, x double, y double, acq_datetime timestamp")
    groups = {}
    for e in events.assemble(det).collect():
        groups.setdefault((e["site"], e["no"]), set()).add(e["detection_id"])
    want = {}
    for i, e in plain_events([(r[0], r[1], r[2], r[4], r[5], int(r[6].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)) for r in rows]).items():
        want.setdefault(e, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len({s for s, _ in groups}) >= 5


def plain_events(rows):
    """{detection: event} out of the rules, one point after the other. rows: (id, source or None, provisional, x, y, microseconds)."""
    hour, day_us = 3_600_000_000, 86_400_000_000
    event, of_source, out, seen = [], {}, {}, []  # event: [kind, last, xs, ys]; seen: (x, y, t, event)
    far = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    for day in sorted({r[5] // day_us for r in rows}):
        today = sorted((r for r in rows if r[5] // day_us == day), key=lambda r: (r[5], r[0]))
        start = today[0][5]
        known, given = list(seen), {}
        for s in sorted({r[1] for r in today if r[1] is not None}):
            own = [r for r in today if r[1] == s]
            k = of_source.get(s)
            if k is None or (not own[0][2] and own[0][5] - event[k][1] > 72 * hour):
                k = of_source[s] = len(event)
                event.append(["new_source" if own[0][2] else "anomaly", 0, [], []])
            given |= {r[0]: k for r in own}
            for r in own:
                event[k][1] = max(event[k][1], r[5])
                event[k][2].append(r[3]), event[k][3].append(r[4])
        fires = [r for r in today if r[1] is None]
        label = {r[0]: r[0] for r in fires}
        while True:
            new = {a[0]: min(label[b[0]] for b in fires if far(a[3:5], b[3:5]) <= 750) for a in fires}
            if new == label:
                break
            label = new
        for c in sorted(set(label.values()), key=lambda c: min((r[5], r[0]) for r in fires if label[r[0]] == c)):
            own, votes = [r for r in fires if label[r[0]] == c], {}
            for r in own:
                holding = [(far(r[3:5], p), k) for *p, t, k in known if event[k][0] == "new_source"]
                recent = [(far(r[3:5], p), k) for *p, t, k in known if t >= start - 72 * hour]
                for pool in (holding, recent):
                    if pool and min(pool)[0] < 750:
                        votes[min(pool)[1]] = votes.get(min(pool)[1], 0) + 1
                        break
            found = None
            for k in sorted(votes, key=lambda k: (-votes[k], k)):
                xs, ys = event[k][2] + [r[3] for r in own], event[k][3] + [r[4] for r in own]
                fits = event[k][0] != "fire" or math.hypot(max(xs) - min(xs), max(ys) - min(ys)) <= 10_000
                if fits and (event[k][0] == "new_source" or own[0][5] - event[k][1] <= 72 * hour):
                    found = k
                    break
            if found is None:
                found = len(event)
                event.append(["fire", 0, [], []])
            event[found][1] = max(event[found][1], *(r[5] for r in own))
            event[found][2] += [r[3] for r in own]
            event[found][3] += [r[4] for r in own]
            given |= {r[0]: found for r in own}
        out |= given
        seen += [(r[3], r[4], r[5], given[r[0]]) for r in today]
    return out


def test_promotion(spark):
    still = [(1000 + (d * 37) % 60, 1000, d) for d in range(25)]
    got = routing.promotions(history(spark, still)).collect()
    made = [r for r in got if r["detection_id"] is None]
    assert len(made) == 1 and made[0]["days"] == 20 and made[0]["promoted_day"] == 20
    assert sorted(r["detection_id"] for r in got if r["detection_id"] is not None) == [20, 21, 22, 23, 24]
    assert routing.promotions(history(spark, [(400 * d, 0, d) for d in range(40)])).count() == 0
    thirds = [(1000, 1000, 3 * d) for d in range(10)]
    assert routing.promotions(history(spark, thirds)).count() == 0
    sky = {d: 1.0 if d % 3 == 0 else 0.0 for d in range(40)}
    assert [r["no"] for r in routing.promotions(history(spark, thirds), sky).collect()] == [1]
    line = [(500 * k, 1000, d) for k in range(8) for d in range(25)]
    assert routing.promotions(history(spark, line)).count() == 0


def fires(spark, rows):
    d = frame(spark, [(i, float(x), 0.0, at(hours=h), s, p) for i, (x, h, s, p) in enumerate(rows)], "detection_id long, x double, y double, acq_datetime timestamp, source_id long, provisional boolean")
    return d.withColumns({"retired": F.lit(None).cast("long"), "frp": F.lit(10.0), "pred_class": F.lit("agricultural"), "category": F.lit("agricultural"), "alert": F.lit(None).cast("string")})


def groups(assigned):
    found = {}
    for r in assigned.collect():
        found.setdefault((r["site"], r["no"]), []).append(r["detection_id"])
    return sorted(sorted(v) for v in found.values())


def test_event_linking(spark):
    fire = lambda *xh: fires(spark, [(x, h, None, False) for x, h in xh])
    assert groups(events.assemble(fire((0, 0), (600, 0), (1200, 0), (5000, 0)))) == [[0, 1, 2], [3]]
    assert groups(events.assemble(fire((0, 0), (300, 48), (0, 144)))) == [[0, 1], [2]]
    front = events.assemble(fire(*[(700 * d, 24 * d) for d in range(20)]))
    assert len(groups(front)) >= 2 and front.count() == 20
    runs = events.assemble(fires(spark, [(0, h, 5, False) for h in (0, 12, 40, 200)]))
    assert groups(runs) == [[0, 1, 2], [3]]
    grown = events.assemble(fires(spark, [(0, 0, 9, True), (0, 24, 9, True), (0, 480, 9, True), (600, 490, None, False)]))
    assert groups(grown) == [[0, 1, 2, 3]] and {r["kind"] for r in grown.collect()} == {"new_source"}


def test_event_status_and_words(spark):
    h = 3600 * 10**6
    got = frame(spark, [(10 * h,), (50 * h,), (100 * h,)], "t long").select(events.status(F.lit(0), F.col("t")), events.status(F.lit(0), F.col("t"), F.lit(True))).collect()
    assert [tuple(r) for r in got] == [("active", "active"), ("dormant", "dormant"), ("closed", "dormant")]
    d = fires(spark, [(0, 0, None, False), (10, 0, None, False), (0, 24, None, False)])
    (r,) = events.summarise(events.assemble(d), d, 0).collect()
    assert r["reason"] == "agricultural fire: 3 detections on 2 days, peak 10 MW"


def test_risk_parts(spark):
    one = frame(spark, [(12.0, 10.0), (8.0, 10.0), (10.0, 10.0), (5.0, None)], "a double, b double")
    assert [tuple(r) for r in one.select(*risk.growth(F.col("a"), F.col("b"))).collect()] == [(1.0, "growing"), (0.0, "shrinking"), (0.5, "flat"), (0.5, "seen once")]
    v = spark.range(1).select(risk.hazard(F.lit(1.0), F.lit(3), F.lit(1.0)), risk.exposure(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0)), risk.exposure(F.lit(1.0), F.lit(1.0), F.lit(0.0)), risk.vulnerability(F.lit(0.95), F.lit(0.0), F.lit(None).cast("double")), risk.vulnerability(F.lit(0.95), F.lit(2000.0), F.lit(0.8)), risk.vulnerability(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))).first()
    assert list(v) == pytest.approx([0.85, 0.75, 0.75, 0.95, 0.8, 0.05])


def test_percentile_ties_nulls_and_negatives(spark):
    ref = frame(spark, [(v,) for v in (-5.0, 0.0, 1.0, 1.0, 1e6, None)], "v double")
    rows = frame(spark, [(i, v) for i, v in enumerate((-6.0, -5.0, 0.5, 1.0, 2e6, None))], "id long, x double")
    got = [r["p"] for r in risk.percentile_of(rows, ref, "x", "p").orderBy("id").collect()]
    assert got == [0.0, 0.2, 0.4, 0.8, 1.0, None]


def test_downwind(spark):
    cells = frame(spark, [(r, c, 1000.0 if (r, c) == (5, 10) else 0.0, b) for r in range(11) for c in range(11) for b in (90.0,)], "row int, col int, v double, b double")
    for bearing, want in ((90.0, 1000.0), (270.0, 0.0), (None, None)):
        got = risk.kernel_sums(cells.drop("b"), 1.0, 1.0, F.lit(bearing).cast("double")).filter("row = 5 and col = 5").first()
        assert got["sector"] == want and got["disk"] == 1000.0


def test_reads(spark):
    for bad in ("1,2,3", "5,0,1,1", "a,b,c,d"):
        with pytest.raises(ValueError):
            read.bbox(bad)
    e = frame(spark, [(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 12)), (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))], "first_seen timestamp_ntz, last_seen timestamp_ntz")
    assert read.overlapping(e, "2024-01-03", "2024-01-04").count() == 1


def test_leakage_and_folds(spark):
    with pytest.raises(ValueError):
        model.check_leakage(["frp_med", "latitude"])
    rows = frame(spark, [(b, i) for b, n in ((1, 5), (2, 3), (3, 3), (4, 1)) for i in range(n)], "block long, i long")
    got = model.folds(rows, "block", 2).groupBy("block").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in got)


def test_files(spark, tmp_path):
    p = tmp_path / "viirs.csv"
    p.write_text("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n10,77,300,1,1,2023-01-01,5,N20,VIIRS,n,2,290,4.5,N\n")
    r = files.read_firms(spark, str(p), "VIIRS").first()
    assert r["sensor"] == "VIIRS_NOAA20" and r["acq_datetime"] == dt.datetime(2023, 1, 1, 0, 5) and r["frp"] == 4.5
    q = tmp_path / "f.csv"
    q.write_text('facility_id,name,tag,wkt\n1,A,landuse=quarry;name=x,"POLYGON ((0 0, 1 0, 1 1, 0 0))"\n')
    r = files.read_facilities(spark, str(q)).first()
    assert r["group"] == "mining" and len(r["ring"]) == 4 and r["ring"][2]["x"] == 1.0
    det = frame(spark, [(1, dt.datetime(2023, 1, 5)), (2, dt.datetime(2023, 3, 5))], "detection_id long, acq_datetime timestamp")
    files.write_detections(det, str(tmp_path / "det"))
    assert [r["detection_id"] for r in files.read_window(spark, str(tmp_path / "det"), "2023-01-01", "2023-02-01").collect()] == [1]
    assert math.isclose(files.read_window(spark, str(tmp_path / "det"), "2023-01-01", "2023-12-31").count(), 2)
