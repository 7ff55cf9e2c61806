"""Studies, rasters and weather on hand-made cases and against plain Python."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from thermalis.operators import raster, risk, studies, weather
from thermalis.sources import files


def test_windows_of_published_events(spark):
    d = dt.date(2024, 3, 1)
    rows = spark.createDataFrame([(1, d, "06:30", None), (2, d, None, None), (3, d, "  ", dt.date(2024, 3, 5)), (4, d, "23:00", d)], "event_id long, start date, start_time string, end date")
    got = {r["event_id"]: (r["start_utc"], r["end_utc"], r["known"]) for r in studies.event_windows(rows).collect()}
    at = lambda day, h, m: dt.datetime(2024, 3, day, h, m) if day else dt.datetime(2024, 2, 29, h, m)
    assert got[1] == (at(1, 1, 0), at(2, 1, 0), True) and got[2] == (at(0, 18, 30), at(2, 18, 30), False)
    assert got[3] == (at(0, 18, 30), at(5, 18, 30), False) and got[4] == (at(1, 17, 30), at(2, 17, 30), True)


def test_outcomes_and_chance(spark):
    start = dt.datetime(2024, 3, 1, 12)
    events = spark.createDataFrame([(k, 10_000.0 * k, 0.0, 400, start, start + dt.timedelta(hours=24), True) for k in range(5)], "event_id long, x double, y double, match_m int, start_utc timestamp_ntz, end_utc timestamp_ntz, known boolean")
    h = lambda n: start + dt.timedelta(hours=n)
    det = [
        (1, 100.0, 0.0, h(2), 2, None, 5.0), (2, 399.0, 0.0, h(5), 3, None, 9.0), (3, 401.0, 0.0, h(1), 3, None, 99.0), (4, 0.0, 0.0, h(-30), 1, "industrial", 1.0), (5, 0.0, 0.0, h(-31), 1, "industrial", 1.0), (6, 0.0, 0.0, h(-24 * 70), 3, None, 1.0),
        (7, 10_000.0, 0.0, h(24), 3, None, 1.0), (8, 20_000.0, 0.0, h(1), 2, "industrial", 1.0), (9, 30_000.0, 0.0, h(1), 1, "forest", 1.0), (10, 40_000.0, 0.0, h(0), 1, "industrial", 1.0),
    ]
    table = spark.createDataFrame(det, "detection_id long, x double, y double, acq_datetime timestamp_ntz, road int, category string, frp double")
    found = studies.event_outcomes(events, table, 400.0, 3000.0)
    got = {r["event_id"]: r for r in found.collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {0: "flagged", 1: "no signature", 2: "routine", 3: "misclassified", 4: "flagged"}
    assert (got[0]["detections"], got[0]["first_detection_h"], got[0]["first_flag_h"], got[0]["max_frp"]) == (2, 2.0, 5.0, 9.0)
    # both alarms before it are on one local day; the one of 70 days before is outside
    assert got[0]["lead_flag_days"] == 1 and got[0]["lead_detections"] == 2 and got[0]["chance"] == round(1 / 60, 3) and got[4]["chance"] == 0
    assert got[0]["nearest_in_window_m"] == 100 and got[1]["nearest_in_window_m"] is None
    total = studies.outcome_summary(found).first()
    assert (total["events"], total["flagged"], total["recall"], total["signature"], total["flag_h_mean"]) == (5, 2, 0.4, 4, 2.5)
    assert studies.outcome_summary(found.limit(0)).first()["recall"] is None


def test_absorption_and_shares(spark):
    pts = [(1, 7, 0.0), (1, 7, 100.0), (1, 8, 0.0), (2, 8, 0.0), (None, 8, 20_000.0), (None, 8, 0.0), (3, None, 0.0), (None, None, 0.0)]
    table = spark.createDataFrame([(c, a, x, 0.0, ["all"] + ["odd"] * (k % 2)) for k, (c, a, x) in enumerate(pts)], "c long, a long, x double, y double, regions array<string>")
    got = {r["c"]: (r["a"], r["width_km"], r["contamination"]) for r in studies.absorption(table).collect()}
    assert got == {1: (7, 0.1, 0.0), 2: (8, 20.0, 0.5)}
    shares = {r["region"]: r for r in studies.region_shares(table, "a", "regions", 3).collect()}
    assert shares[None]["detections"] == 8 and shares["all"]["skip_road_a"] == 0.5 and shares["all"]["in_landscape"] == 0.5 and shares["odd"]["detections"] == 4 and shares["odd"]["widest_km"] == 20.0


def test_default_window(spark):
    runs = spark.createDataFrame([(1, dt.datetime(2024, 9, 1)), (3, dt.datetime(2024, 2, 1)), (2, dt.datetime(2024, 5, 1))], "run_id long, window_end timestamp_ntz")
    of = lambda *a: tuple(studies.window_or_default(runs, *a).first())
    assert of(None, None) == (dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1)) and of("2024-01-20", None) == (dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 1))
    assert of(None, "2024-03-31") == (dt.datetime(2024, 3, 2), dt.datetime(2024, 4, 1)) and of("2024-01-01", "2024-01-01") == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    assert studies.window_or_default(runs.limit(0), None, None).first()["last"] is not None


@pytest.mark.parametrize("side", [4, 64])
def test_correlation_against_plain_python(spark, side):
    rng = random.Random(12)
    cells = {(rng.randrange(-9, 40), rng.randrange(-5, 30)): rng.random() for _ in range(300)}
    rows = [(r, c, v, f"tag{r}") for (r, c), v in cells.items()] + [(100, 100, None, "far")]
    offsets = [(r, c, [0] * (r * r + c * c <= 9) + [1] * (c > 0)) for r in range(-3, 4) for c in range(-5, 6)]
    got = {(r["row"], r["col"]): (r["sums"], r["tag"]) for r in raster.correlate(spark.createDataFrame(rows, "row long, col long, v double, tag string"), offsets, 2, side).collect()}
    assert len(got) == len(cells) + 1 and got[100, 100] == ([0.0, 0.0], "far")
    for (r, c), (sums, tag) in got.items():
        want = [sum(cells.get((r + dr, c + dc), 0) for dr, dc, k in offsets if i in k) for i in (0, 1)]
        assert sums == pytest.approx(want) and (tag == f"tag{r}" or tag == "far")


def test_kernel_sums_against_plain_python(spark):
    rng = random.Random(13)
    cells = [(r, c, rng.choice((0.0, 5.0, -3.0, rng.random() * 100))) for r in range(30) for c in range(30) if rng.random() < 0.7]
    table = spark.createDataFrame(cells, "row int, col int, v double")
    got = {(r["row"], r["col"]): (r["disk"], r["sector"]) for r in risk.kernel_sums(table, 1.5, 1.2, F.lit(92.0)).collect()}
    assert {r["sector"] for r in risk.kernel_sums(table, 1.5, 1.2).collect()} == {None}
    for r, c, _ in cells:
        disk = sector = 0.0
        for r2, c2, v in cells:
            north, east = (r - r2) * 1.5, (c2 - c) * 1.2
            d = math.hypot(north, east)
            if v > 0 and d <= 5:
                disk += v
            if v > 0 and 0.5 < d <= 10 and abs((math.degrees(math.atan2(east, north)) - 90 + 180) % 360 - 180) <= 15:
                sector += v
        assert got[r, c] == pytest.approx((disk, sector))


def test_rasters_from_points_and_tiles(spark):
    pts = spark.createDataFrame([(0.5, 9.5, 2.0), (0.9, 9.1, 3.0), (5.0, 0.0, 1.0)], "x double, y double, w double")
    assert sorted(map(tuple, raster.rasterise(pts, 0.0, 10.0, 1.0).collect())) == [(0, 0, 2.0), (10, 5, 1.0)]
    assert sorted(map(tuple, raster.rasterise(pts, 0.0, 10.0, 5.0, F.col("w")).collect())) == [(0, 0, 5.0), (2, 1, 1.0)]
    tiles = spark.createDataFrame([(t, u, r, c, 1000 * t + 100 * u + 10 * r + c) for t in (0, 1) for u in (0, 2) for r in range(6) for c in range(6)], "tile_row int, tile_col int, row int, col int, v int")
    got = {(r["row"], r["col"]): r["v"] for r in raster.mosaic(tiles, 6, 6, 3).collect()}
    assert len(got) == 16 and got[0, 0] == 11 and got[3, 5] == 1000 + 200 + 44 and (0, 2) not in got


def test_wind_files_and_bearings(spark, tmp_path):
    feature = lambda lon, lat, **p: {"geometry": {"coordinates": [lon, lat, 5.0]}, "properties": {"parameter": p}}
    body = {"header": {"fill_value": -999.0}, "features": [feature(70.00004, 20.0, U10M={"20240101": 3.0, "20240102": -999.0}, V10M={"20240101": 3.0, "20240102": 1.0}), feature(70.5, 20.0, U10M={"20240101": -2.0}, V10M={"20240101": 0.0})]}
    (tmp_path / "wind.json").write_text(json.dumps(body))
    winds = files.wind(spark, str(tmp_path / "wind.json"))
    assert sorted((r["latitude"], r["longitude"], r["u"], r["v"]) for r in winds.collect()) == [(20.0, 70.0, 3.0, 3.0), (20.0, 70.5, -2.0, 0.0)]
    at = spark.createDataFrame([(1, 20.1, 70.2, dt.date(2024, 1, 1)), (2, 19.9, 70.4, dt.date(2024, 1, 1)), (3, 20.0, 70.0, dt.date(2024, 1, 2))], "id long, latitude double, longitude double, day date")
    assert {r["id"]: r["bearing"] for r in weather.wind(at, winds, 0.5).collect()} == {1: pytest.approx(45.0), 2: pytest.approx(270.0), 3: None}


def test_sky_ring_takes_the_first_cell_with_a_value(spark):
    day = dt.date(2024, 1, 1)
    cloud = spark.createDataFrame([(55, day, "A", 0.25), (45, day, "D", 0.5), (54, day, "D", 0.9), (66, day, "N", 0.125)], "cell long, day date, daynight string, cloud_frac double")
    places = spark.createDataFrame([("p", 55), ("q", 77)], "key string, cell long")
    got = {(r["key"], r["daynight"]): r["clear"] for r in weather.clear_sky(places, cloud, 10).collect()}
    assert got == {("p", "D"): 0.5, ("p", "N"): 0.875, ("q", "N"): 0.875}
    assert {r["key"]: r["clear"] for r in weather.clear_sky(places, cloud, 10, True).collect()} == {"p": 0.75, "q": 0.875}
