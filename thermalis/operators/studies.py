"""Studies of what the system would have said: published fires, and one clustering against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

#: Fixed rules: the local time's offset, hours of an event of known and days of one of unknown time, days before it, width of a landscape blob.
OFFSET, KNOWN_H, UNKNOWN_D, LEAD_D, LANDSCAPE_KM = "INTERVAL '05:30' HOUR TO MINUTE", 24, 2, 60, 10.0


def event_windows(rows: DataFrame) -> DataFrame:
    """rows (start: date, start_time: 'HH:MM' or null or blank, end: date or null; local) with start_utc, end_utc and known.

    A known time opens 24 hours, a day alone two days; a published end extends to the end of its day.
    """
    known = F.coalesce(F.trim("start_time") != "", F.lit(False))
    day = F.col("start").cast("timestamp_ntz")
    parts = F.split(F.trim("start_time"), ":")
    minutes = F.when(known, parts[0].cast("int") * 60 + parts[1].cast("int")).otherwise(0)
    start = day + F.make_dt_interval(mins=minutes)
    end = start + F.when(known, F.make_dt_interval(hours=F.lit(KNOWN_H))).otherwise(F.make_dt_interval(days=F.lit(UNKNOWN_D)))
    published = (F.col("end").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    local = rows.withColumns({"known": known, "_a": start, "_b": F.greatest(end, published)})
    return local.withColumns({"start_utc": F.col("_a") - F.expr(OFFSET), "end_utc": F.col("_b") - F.expr(OFFSET)}).drop("_a", "_b")


def flagged(road: Column, category: Column) -> Column:
    """The test of an alarm: industrial off every source, or an alert at one."""
    return ((road == 1) & F.coalesce(category == "industrial", F.lit(False))) | (road == 3)


def _hours(a: Column, b: Column) -> Column:
    return F.round((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9, 1)


def event_outcomes(events: DataFrame, det: DataFrame, most: float, around: float) -> DataFrame:
    """One row for every published event: what the system said within match_m of it in its window, and how often it says so on ordinary days.

    events: event_id, x, y, match_m (at most `most`), start_utc, end_utc, known; det: detection_id, x, y, acq_datetime, road, category,
    frp. The windows of all events are joined at once, by buckets of places; `around` is the distance within which the nearest
    detection of the window is reported. chance is 1 - (1 - p)**days, p being the share of the LEAD_D days before with an alarm.
    """
    t = F.col("r_acq_datetime")
    first = F.date_trunc("day", F.col("start_utc") - F.expr(f"INTERVAL {LEAD_D} DAYS")).cast("timestamp_ntz")
    at = det.select("x", "y", "acq_datetime", "frp", F.col("road").alias("road"), flagged(F.col("road"), F.col("category")).alias("flag"))
    pairs = spatial.near_pairs(events, at, most).filter((F.col("d") <= F.col("match_m")) & (t >= first) & (t < F.col("end_utc")))
    fire, lead = t >= F.col("start_utc"), t < F.col("start_utc")
    hit = fire & F.col("r_flag")
    sums = pairs.groupBy("event_id").agg(
        F.count_if(fire).alias("detections"), F.count_if(hit).alias("hits"), F.count_if(fire & (F.col("r_road") == 2)).alias("routine"), F.min(F.when(fire, t)).alias("_first"), F.min(F.when(hit, t)).alias("_flag"),
        F.max(F.when(fire, F.col("r_frp"))).alias("max_frp"), F.count_if(lead).alias("lead_detections"), F.countDistinct(F.when(lead & F.col("r_flag"), F.to_date(t + F.expr(OFFSET)))).alias("lead_flag_days"),
    )
    close = spatial.near_pairs(events, at.select("x", "y", "acq_datetime"), around).filter((t >= F.col("start_utc")) & (t < F.col("end_utc"))).groupBy("event_id").agg(F.round(F.min("d")).cast("long").alias("nearest_in_window_m"))
    out = events.join(sums, "event_id", "left").join(close, "event_id", "left")
    count = {c: F.coalesce(c, F.lit(0)) for c in ("detections", "hits", "routine", "lead_detections", "lead_flag_days")}
    out = out.withColumns(count)
    days = (F.unix_micros(F.col("end_utc").cast("timestamp")) - F.unix_micros(F.col("start_utc").cast("timestamp"))) / 8.64e10
    said = F.when(F.col("detections") == 0, "no signature").when(F.col("hits") > 0, "flagged").when(F.col("routine") > 0, "routine").otherwise("misclassified")
    return out.select(
        "event_id", "known", "start_utc", "end_utc", said.alias("outcome"), "detections", F.when(F.col("known"), _hours(F.col("_first"), F.col("start_utc"))).alias("first_detection_h"), F.when(F.col("known"), _hours(F.col("_flag"), F.col("start_utc"))).alias("first_flag_h"),
        "max_frp", "nearest_in_window_m", "lead_detections", "lead_flag_days", F.round(1 - F.pow(1 - F.col("lead_flag_days") / LEAD_D, days), 3).alias("chance"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """One row: events, flagged, recall, signature, expected_by_chance, and mean and median hours to the first alarm and detection."""
    hit = F.col("outcome") == "flagged"
    flag_h, seen_h = F.when(hit, F.col("first_flag_h")), F.col("first_detection_h")
    return outcomes.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(hit).alias("flagged"), F.round(F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3).alias("recall"), F.count_if(F.col("detections") > 0).alias("signature"), F.round(F.sum("chance"), 2).alias("expected_by_chance"),
        F.round(F.avg(flag_h), 1).alias("flag_h_mean"), F.round(F.median(flag_h), 1).alias("flag_h_median"), F.round(F.avg(seen_h), 1).alias("seen_h_mean"), F.round(F.median(seen_h), 1).alias("seen_h_median"),
    )


def cluster_widths(points: DataFrame, label: str) -> DataFrame:
    """(label, n, width_km) of the clusters of points (label, x, y); points without a label are in none."""
    return points.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), (F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 1000).alias("width_km"))


def absorption(points: DataFrame) -> DataFrame:
    """(c, a, width_km, contamination): for each gated source c the raw cluster a that most of its points are in (the least on ties), how wide
    it is, and what share of it is in no gated source. points: c, a, x, y, with nulls where a point is in none."""
    both = points.filter("c IS NOT NULL AND a IS NOT NULL").groupBy("c", "a").agg(F.count(F.lit(1)).alias("k"))
    dominant = both.groupBy("c").agg(F.min(F.struct((-F.col("k")).alias("m"), "a"))["a"].alias("a"))
    persistent = both.groupBy("a").agg(F.sum("k").alias("p"))
    return dominant.join(cluster_widths(points, "a"), "a").join(persistent, "a").select("c", "a", "width_km", (1 - F.col("p") / F.col("n")).alias("contamination"))


def region_shares(points: DataFrame, label: str, regions: str, least: int = 1) -> DataFrame:
    """(region, detections, skip_road_a, in_landscape, widest_km) for every region of the array column `regions`, and for all together (null).

    A point is at a source if its cluster has `least` points, and in a landscape blob if that is wider than LANDSCAPE_KM.
    """
    wide = cluster_widths(points, label).filter(F.col("n") >= least).select(label, "width_km")
    each = points.join(wide, label, "left").withColumn("region", F.explode(F.array_append(F.array_distinct(regions), F.lit(None).cast("string"))))
    return each.groupBy("region").agg(F.count(F.lit(1)).alias("detections"), F.round(F.avg(F.col("width_km").isNotNull().cast("int")), 4).alias("skip_road_a"), F.round(F.avg(F.coalesce((F.col("width_km") > LANDSCAPE_KM).cast("int"), F.lit(0))), 4).alias("in_landscape"), F.round(F.coalesce(F.max("width_km"), F.lit(0.0)), 1).alias("widest_km"))


def window_or_default(runs: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """One row (first, last): the asked days, the end included; without an end that of the latest run (run_id, window_end), without a start 30 days before the last."""
    latest = runs.agg(F.max_by("window_end", "run_id").alias("window_end"))
    day = lambda d: F.lit(d).cast("date").cast("timestamp_ntz")
    last = day(end) + F.expr("INTERVAL 1 DAY") if end else F.coalesce(F.col("window_end"), F.localtimestamp())
    return latest.select(last.cast("timestamp_ntz").alias("last")).select((day(start) if start else F.col("last") - F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz").alias("first"), "last")
