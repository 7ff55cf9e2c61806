"""Passes, baselines and alert tiers.

A pass is one sensor's detections at one source without a gap of more than 20 minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import season

#: Fixed rules: the gap, the least sample of a baseline, and the two tests of a breach.
GAP_SECONDS, MIN_N, Z_BREACH, P99_BREACH = 20 * 60, 30, 3.5, 1.5
#: The extreme of a single pass.
Z_EXTREME, P99_EXTREME = 7.0, 6.0


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def sessions(det: DataFrame, *keys: str, gap: int = GAP_SECONDS) -> DataFrame:
    """det with `session`: number of its pass among those of its keys, by time. Needs acq_datetime and detection_id (breaks ties)."""
    order = Window.partitionBy(*keys).orderBy("acq_datetime", "detection_id")
    late = micros(F.col("acq_datetime")) - micros(F.lag("acq_datetime").over(order)) > gap * 1_000_000
    return det.withColumn("_new", F.coalesce(late, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(order)).drop("_new")


def pass_table(det: DataFrame) -> DataFrame:
    """One row a pass: source, sensor, session, instrument and daynight of its first detection, first time, hottest pixel, sum and count."""
    first = lambda c: F.min_by(c, F.struct("acq_datetime", "detection_id")).alias(c)
    return sessions(det, "source", "sensor").groupBy("source", "sensor", "session").agg(first("instrument"), first("daynight"), F.min("acq_datetime").alias("acq_datetime"), F.max("frp").alias("frp"), F.sum("frp").alias("frp_sum"), F.count(F.lit(1)).alias("n_det"))


def baselines(passes: DataFrame, least: int = MIN_N) -> DataFrame:
    """(source, key, med, mad, p99, n): of the whole source ('*'), of instrument|daynight, and of that by season.

    A key but '*' needs `least` passes. Null and NaN radiances are left out. Values are rounded to
    three decimals before anything is judged by them. The deviations need the medians, so there are
    two passes over rows that are three times the input; both shuffle on (source, key).
    """
    pair = F.concat_ws("|", "instrument", "daynight")
    keys = F.array(F.lit("*"), pair, F.concat_ws("|", pair, season(F.month("acq_datetime"))))
    rows = passes.filter(F.col("frp").isNotNull() & ~F.isnan("frp")).select("source", "frp", F.explode(keys).alias("key"))
    middle = rows.groupBy("source", "key").agg(F.median("frp").alias("_m"), F.percentile("frp", F.lit(0.99)).alias("_p"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) | (F.col("key") == "*"))
    spread = rows.join(middle, ["source", "key"]).groupBy("source", "key").agg(F.median(F.abs(F.col("frp") - F.col("_m"))).alias("_d"), F.first("_m").alias("_m"), F.first("_p").alias("_p"), F.first("n").alias("n"))
    return spread.select("source", "key", F.round("_m", 3).alias("med"), F.round("_d", 3).alias("mad"), F.round("_p", 3).alias("p99"), "n")


def with_baseline(passes: DataFrame, base: DataFrame, source_wide: bool = False) -> DataFrame:
    """passes with baseline_key, med, mad, p99: by season, else by instrument and daynight, else ('*') if source_wide."""
    pair = F.concat_ws("|", "instrument", "daynight")
    wanted = [F.concat_ws("|", pair, season(F.month("acq_datetime"))), pair] + [F.lit("*")] * source_wide
    out = passes
    for i, w in enumerate(wanted):
        b = base.select(F.col("source").alias("_src"), F.col("key").alias("_key"), F.struct("key", "med", "mad", "p99").alias(f"_b{i}"))
        out = out.join(b, (F.col("source") == F.col("_src")) & (w == F.col("_key")), "left").drop("_src", "_key")
    best = F.coalesce(*[F.col(f"_b{i}") for i in range(len(wanted))])
    return out.withColumns({"baseline_key": best["key"], "med": best["med"], "mad": best["mad"], "p99": best["p99"]}).drop(*[f"_b{i}" for i in range(len(wanted))])


def scored(passes: DataFrame, base: DataFrame) -> DataFrame:
    """passes with their own instrument's baseline, z and ratio_p99; null where there is no baseline."""
    z = 0.6745 * (F.col("frp") - F.col("med")) / F.greatest("mad", F.lit(1e-6))
    return with_baseline(passes, base).withColumns({"z": z, "ratio_p99": F.col("frp") / F.when(F.col("p99") > 0, F.col("p99"))})


def tiers(judged: DataFrame, z_extreme: float = Z_EXTREME, p99_extreme: float = P99_EXTREME, z_breach: float = Z_BREACH, p99_breach: float = P99_BREACH, last: DataFrame | None = None) -> DataFrame:
    """breach, extreme and alert of every scored pass.

    Confirmed: this and the previous judged pass of the source breach, whatever the time between.
    Provisional: one extreme pass. Passes without a baseline neither confirm nor break a chain.
    last: (source, breached) of each source's last judged pass before these.
    """
    beyond = lambda z, p: F.coalesce((F.col("z") > z) & (F.col("frp") > p * F.col("p99")), F.lit(False))
    out = judged.withColumns({"breach": beyond(z_breach, p99_breach), "extreme": beyond(z_extreme, p99_extreme), "_known": F.col("baseline_key").isNotNull()})
    before = F.lit(False)
    if last is not None:
        out, before = out.join(last.select("source", F.col("breached").alias("_last")), "source", "left"), F.coalesce("_last", F.lit(False))
    order = Window.partitionBy("source", "_known").orderBy("acq_datetime", "sensor", "session")
    chained = F.col("breach") & F.coalesce(F.lag("breach").over(order), before)
    alert = F.when(F.col("_known") & chained, "confirmed").when(F.col("_known") & F.col("extreme"), "provisional")
    return out.withColumn("alert", alert).drop("_known", "_last")


def last_state(judged: DataFrame) -> DataFrame:
    """(source, breached): what the next batch must know."""
    return judged.filter(F.col("baseline_key").isNotNull()).groupBy("source").agg(F.max_by("breach", F.struct("acq_datetime", "sensor", "session")).alias("breached"))


def explained(judged: DataFrame) -> DataFrame:
    """With `reason`: the pass in words."""
    head = F.format_string("hottest pixel %.1f MW, %s baseline median %.1f, p99 %.1f", "frp", "baseline_key", "med", "p99")
    z = F.format_string("z %.1f", "z")
    text = (
        F.when(F.col("baseline_key").isNull(), F.format_string("not judged: no %s baseline at this source", "instrument"))
        .when(F.col("alert") == "confirmed", F.concat_ws("; ", F.lit("confirmed, second breach in a row"), head, z))
        .when(F.col("alert") == "provisional", F.concat_ws("; ", F.lit("provisional, one extreme pass"), head, z))
        .when(F.col("breach"), F.concat_ws("; ", F.lit("watch, one breach"), head, z))
        .otherwise(F.concat_ws("; ", F.lit("normal"), head))
    )
    return judged.withColumn("reason", text)
