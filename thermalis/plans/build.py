"""The registry build and the replay as one plan each, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import passes, registry
from ..tables import written


def with_metres(det: DataFrame) -> DataFrame:
    x, y = geo.to_metres(F.col("latitude"), F.col("longitude"))
    return det.withColumns({"x": x, "y": y}).withColumn("cell", geo.cell(F.col("x"), F.col("y")))


def build_registry(det: DataFrame, clear: DataFrame | None = None, months: int = registry.MONTHS, days: int = registry.DAYS, years: int = registry.YEARS) -> dict[str, DataFrame]:
    """cells (cell, x, y, source), sources (fingerprints, centre, hull) and baselines of a history of detections.

    Cells are gated and clustered on VIIRS alone; both instruments are assigned and make baselines.
    det: detection_id, acq_datetime, latitude, longitude, sensor, instrument, daynight, frp, bt4, bt5.
    """
    rows = with_metres(det)
    viirs = rows.filter("instrument = 'VIIRS'")
    keep = registry.gated(registry.recurrence(viirs, "cell", "acq_datetime"), "cell", months, days, years)
    at = viirs.join(keep, "cell", "left_semi").groupBy(F.col("cell").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("weight"))
    at = written(at)
    label, sizes = registry.clusters(at)
    cells = written(at.join(label, "id").select(F.col("id").alias("cell"), "x", "y", F.col("cluster").alias("source")))
    assigned = written(registry.assign(rows.drop("cell"), cells).filter("source is not null"))
    optional = {c: F.lit(None).cast("double") for c in ("vnf_temp_k", "vnf_area_m2") if c not in assigned.columns}
    prints = registry.fingerprints(assigned.filter("instrument = 'VIIRS'").withColumns(optional), sizes.withColumnRenamed("cluster", "source"), clear)
    half = geo.CELL_M / 2
    corners = cells.select("source", F.explode(F.array(*[F.struct((F.col("x") + i * half).alias("x"), (F.col("y") + j * half).alias("y")) for i in (-1, 1) for j in (-1, 1)])).alias("p")).select("source", "p.x", "p.y")
    centre = assigned.groupBy("source").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("acq_datetime").alias("first_seen"), F.max("acq_datetime").alias("last_seen"), F.count(F.lit(1)).alias("n_detections"))
    sources = prints.join(centre, "source").join(registry.hull(corners, "source"), "source")
    return {"cells": cells, "sources": sources, "baselines": passes.baselines(passes.pass_table(assigned)), "assigned": assigned}


def judge(det: DataFrame, cells: DataFrame, base: DataFrame, z_extreme: float = passes.Z_EXTREME, p99_extreme: float = passes.P99_EXTREME) -> DataFrame:
    """The scored passes of a window's detections at registered sources."""
    at = registry.assign(with_metres(det).drop("cell"), cells).filter("source is not null")
    return passes.explained(passes.tiers(passes.scored(passes.pass_table(at), base), z_extreme, p99_extreme))


def inject_spikes(table: DataFrame, multiplier: float, per_source: int = 3, least: int = 40, seed: int = 7) -> DataFrame:
    """table (pass rows: source, acq_datetime, frp) with `spike`: in sources of `least` passes, some by hash are raised to multiplier x the source's median."""
    w = Window.partitionBy("source")
    order = w.orderBy(F.xxhash64("source", "acq_datetime", F.lit(seed)))
    pick = (F.count(F.lit(1)).over(w) >= least) & (F.row_number().over(order) <= per_source)
    return table.withColumns({"spike": pick, "_m": F.median("frp").over(w)}).withColumn("frp", F.when(F.col("spike"), F.greatest("frp", F.col("_m") * multiplier)).otherwise(F.col("frp"))).drop("_m")


def recall(judged: DataFrame, spikes: DataFrame) -> DataFrame:
    """Share of spiked passes that alert, and of the others that do: (alert, recall, false_positives)."""
    both = judged.join(spikes.select("source", "acq_datetime", "spike"), ["source", "acq_datetime"])
    kinds = F.explode(F.array(F.lit("provisional"), F.lit("confirmed"))).alias("kind")
    hit = F.coalesce((F.col("alert") == F.col("kind")), F.lit(False)).cast("int")
    return both.select("*", kinds).groupBy("kind").agg(F.avg(F.when(F.col("spike"), hit)).alias("recall"), F.avg(F.when(~F.col("spike"), hit)).alias("false_positives"))


def pass_stats(det: DataFrame) -> DataFrame:
    """(event, peak_frp, pixels, last, previous): hottest pixel, most pixels in a pass, sums of the last two passes."""
    rows = det.withColumnRenamed("event", "source")
    p = passes.pass_table(rows).withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("acq_datetime"), F.desc("sensor"), F.desc("session"))))
    nth = lambda k: F.max(F.when(F.col("_k") == k, F.col("frp_sum")))
    return p.groupBy(F.col("source").alias("event")).agg(F.max("frp").alias("peak_frp"), F.max("n_det").alias("pixels"), nth(1).alias("last"), nth(2).alias("previous"))
