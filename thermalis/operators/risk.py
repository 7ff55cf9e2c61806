"""Risk of an event: 100 x hazard^0.40 x exposure^0.35 x vulnerability^0.25, each floored at 0.05."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster, spatial

#: Fixed weights and scales.
H, E, V, FLOOR = 0.40, 0.35, 0.25, 0.05
PIXEL_MIDPOINT, GROWTH_BAND, V_RADIUS_M, ASSET_SCALE, ASSET_RADIUS_KM = 3.0, 0.10, 2000.0, 2.0, 10.0
DISK_KM, SECTOR_KM, SECTORS, INNER_KM = 5.0, 10.0, 12, 0.5


def percentile_of(rows: DataFrame, reference: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`: the share of the reference (column v) at or below their value; null values have null.

    Without sorting all in one task: counts per bucket of a range partition are not needed, as both
    sides are aggregated to distinct values first, and the running sum is taken in two steps, over
    buckets of values and inside each bucket. An empty reference gives 0.
    """
    key = F.col("_v")
    counts = reference.select(F.col("v").cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).unionByName(rows.select(F.col(value).cast("double").alias("_v")).filter("_v is not null").distinct().withColumn("_n", F.lit(0).cast("long")))
    counts = counts.groupBy("_v").agg(F.sum("_n").alias("_n"))
    # buckets: sign and leading bits of the value, in the order of the values
    bucket = F.when(key < 0, -F.floor(F.log2(1 - key) * 256)).otherwise(F.floor(F.log2(1 + key) * 256))
    counts = counts.withColumn("_b", bucket.cast("long"))
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_s").over(Window.partitionBy()))
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy("_v"))
    ranks = counts.withColumn("_in", inside).join(sums, "_b").select("_v", ((F.col("_before") + F.col("_in")) / F.greatest("_all", F.lit(1))).alias(name))
    return rows.join(ranks, rows[value].cast("double") == ranks["_v"], "left").drop("_v")


def growth(last: Column, previous: Column) -> tuple[Column, Column]:
    """(score, word) from the sums of the last two passes; without a positive previous one: seen once."""
    ratio = last / F.when(previous > 0, previous)
    score = F.when(ratio.isNull(), 0.5).when(ratio > 1 + GROWTH_BAND, 1.0).when(ratio < 1 - GROWTH_BAND, 0.0).otherwise(0.5)
    return score, F.when(ratio.isNull(), "seen once").when(score == 1.0, "growing").when(score == 0.0, "shrinking").otherwise("flat")


def clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(FLOOR)), F.lit(1.0))


def hazard(frp_percentile: Column, pixels: Column, growth_score: Column) -> Column:
    return clipped(0.50 * frp_percentile + 0.30 * pixels / (pixels + PIXEL_MIDPOINT) + 0.20 * growth_score)


def exposure(pop5: Column, downwind: Column, asset_weight: Column) -> Column:
    """From the percentiles of people in 5 km and downwind (null: no wind), and the weight of assets in 10 km."""
    a = 1 - F.exp(-asset_weight / ASSET_SCALE)
    return clipped(F.when(downwind.isNotNull(), 0.45 * pop5 + 0.30 * downwind + 0.25 * a).otherwise(0.75 * pop5 + 0.25 * a))


def vulnerability(criticality: Column, distance_m: Column, own: Column) -> Column:
    near = F.coalesce(criticality * F.exp(-distance_m / V_RADIUS_M), F.lit(0.0))
    return clipped(F.greatest(near, F.coalesce(own, F.lit(0.0))))


def score(events: DataFrame, frp_reference: DataFrame, pop_reference: DataFrame, downwind_reference: DataFrame | None) -> DataFrame:
    """events with frp_percentile, growth, hazard, exposure, vulnerability and risk.

    Needs peak_frp, pixels, last, previous, pop5, pop_downwind, asset_weight, nearest_criticality,
    nearest_m and own_criticality; the references have a column v.
    """
    out = percentile_of(events, frp_reference, "peak_frp", "frp_percentile").withColumn("_p", F.log1p("pop5"))
    out = percentile_of(out, pop_reference.select(F.log1p("v").alias("v")), "_p", "pop_5km_percentile")
    if downwind_reference is None:
        out = out.withColumn("pop_downwind_percentile", F.lit(None).cast("double"))
    else:
        out = percentile_of(out.withColumn("_w", F.log1p("pop_downwind")), downwind_reference.select(F.log1p("v").alias("v")), "_w", "pop_downwind_percentile").drop("_w")
    grown, word = growth(F.col("last"), F.col("previous"))
    out = out.withColumns({"growth": word, "hazard": hazard(F.col("frp_percentile"), F.col("pixels"), grown), "exposure": exposure(F.col("pop_5km_percentile"), F.col("pop_downwind_percentile"), F.col("asset_weight")), "vulnerability": vulnerability(F.col("nearest_criticality"), F.col("nearest_m"), F.col("own_criticality"))})
    return out.withColumn("risk", 100 * F.pow("hazard", F.lit(H)) * F.pow("exposure", F.lit(E)) * F.pow("vulnerability", F.lit(V))).drop("_p")


def breakdown() -> Column:
    """The parts of a scored row as JSON."""
    r = lambda c, n: F.round(c, n).alias(c)
    return F.to_json(
        F.struct(
            r("risk", 1),
            F.struct(F.round("hazard", 3).alias("score"), F.round("peak_frp", 1).alias("peak_frp_mw"), r("frp_percentile", 3), F.col("pixels").cast("long").alias("pixels"), "growth").alias("hazard"),
            F.struct(F.round("exposure", 3).alias("score"), F.rint("pop5").cast("long").alias("pop_5km"), r("pop_5km_percentile", 3), F.rint("pop_downwind").cast("long").alias("pop_downwind_10km"), F.round("asset_weight", 2).alias("assets_weighted")).alias("exposure"),
            F.struct(F.round("vulnerability", 3).alias("score"), F.rint("nearest_m").cast("long").alias("distance_m")).alias("vulnerability"),
        )
    )


def unmatched_plants(plants: DataFrame, assets: DataFrame, radius: float = 2000.0, always: str = "nuclear_power_station") -> DataFrame:
    """Plants (id, type, x, y) without an asset of their type within radius, and all of type `always`."""
    matched = spatial.near_pairs(plants, assets, radius).filter("type = r_type").select("id")
    return plants.join(matched, "id", "left_anti").unionByName(plants.filter(F.col("type") == always)).dropDuplicates(["id"])


def kernel_sums(cells: DataFrame, row_km: float, col_km: float, bearing: Column | None = None) -> DataFrame:
    """(row, col, disk, sector) sums of a raster (row, col, v, and a bearing in degrees for `bearing`).

    disk: values within 5 km. sector: those from 0.5 to 10 km whose direction lies within 15 degrees
    of the bearing, rounded to the nearest twelfth (half to even). Only values above 0 count. Blocks of the raster are
    correlated with the disk and with each of the sectors; a cell is copied to the blocks around it, not to the cells.
    """
    reach_r, reach_c = math.ceil(SECTOR_KM / row_km), math.ceil(SECTOR_KM / col_km)
    offsets = []
    for dr in range(-reach_r, reach_r + 1):
        for dc in range(-reach_c, reach_c + 1):
            north, east = -dr * row_km, dc * col_km
            d = math.hypot(north, east)
            if d <= SECTOR_KM:
                sectors = [s + 1 for s in range(SECTORS) if d > INNER_KM and abs((math.degrees(math.atan2(east, north)) - s * 30 + 180) % 360 - 180) <= 15]
                offsets.append((dr, dc, [0] * (d <= DISK_KM) + sectors))
    sector = (F.rint((bearing if bearing is not None else F.lit(None).cast("double")) / 30) % SECTORS).cast("int")
    rows = cells.select("row", "col", F.greatest("v", F.lit(0)).alias("v"), sector.alias("_s"))
    found = raster.correlate(rows, offsets, SECTORS + 1)
    return found.select("row", "col", F.col("sums")[0].alias("disk"), F.when(F.col("_s").isNotNull(), F.get("sums", F.col("_s") + 1)).alias("sector"))


def asset_terms(events: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, nearest_m, nearest_criticality, asset_weight, assets_10km) of events (id, x, y) among assets (asset_id, x, y, criticality).

    The nearest asset counts within V_RADIUS_M (ties: the least id) and is left out of the weight and
    the number within ASSET_RADIUS_KM, as it is what burns. Assets at one place are summed, and the least of
    them is found, before they are joined, and pairs are added up where they are made.
    """
    at = events.select("id", "x", "y")
    least = assets.groupBy("x", "y").agg(F.min(F.struct("asset_id", "criticality")).alias("b")).select("x", "y", "b.*")
    near = spatial.near_pairs(at, least, V_RADIUS_M).groupBy("id").agg(F.min(F.struct("d", "r_asset_id", "r_criticality")).alias("m"))
    places = assets.groupBy("x", "y").agg(F.sum("criticality").alias("w"), F.count(F.lit(1)).alias("n"))
    around = spatial.near_pairs(at, places, ASSET_RADIUS_KM * 1000).groupBy("id").agg(F.sum("r_w").alias("w"), F.sum("r_n").alias("n"))
    zero, own = F.lit(0.0), F.col("m").isNotNull().cast("long")
    weight = F.greatest(F.coalesce("w", zero) - F.coalesce("m.r_criticality", zero), zero)
    count = F.greatest(F.coalesce("n", F.lit(0)) - own, F.lit(0)).cast("long")
    return at.join(near, "id", "left").join(around, "id", "left").select("id", F.col("m.d").alias("nearest_m"), F.col("m.r_criticality").alias("nearest_criticality"), weight.alias("asset_weight"), count.alias("assets_10km"))
