"""Loading rules: normalisation, which product wins, upserts, labels and the match in time and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import spatial

# Fixed values: (instrument, satellite code) and the sensor's name.
SENSORS = {
    "VIIRS|N": "VIIRS_SNPP", "VIIRS|N20": "VIIRS_NOAA20", "VIIRS|N21": "VIIRS_NOAA21",
    "MODIS|Terra": "MODIS_TERRA", "MODIS|T": "MODIS_TERRA", "MODIS|Aqua": "MODIS_AQUA", "MODIS|A": "MODIS_AQUA",
}
NATURAL_KEY = ("sensor", "acq_datetime", "latitude", "longitude")


def normalise(raw: DataFrame, instrument: str) -> DataFrame:
    """Rows of one instrument's CSV (all columns strings) as detections.

    acq_time may have lost its leading zeros; a bad number is null; the product is NRT where the
    version says so. An unknown satellite or a blank version is an error, as silence would mislabel rows.
    """
    hot, cool = ("bright_ti4", "bright_ti5") if instrument == "VIIRS" else ("brightness", "bright_t31")
    has = set(raw.columns)
    number = lambda c: (F.expr(f"try_cast({c} as double)") if c in has else F.lit(None).cast("double"))
    satellite, version = F.trim("satellite"), F.trim(F.coalesce(F.col("version"), F.lit("")))
    sensor = rules.lookup(SENSORS, F.concat(F.lit(f"{instrument}|"), satellite))
    sensor = F.coalesce(sensor, F.raise_error(F.concat(F.lit("unknown satellite: "), F.coalesce(satellite, F.lit("null")))).cast("string"))
    version = F.when(version != "", version).otherwise(F.raise_error(F.lit("blank version")).cast("string"))
    at = F.to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), "yyyy-MM-dd HHmm")
    return raw.select(
        at.alias("acq_datetime"), number("latitude").alias("latitude"), number("longitude").alias("longitude"), sensor.alias("sensor"), F.lit(instrument).alias("instrument"), satellite.alias("satellite"),
        F.when(F.upper("version").contains("NRT"), "NRT").otherwise("SP").alias("product"), version.alias("version"), F.upper(F.trim("daynight")).alias("daynight"), number("frp").alias("frp"), number(hot).alias("bt4"), number(cool).alias("bt5"), number("scan").alias("scan"), number("track").alias("track"),
        F.trim("confidence").alias("confidence"), (F.expr("try_cast(type as smallint)") if "type" in has else F.lit(None).cast("smallint")).alias("firms_type"),
    )


def drop_superseded(det: DataFrame, standard: DataFrame, keys: list[str]) -> DataFrame:
    """det without NRT rows on a day on which `standard` has rows of the same keys. The days are few, the rows are not moved for them if Spark can broadcast them."""
    days = standard.select(*keys, F.to_date("acq_datetime").alias("_day")).distinct()
    here = det.withColumn("_day", F.to_date("acq_datetime"))
    nrt = here.filter("product = 'NRT'").join(days, [*keys, "_day"], "left_anti")
    return here.filter("product <> 'NRT'").unionByName(nrt).drop("_day")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def load(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows of `staged` that a load appends: NRT rows refused on sensor-days that have standard ones, known natural keys left out."""
    fresh = drop_superseded(staged, target.filter("product = 'SP'").unionByName(staged.filter("product = 'SP'"), allowMissingColumns=True), ["sensor"])
    return fresh.dropDuplicates(list(NATURAL_KEY)).join(target.select(*NATURAL_KEY), list(NATURAL_KEY), "left_anti")


def supersede(target: DataFrame, standard: DataFrame) -> DataFrame:
    """target without the NRT rows between the first and last day of each sensor's standard load."""
    span = standard.groupBy("sensor").agg(F.to_date(F.min("acq_datetime")).alias("_a"), F.to_date(F.max("acq_datetime")).alias("_b"))
    inside = (F.col("product") == "NRT") & F.to_date("acq_datetime").between(F.col("_a"), F.col("_b"))
    return target.join(span, "sensor", "left").filter(~F.coalesce(inside, F.lit(False))).drop("_a", "_b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """old with new: new rows replace those of their keys, or (update=False) only fill in. One row a key remains."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return first_per_key(both, keys, F.desc("_p") if update else F.asc("_p")).drop("_p")


def not_logged(work: DataFrame, log: DataFrame) -> DataFrame:
    """Units of work (source, item) that the ingest log does not have."""
    return work.join(log, ["source", "item"], "left_anti")


def nearest_in_time(det: DataFrame, other: DataFrame, radius: float, seconds: int) -> DataFrame:
    """det's nearest `other` (v_id) within radius metres and `seconds`, ties by v_id. t is in microseconds on both sides.

    Time is a bucket too: other rows go to three time slots and nine squares, and one equi-join finds all.
    """
    slot = lambda c: F.floor(F.col(c) / (seconds * 1_000_000))
    bx, by = spatial.bucket(F.col("x"), F.col("y"), radius)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    rhs = other.select("v_id", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("t").alias("vt"), bx.alias("bx"), by.alias("by"), slot("t").alias("bt"), F.explode(steps).alias("s")).select("v_id", "vx", "vy", "vt", (F.col("bx") + F.col("s.i")).alias("_bx"), (F.col("by") + F.col("s.j")).alias("_by"), (F.col("bt") + F.col("s.k")).alias("_bt"))
    d = F.sqrt(F.pow(F.col("x") - F.col("vx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("vy"), F.lit(2.0)))
    pairs = det.withColumns({"_bx": bx, "_by": by, "_bt": slot("t")}).join(rhs, ["_bx", "_by", "_bt"]).withColumn("d", d).filter((F.col("d") <= radius) & (F.abs(F.col("t") - F.col("vt")) <= seconds * 1_000_000))
    return pairs.groupBy("detection_id").agg(F.min(F.struct("d", "v_id")).alias("m")).select("detection_id", "m.v_id", "m.d")


def label_sources(near: DataFrame) -> DataFrame:
    """(source, label_group, label, distance_m, groups_near) from facilities near sources (source, grp, d).

    The first group in the fixed order counts; kiln has no class; groups_near maps every group to its least distance.
    """
    least = near.filter(F.col("grp").isNotNull()).groupBy("source", "grp").agg(F.min("d").alias("d"))
    ranked = F.struct(rules.rank_of(F.col("grp")).alias("rank"), F.col("grp"), F.col("d"))
    out = least.groupBy("source").agg(F.min(ranked).alias("m"), F.map_from_entries(F.collect_list(F.struct("grp", F.rint("d").cast("int")))).alias("groups_near"))
    return out.select("source", F.col("m.grp").alias("label_group"), rules.lookup(rules.CLASS_OF_GROUP, F.col("m.grp")).alias("label"), F.round("m.d", 1).alias("distance_m"), "groups_near")


def biomass_decision(candidates: int, industrial: int, least: int = 30, most: float = 0.5) -> bool:
    """Whether land cover may label recurrent biomass: enough candidates, under half of them on confirmed industry."""
    return candidates >= least and industrial / max(candidates, 1) < most


def label_census(labelled: DataFrame) -> DataFrame:
    """(label_group, n_sources, n_contested): sources by their group, and those that have others near as well."""
    contested = (F.size("groups_near") > 1).cast("int")
    return labelled.groupBy("label_group").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(contested).alias("n_contested"))


def by_product(det: DataFrame) -> DataFrame:
    """(instrument, product, n, first, last) of what was loaded."""
    return det.groupBy("instrument", "product").agg(F.count(F.lit(1)).alias("n"), F.min("acq_datetime").alias("first"), F.max("acq_datetime").alias("last"))


def on_superseded_days(det: DataFrame) -> DataFrame:
    """(sensor, n): near-real-time rows on sensor-days that have standard ones; a clean load has none."""
    day = F.to_date("acq_datetime").alias("day")
    standard = det.filter("product = 'SP'").select("sensor", day).distinct()
    return det.filter("product = 'NRT'").select("sensor", day).join(standard, ["sensor", "day"], "left_semi").groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))
