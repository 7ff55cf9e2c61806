"""The registry as it was at a time: cells with the interval in which they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial
from .registry import ASSIGN_M

#: Reach of a promotion into the detections before it.
PRE_PROMOTION_M = 500.0


def versioned(sources: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (source, ...) with valid_from and valid_to, null where open: a cell counts at t if valid_from < t and t < valid_to.

    Sources of the registry (not provisional) count always. A provisional one counts after its promotion until it is retired;
    one without a promotion time counts while it is not retired, so one that is retired never does (valid_to is the beginning of time).
    """
    own = sources.select("source", "provisional", "promoted_at", "retired_at")
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    valid_from = F.when(F.col("provisional"), F.col("promoted_at"))
    valid_to = F.when(F.col("provisional") & F.col("promoted_at").isNull() & F.col("retired_at").isNotNull(), never).when(F.col("provisional"), F.col("retired_at"))
    return cells.join(own, "source").withColumns({"valid_from": valid_from, "valid_to": valid_to}).drop("promoted_at", "retired_at")


def counts_at(time: Column, valid_from: Column, valid_to: Column) -> Column:
    return F.coalesce(valid_from < time, F.lit(True)) & F.coalesce(time < valid_to, F.lit(True))


def live_at(cells: DataFrame, time: Column) -> DataFrame:
    """The versioned cells that count at one time: what a router starts from."""
    return cells.filter(counts_at(time, F.col("valid_from"), F.col("valid_to")))


def assign_as_of(det: DataFrame, cells: DataFrame) -> DataFrame:
    """det (detection_id, x, y, instrument, acq_datetime) with source, provisional and d of the nearest cell that counts at its time, in its instrument's reach; null where there is none."""
    reach = F.when(F.col("instrument") == "VIIRS", ASSIGN_M["VIIRS"]).otherwise(ASSIGN_M["MODIS"])
    rows, at = det.select("detection_id", "x", "y", "acq_datetime", reach.alias("reach")), cells.select("x", "y", "cell", "source", "provisional", "valid_from", "valid_to")
    pairs = spatial.near_pairs(rows, at, max(ASSIGN_M.values()), "d < radius").filter(F.col("d") < F.col("reach"))
    pairs = pairs.filter(counts_at(F.col("acq_datetime"), F.col("r_valid_from"), F.col("r_valid_to")))
    best = pairs.groupBy("detection_id").agg(F.min(F.struct("d", "r_cell", "r_source", "r_provisional")).alias("m"))
    return det.join(best, "detection_id", "left").withColumns({"source": F.col("m.r_source"), "provisional": F.col("m.r_provisional"), "d": F.col("m.d")}).drop("m")


def pre_promotion(det: DataFrame, promoted: DataFrame, cells: DataFrame) -> DataFrame:
    """(detection_id, source): detections off every source that a later promotion belongs to.

    det: detection_id, x, y, acq_datetime, road, source; promoted: source, first_seen (date), promoted_at; cells: cell, x, y,
    source of promoted sources. The nearest cell decides first; only then its source's days, from first seen to promotion.
    """
    open_ = det.filter((F.col("road") == 1) & F.col("source").isNull()).select("detection_id", "x", "y", "acq_datetime")
    near = spatial.nearest(open_, cells.select("x", "y", "cell", "source"), PRE_PROMOTION_M, PRE_PROMOTION_M, "detection_id", "source", "cell").filter("source IS NOT NULL")
    t = F.col("acq_datetime")
    own = near.join(promoted.select("source", "first_seen", "promoted_at"), "source")
    return own.filter((t >= F.col("first_seen").cast("timestamp_ntz")) & (t < F.col("promoted_at"))).select("detection_id", "source")
