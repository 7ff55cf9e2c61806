"""Cloud and wind at a place: neighbours stand in where a grid cell has no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets of a grid cell's neighbourhood (rows, columns), in the order in which they stand in: itself, sides, corners.
RING = ((0, 0), (-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))


def clear_sky(places: DataFrame, cloud: DataFrame, columns: int, routing: bool = False) -> DataFrame:
    """(key, daynight, day, clear) of places (key, cell), from cloud (cell, day, daynight, cloud_frac).

    Per day the first cell of RING with a value counts. Rows for D and N: by default their own value,
    else that of the whole day ('A'); with `routing` the whole day's value first, else one minus the
    product of what D and N leave. columns: cells of the grid in a row. A key stands in one cell, and so has one row a day.

    Neighbours are looked up once for each different cell, in rows of a day; places are joined last, so that no row of a
    place is shuffled.
    """
    of = lambda k: F.max(F.when(F.col("daynight") == k, 1 - F.col("cloud_frac")))
    days = cloud.groupBy("cell", "day").agg(of("A").alias("a"), of("D").alias("d"), of("N").alias("n"))
    steps = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r * columns + c).alias("by")) for i, (r, c) in enumerate(RING)])
    around = days.select("*", F.explode(steps).alias("s")).withColumn("cell", F.col("cell") - F.col("s.by"))
    own = places.select("key", "cell").distinct()
    first = lambda k: F.min(F.when(F.col(k).isNotNull(), F.struct("s.rank", k)))[k].alias(k)
    best = around.join(own.select("cell").distinct().hint("shuffle_hash"), "cell", "left_semi").groupBy("cell", "day").agg(first("a"), first("d"), first("n"))
    day = best.join(own.hint("shuffle_hash"), "cell")
    if routing:
        both = 1 - (1 - F.coalesce("d", F.lit(0.0))) * (1 - F.coalesce("n", F.lit(0.0)))
        value = F.coalesce("a", F.when(F.coalesce("d", "n").isNotNull(), both))
        return day.select("key", F.lit("A").alias("daynight"), "day", value.alias("clear"))
    rows = F.explode(F.array(F.struct(F.lit("D").alias("k"), F.coalesce("d", "a").alias("v")), F.struct(F.lit("N").alias("k"), F.coalesce("n", "a").alias("v"))))
    return day.select("key", "day", rows.alias("r")).select("key", F.col("r.k").alias("daynight"), "day", F.col("r.v").alias("clear")).filter("clear is not null")


def bearing(u: Column, v: Column) -> Column:
    """Direction into which a wind blows, in degrees from north."""
    return (F.degrees(F.atan2(u, v)) + 360) % 360


def wind(events: DataFrame, winds: DataFrame, step: float) -> DataFrame:
    """events (latitude, longitude, day) with the bearing at the nearest grid point on that day; null without one.

    winds: latitude, longitude, day, u, v on a regular grid of `step` degrees, so the nearest point
    is found by rounding and the join is on keys.
    """
    key = lambda c: F.floor(F.col(c) / step + 0.5).cast("long")
    w = winds.select(key("latitude").alias("_r"), key("longitude").alias("_c"), "day", bearing(F.col("u"), F.col("v")).alias("bearing"))
    return events.withColumns({"_r": key("latitude"), "_c": key("longitude")}).join(w, ["_r", "_c", "day"], "left").drop("_r", "_c")
