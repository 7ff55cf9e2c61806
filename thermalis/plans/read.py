"""Read views of the stored tables: filters, series, summaries, features and map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of classes that older clients send.
CLASS_ALIASES = {"refinery": "oil_gas", "steel": "heavy_industry", "power": "heavy_industry", "mine": "mining", "crop": "agricultural"}
#: Tiles are binned below this zoom, on a grid of so many cells a side.
BIN_BELOW, BINS, WORLD = 7, 128, 20037508.342789244


def bbox(text: str) -> tuple[float, float, float, float]:
    """west,south,east,north; ValueError unless strictly ordered and on the globe."""
    try:
        w, s, e, n = map(float, text.split(","))
    except ValueError:
        raise ValueError("bbox needs four numbers") from None
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError("bbox is not west,south,east,north")
    return w, s, e, n


def features(rows: DataFrame, box: str | None = None, start: str | None = None, end: str | None = None, time: str = "acq_datetime", limit: int | None = None, order: list[Column] | None = None, least_risk: float | None = None, **equal) -> DataFrame:
    """rows that meet all given filters, in order, at most `limit`. end is inclusive; names of classes may be old ones."""
    if box:
        w, s, e, n = bbox(box)
        rows = rows.filter(F.col("longitude").between(w, e) & F.col("latitude").between(s, n))
    if start:
        rows = rows.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.filter(F.col(time) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == (CLASS_ALIASES.get(value.lower(), value.lower()) if name.endswith("class") else value))
    if least_risk is not None:
        rows = rows.filter(F.coalesce("risk", F.lit(0.0)) >= least_risk)
    if order:
        rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def overlapping(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events that overlap the days from start to end, both included."""
    until = F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")
    return events.filter((F.col("last_seen") >= F.lit(start).cast("timestamp_ntz")) & (F.col("first_seen") < until))


def daily(det: DataFrame, *keys: str) -> DataFrame:
    """Per day (and keys): peak, count, count of alerts, count at night."""
    return det.groupBy(*keys, F.to_date("acq_datetime").alias("day")).agg(F.max("frp").alias("peak"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("alert").isNotNull()).alias("n_alerts"), F.count_if(F.col("daynight") == "N").alias("n_night"))


def summary(det: DataFrame) -> DataFrame:
    """Counts by sensor with the filters of the dashboard, in one aggregation."""
    return det.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("daynight") == "N").alias("night"), F.count_if(F.col("frp") > 100).alias("hot"), F.max("frp").alias("peak"))


def geojson(lon: Column, lat: Column, *properties: str) -> Column:
    """A point feature as JSON."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * 6378137.0


def tile_bins(rows: DataFrame, z: int) -> DataFrame:
    """(tile_x, tile_y, bin_x, bin_y, n, peak, alerts, sensor) of rows with latitude, longitude, for all tiles of one zoom at once.

    Below zoom BIN_BELOW points are counted in BINS x BINS cells of their tile; above, one bin is a
    point's own place in a 4096 grid. sensor: the commonest, the least on ties.
    """
    grid = BINS if z < BIN_BELOW else 4096
    x, y = web_mercator(F.col("latitude"), F.col("longitude"))
    across, down = (x + WORLD) / (2 * WORLD) * 2**z, (WORLD - y) / (2 * WORLD) * 2**z
    tiled = rows.withColumns({"tile_x": F.floor(across).cast("int"), "tile_y": F.floor(down).cast("int")}).withColumns({"bin_x": F.floor((across - F.col("tile_x")) * grid).cast("int"), "bin_y": F.floor((down - F.col("tile_y")) * grid).cast("int")})
    place = ["tile_x", "tile_y", "bin_x", "bin_y"]
    by = tiled.groupBy(*place, "sensor").agg(F.count(F.lit(1)).alias("k"), F.max("frp").alias("peak"), F.count_if(F.col("frp") > 100).alias("alerts"))
    return by.groupBy(*place).agg(F.sum("k").alias("n"), F.max("peak").alias("peak"), F.sum("alerts").alias("alerts"), F.min(F.struct((-F.col("k")).alias("m"), "sensor"))["sensor"].alias("sensor"))


def in_passes(det: DataFrame, passes_: DataFrame, minutes: int = 20) -> DataFrame:
    """(detection_id, session) of the pass of the same source and sensor that began at most `minutes` before; the earliest, if several.

    The slot of `minutes` is part of the join's key; a pass goes to its own slot and the next, so that a detection meets the passes of two slots only.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (minutes * 60_000_000))
    late = F.unix_micros(F.col("acq_datetime").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    p = passes_.select("source", "sensor", "session", F.col("acq_datetime").alias("_at")).withColumn("_slot", F.explode(F.array(slot("_at"), slot("_at") + 1)))
    rows = det.select("detection_id", "source", "sensor", "acq_datetime", slot("acq_datetime").alias("_slot"))
    return rows.join(p, ["source", "sensor", "_slot"]).filter(late.between(0, minutes * 60_000_000)).groupBy("detection_id").agg(F.min("session").alias("session"))


def latest(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of every key in that order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")
