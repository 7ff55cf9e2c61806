"""Readers of the archives' formats, and the tables' writers. Schemas are given, so that a scan never samples a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.ingest import normalise

FIRMS = {
    "VIIRS": "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_ti5 string, frp string, daynight string, type string",
    "MODIS": "latitude string, longitude string, brightness string, scan string, track string, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_t31 string, frp string, daynight string, type string",
}
#: A fit that failed is stored as this or more.
NO_FIT = 999999


def read_firms(spark: SparkSession, path: str, instrument: str) -> DataFrame:
    """Archive or near-real-time CSV of one instrument, normalised; columns are matched by name, so NRT files may lack type."""
    columns = spark.read.option("header", True).csv(path, enforceSchema=False).columns
    wanted = {c.split()[0]: c for c in FIRMS[instrument].split(", ")}
    schema = ", ".join(wanted.get(c, f"`{c}` string") for c in columns)
    return normalise(spark.read.option("header", True).schema(schema).csv(path), instrument)


def read_vnf(spark: SparkSession, path: str) -> DataFrame:
    """Night fire CSV: names in any case, failed fits as null."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    fit = lambda c: F.when(F.expr(f"try_cast({c} as double)") < NO_FIT, F.expr(f"try_cast({c} as double)"))
    at = F.coalesce(F.try_to_timestamp("date_mscan", F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp("date_mscan"))
    return raw.select(at.alias("acq_datetime"), F.expr("try_cast(lat_gmtco as double)").alias("latitude"), F.expr("try_cast(lon_gmtco as double)").alias("longitude"), fit("temp_bb").alias("temp_k"), fit("area_bb").alias("area_m2"), fit("rh").alias("radiant_heat"), F.expr("try_cast(cloud_mask as int)").alias("cloud_mask"), F.col("sat").alias("satellite"))


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """Mapped features with k=v;k=v tags and WKT polygons: facility_id, name, tags, group, ring of longitude and latitude."""
    raw = spark.read.option("header", True).schema("facility_id string, name string, tag string, wkt string").csv(path)
    pair = F.split(F.regexp_replace(F.regexp_extract("wkt", r"\(+([^()]*)\)", 1), r"\s*,\s*", ","), ",")
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    tags = F.str_to_map("tag", F.lit(";"), F.lit("="))
    return raw.select("facility_id", "name", tags.alias("tags"), rules.label_group(tags).alias("group"), F.transform(pair, point).alias("ring")).dropDuplicates(["facility_id"])


def read_plants(spark: SparkSession, path: str, country: str = "IND") -> DataFrame:
    """Power plants of a country that have coordinates, with their asset type."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.expr(f"try_cast({c} as double)")
    out = raw.filter(F.col("country") == country).select("gppd_id", "name", "primary_fuel", number("capacity_mw").alias("capacity_mw"), number("latitude").alias("latitude"), number("longitude").alias("longitude"), rules.lookup(rules.FUEL_ASSET, F.col("primary_fuel")).alias("type"))
    return out.dropna(subset=["latitude", "longitude"])


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Daily cloud GeoJSON, one feature a point: longitude, latitude, day, cloud (0 to 1). Fill values are dropped."""
    raw = spark.read.option("multiLine", True).schema("features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<parameter: map<string, map<string, double>>>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select(F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"), F.explode("f.properties.parameter").alias("name", "days"))
    return f.select("longitude", "latitude", F.explode("days").alias("day", "v")).filter("v >= 0").select("longitude", "latitude", F.to_date("day", "yyyyMMdd").alias("day"), F.least(F.greatest(F.col("v") / 100, F.lit(0.0)), F.lit(1.0)).alias("cloud"))


def wind(spark: SparkSession, path: str) -> DataFrame:
    """(latitude, longitude, day, u, v) of wind files: features of points with maps of days for U10M and V10M; days with the fill value, or with one component only, are left out."""
    point = "geometry: struct<coordinates: array<double>>, properties: struct<parameter: map<string, map<string, double>>>"
    raw = spark.read.option("multiLine", True).schema(f"header struct<fill_value: double>, features array<struct<{point}>>").json(path)
    f = raw.select(F.coalesce("header.fill_value", F.lit(-999.0)).alias("fill"), F.explode("features").alias("f"))
    at = f.select("fill", F.round(F.col("f.geometry.coordinates")[1], 4).alias("latitude"), F.round(F.col("f.geometry.coordinates")[0], 4).alias("longitude"), F.explode("f.properties.parameter").alias("name", "days"))
    each = at.select("fill", "latitude", "longitude", "name", F.explode("days").alias("day", "value")).filter("value IS NOT NULL AND value <> fill")
    part = lambda name: F.max(F.when(F.upper("name") == name, F.col("value")))
    both = each.groupBy("latitude", "longitude", F.to_date("day", "yyyyMMdd").alias("day")).agg(part("U10M").alias("u"), part("V10M").alias("v"))
    return both.filter("u IS NOT NULL AND v IS NOT NULL")


def sample_raster(points: DataFrame, raster: DataFrame, west: float, north: float, step: float, value: str = "v", name: str = "landcover") -> DataFrame:
    """points (latitude, longitude) with the value of their cell of a raster (row, col, v); 0 off the map. One equi-join on (row, col)."""
    at = points.withColumns({"row": F.floor((north - F.col("latitude")) / step).cast("int"), "col": F.floor((F.col("longitude") - west) / step).cast("int")})
    return at.join(raster.select("row", "col", F.col(value).alias(name)), ["row", "col"], "left").fillna(0, [name]).drop("row", "col")


def write_detections(det: DataFrame, path: str) -> None:
    """Append detections, a folder a year and month, so that a window's scan reads its months only."""
    det.withColumns({"year": F.year("acq_datetime"), "month": F.month("acq_datetime")}).repartition("year", "month").write.mode("append").partitionBy("year", "month").parquet(path)


def read_window(spark: SparkSession, path: str, start: str, end: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Detections from start to before end, with the months as a partition filter and the times pushed to the scan."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    month = lambda d: F.year(d) * 12 + F.month(d)
    rows = spark.read.parquet(path).filter((F.col("year") * 12 + F.col("month")).between(month(a), month(b)) & (F.col("acq_datetime") >= F.lit(start).cast("timestamp")) & (F.col("acq_datetime") < F.lit(end).cast("timestamp")))
    if box:
        w, s, e, n = box
        rows = rows.filter(F.col("longitude").between(w, e) & F.col("latitude").between(s, n))
    return rows
