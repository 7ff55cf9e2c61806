"""The queries of this library over the driver's tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, rules
from ..operators import asof, evaluate, events, ingest, model, passes, raster, registry, risk, routing, spatial, studies, weather, writes
from ..sources.versions import Versions
from ..streaming import live
from ..tables import shared_path, table, written
from . import build, read
from .views import DETECTIONS, PASS_DETECTIONS, detections, pass_detections, tiers_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


# Passes, baselines, tiers


@query(f"WITH {PASS_DETECTIONS} SELECT source, sensor, session, instrument, daynight, epoch_us(acq_datetime) AS at_us, frp, round(frp_sum, 4) AS frp_sum, n_det FROM passes")
def passes_gap_sessions(spark, sf_dir):
    p = passes.pass_table(pass_detections(spark, sf_dir))
    return p.select("source", "sensor", "session", "instrument", "daynight", passes.micros(F.col("acq_datetime")).alias("at_us"), "frp", _r("frp_sum"), "n_det")


def _history(spark, sf_dir):
    p = passes.pass_table(pass_detections(spark, sf_dir))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return p.filter(F.col("acq_datetime") < cut), p.filter(F.col("acq_datetime") >= cut)


@query(f"WITH {PASS_DETECTIONS} SELECT source, key, med, mad, p99, n FROM base")
def baselines_hierarchical(spark, sf_dir):
    return passes.baselines(_history(spark, sf_dir)[0])


@query(f"WITH {PASS_DETECTIONS} SELECT source, sensor, session, baseline_key, med, mad, p99, round(z, 4) AS z, round(ratio_p99, 4) AS ratio_p99 FROM zed")
def baseline_lookup(spark, sf_dir):
    old, new = _history(spark, sf_dir)
    return passes.scored(new, passes.baselines(old)).select("source", "sensor", "session", "baseline_key", "med", "mad", "p99", _r("z"), _r("ratio_p99"))


def _tiers(spark, sf_dir, **thresholds):
    old, new = _history(spark, sf_dir)
    judged = passes.tiers(passes.scored(new, passes.baselines(old)), **thresholds)
    return judged.select("source", "sensor", "session", "baseline_key", _r("z"), _r("ratio_p99"), "breach", "extreme", "alert")


@query(tiers_sql(3.5, 1.5))
def anomaly_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query(tiers_sql(2.0, 0.5))
def anomaly_tiers_loose(spark, sf_dir):
    return _tiers(spark, sf_dir, z_breach=2.0, p99_breach=0.5)


# Registry

RECURRENCE = "rec AS (SELECT l_partkey AS key, year(l_shipdate) AS year, count(DISTINCT l_shipdate::DATE) AS days, count(DISTINCT month(l_shipdate)) AS months FROM lineitem GROUP BY ALL)"


def _recurrence(spark, sf_dir):
    return registry.recurrence(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key"), "key", "l_shipdate")


@query(f"WITH {RECURRENCE} SELECT key, year::INTEGER AS year, days, months FROM rec")
def recurrence(spark, sf_dir):
    return _recurrence(spark, sf_dir)


@query(f"WITH {RECURRENCE} SELECT key, count(*) FILTER (WHERE months >= 3 AND days >= 4) AS years_passing FROM rec GROUP BY key HAVING years_passing >= 4")
def recurrence_gate(spark, sf_dir):
    return registry.gated(_recurrence(spark, sf_dir), "key", 3, 4, 4)


GATES = [(m, d, y) for m in (2, 3, 4) for d in (3, 4) for y in (2, 4)]


@query(f"""WITH {RECURRENCE}, g(m, d, y) AS (VALUES {', '.join(map(str, GATES))}),
per AS (SELECT key, m, d, y, count(*) FILTER (WHERE months >= m AND days >= d) AS n FROM rec, g GROUP BY ALL)
SELECT m AS months, d AS days, y AS years, count(*) FILTER (WHERE n >= y) AS n_keys FROM per GROUP BY m, d, y""")
def gate_sweep(spark, sf_dir):
    return registry.gate_sweep(_recurrence(spark, sf_dir), "key", GATES)


@query("""WITH d AS (SELECT DISTINCT o_custkey AS source, o_orderdate::DATE AS day FROM orders),
n AS (SELECT source, month(day) AS m, count(*) AS k FROM d GROUP BY ALL),
p AS (SELECT source, m, k / sum(k) OVER (PARTITION BY source) AS p FROM n)
SELECT source, round(sum(-p * ln(p)) / ln(12), 6) AS month_entropy, round(max(p), 6) AS peak_month_share, round(sum(CASE WHEN m BETWEEN 6 AND 9 THEN p ELSE 0 END), 6) AS monsoon_share FROM p GROUP BY source""")
def month_stats(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.to_date("o_orderdate").alias("day"))
    return registry.month_stats(days, "source").select("source", _r("month_entropy", 6), _r("peak_month_share", 6), _r("monsoon_share", 6))


@query("""WITH h AS (SELECT DISTINCT o_custkey AS source, o_orderdate::DATE AS day FROM orders),
s AS (SELECT source, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM h GROUP BY source),
c AS (SELECT source, day, CASE WHEN epoch(day)::BIGINT // 86400 * 31 % 10 < 6 + source % 2 * 2 - source % 3 * 3 THEN (epoch(day)::BIGINT // 86400 * 7 % 11) / 10.0 END AS clear FROM s),
j AS (SELECT c.source, c.clear, h.day IS NOT NULL AS hit FROM c LEFT JOIN h USING (source, day))
SELECT source, round(CASE WHEN avg((clear IS NOT NULL)::INT) >= 0.5 THEN count(*) FILTER (WHERE hit) / (count(*) FILTER (WHERE hit) + coalesce(sum(clear) FILTER (WHERE NOT hit), 0)) END, 6) AS persistence FROM j GROUP BY source""")
def persistence(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.to_date("o_orderdate").alias("day")).distinct()
    days = hits.groupBy("source").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("source", F.explode(F.sequence("a", "b")).alias("day"))
    n = F.unix_date("day").cast("long")
    clear = days.select("source", "day", F.when(n * 31 % 10 < 6 + F.col("source") % 2 * 2 - F.col("source") % 3 * 3, n * 7 % 11 / 10.0).alias("clear"))
    return registry.persistence(hits, clear, "source").select("source", _r("persistence", 6))


@query("""WITH d AS (SELECT l_suppkey AS source, l_shipdate::DATE AS day, l_linestatus = 'O' AS night, l_extendedprice AS frp, l_quantity AS bt4, l_discount AS bt5 FROM lineitem),
m AS (SELECT source, median(frp) AS med FROM d GROUP BY source),
k AS (SELECT source, median(abs(frp - med)) AS frp_mad FROM d JOIN m USING (source) GROUP BY source)
SELECT source, count(*) AS n_det, count(DISTINCT year(day)) AS years_active, round(count(*) / greatest((max(day) - min(day) + 1) / 365.25, 1.0), 4) AS det_per_year, round(avg(night::INT), 6) AS night_share,
  round(median(frp), 4) AS frp_med, round(any_value(frp_mad), 4) AS frp_mad, round(quantile_cont(frp, 0.9), 4) AS frp_p90, round(quantile_cont(frp, 0.99), 4) AS frp_p99, round(any_value(frp_mad) / median(frp), 6) AS frp_robust_cv,
  round(median(frp) FILTER (WHERE night), 4) AS frp_night_med, round(median(frp) FILTER (WHERE NOT night), 4) AS frp_day_med, round(median(bt4 - bt5) FILTER (WHERE night), 4) AS bt45_night_med,
  round(avg((bt5 > 0.05)::INT), 6) AS temp_cov, round(median(CASE WHEN bt5 > 0.05 THEN bt4 END), 4) AS temp_med
FROM d JOIN k USING (source) GROUP BY source""")
def fingerprint_core(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    det = line.select(F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("acq_datetime"), F.when(F.col("l_linestatus") == "O", "N").otherwise("D").alias("daynight"), F.col("l_extendedprice").alias("frp"), F.col("l_quantity").alias("bt4"), F.col("l_discount").alias("bt5"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("vnf_temp_k"), F.lit(None).cast("double").alias("vnf_area_m2"))
    sizes = det.select("source").distinct().select("source", F.lit(1).alias("n_cells"), F.lit(0.5).alias("width_km"))
    return registry.fingerprints(det, sizes).select("source", "n_det", "years_active", _r("det_per_year"), _r("night_share", 6), _r("frp_med"), _r("frp_mad"), _r("frp_p90"), _r("frp_p99"), _r("frp_robust_cv", 6), _r("frp_night_med"), _r("frp_day_med"), _r("bt45_night_med"), _r("temp_cov", 6), _r("temp_med"))


@query("SELECT l_partkey AS label, l_suppkey AS old_id, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) USING (l_orderkey) GROUP BY ALL")
def id_overlaps(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return registry.overlaps(*_sides(line, line))


def _sides(new, old):
    cell = F.col("l_orderkey").alias("cell")
    return new.select(cell, F.col("l_partkey").alias("label")), old.select(cell, F.col("l_suppkey").alias("old_id"))


@query(None)
def id_matching(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return registry.match_overlaps(*_sides(line, line))


@query("""WITH n AS (SELECT l_suppkey AS source, l_partkey % 7 AS landcover, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT source, landcover, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, landcover) AS r FROM n) WHERE r = 1""")
def majority_mode(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 7).alias("landcover"))
    return registry.majority(line, "source", "landcover")


# Space

LATLON = "ll AS (SELECT event_id AS id, 8 + event_id * 7919 % 28000 / 1000.0 AS lat, 69 + event_id * 104729 % 27000 / 1000.0 AS lon FROM events)"


def _latlon(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), (8 + e * 7919 % 28000 / 1000.0).alias("lat"), (69 + e * 104729 % 27000 / 1000.0).alias("lon"))


@query(f"""WITH {LATLON}, p AS (SELECT *, radians(lat) AS f, {geo.E!r} * sin(radians(lat)) AS s FROM ll),
q AS (SELECT id, {geo.SCALE!r} * pow(tan(pi() / 4 - f / 2) / pow((1 - s) / (1 + s), {geo.E / 2!r}), {geo.N!r}) AS rho, radians(lon - {geo.LON0}) * {geo.N!r} AS theta FROM p),
m AS (SELECT id, rho * sin(theta) + {geo.X0} AS x, {geo.RHO0 + geo.Y0!r} - rho * cos(theta) AS y FROM q)
SELECT id, round(x, 1) AS x, round(y, 1) AS y, floor(x / 375)::BIGINT * 100000 + floor(y / 375)::BIGINT AS cell FROM m""")
def cells_and_projection(spark, sf_dir):
    x, y = geo.to_metres(F.col("lat"), F.col("lon"))
    return _latlon(spark, sf_dir).select("id", x.alias("x"), y.alias("y")).select("id", _r("x", 1), _r("y", 1), geo.cell(F.col("x"), F.col("y")).alias("cell"))


@query(f"WITH {LATLON} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ll")
def projection_round_trip(spark, sf_dir):
    lat, lon = geo.from_metres(*geo.to_metres(F.col("lat"), F.col("lon")))
    return _latlon(spark, sf_dir).select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"""WITH {LATLON} SELECT id, floor(90 - lat)::BIGINT * 360 + floor(lon + 180)::BIGINT AS one, floor((90 - lat) / 0.25)::BIGINT * 1440 + floor((lon + 180) / 0.25)::BIGINT AS quarter,
  'N' || lpad((floor(lat / 3) * 3)::INT::VARCHAR, 2, '0') || 'E' || lpad((floor(lon / 3) * 3)::INT::VARCHAR, 3, '0') AS tile FROM ll""")
def grid_ids(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return _latlon(spark, sf_dir).select("id", geo.grid_cell(lat, lon, 1.0).alias("one"), geo.grid_cell(lat, lon, 0.25).alias("quarter"), geo.tile_name(lat, lon).alias("tile"))


PLACES = f"WITH RECURSIVE {DETECTIONS}, pts AS (SELECT detection_id AS id, x, y, 1 + detection_id % 3 AS weight FROM det)"


def _places(spark, sf_dir):
    return detections(spark, sf_dir).select(F.col("detection_id").alias("id"), "x", "y", (1 + F.col("detection_id") % 3).alias("weight"))


@query(f"""{PLACES}, e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON abs(a.x - b.x) <= 90 AND abs(a.y - b.y) <= 90 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 90),
r AS (SELECT id, id AS comp FROM pts UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id)
SELECT id, min(comp) AS comp FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    return spatial.components_within(_places(spark, sf_dir), 90.0)


@query(f"""{PLACES}, e AS (SELECT a.id AS a, b.id AS b, b.weight AS w FROM pts a JOIN pts b ON abs(a.x - b.x) <= 90 AND abs(a.y - b.y) <= 90 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 90),
c AS (SELECT a AS id, sum(w) >= 5 AS core FROM e GROUP BY a),
ce AS (SELECT e.a, e.b FROM e JOIN c p ON p.id = a JOIN c q ON q.id = b WHERE p.core AND q.core),
r AS (SELECT id, id AS comp FROM c WHERE core UNION SELECT ce.b, r.comp FROM r JOIN ce ON ce.a = r.id),
l AS (SELECT id, min(comp) AS comp FROM r GROUP BY id)
SELECT c.id, any_value(core) AS core, min(l.comp) AS cluster FROM c JOIN e ON e.a = c.id LEFT JOIN l ON l.id = e.b GROUP BY c.id""")
def weighted_dbscan(spark, sf_dir):
    return spatial.weighted_dbscan(_places(spark, sf_dir), 90.0, 5)


@query(f"{PLACES} SELECT a.id, count(*) AS neighbours FROM pts a JOIN pts b ON abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 120 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 120 GROUP BY a.id")
def neighbours_count(spark, sf_dir):
    return spatial.neighbours_within(_places(spark, sf_dir), 120.0).withColumnRenamed("n", "neighbours")


@query(f"""WITH {DETECTIONS}, cells AS (SELECT min(detection_id) AS cell, min(x) AS x, min(y) AS y, min(source) AS source FROM det GROUP BY floor(x / 375), floor(y / 375)),
p AS (SELECT d.detection_id, c.source, c.cell, sqrt(pow(d.x - c.x, 2) + pow(d.y - c.y, 2)) AS d FROM det d JOIN cells c ON abs(d.x - c.x) < 200 AND abs(d.y - c.y) < 200
  WHERE sqrt(pow(d.x - c.x, 2) + pow(d.y - c.y, 2)) < CASE WHEN instrument = 'VIIRS' THEN 100 ELSE 200 END),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY d, cell) AS r FROM p) WHERE r = 1)
SELECT det.detection_id, b.source, round(b.d, 4) AS d FROM det LEFT JOIN b USING (detection_id)""")
def knn_assign(spark, sf_dir):
    det = detections(spark, sf_dir)
    cells = det.groupBy(*spatial.bucket(F.col("x"), F.col("y"), 375.0)).agg(F.min("detection_id").alias("cell"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("source").alias("source")).select("cell", "x", "y", "source")
    reach = F.when(F.col("instrument") == "VIIRS", 100.0).otherwise(200.0)
    return spatial.nearest(det.drop("source"), cells, reach, 200.0, "detection_id", "source", "cell").select("detection_id", "source", _r("d"))


@query(f"""WITH {DETECTIONS}, v AS (SELECT detection_id AS v_id, acq_datetime AS v_at, x, y FROM det WHERE instrument = 'MODIS'),
p AS (SELECT d.detection_id, v.v_id, sqrt(pow(d.x - v.x, 2) + pow(d.y - v.y, 2)) AS d FROM det d JOIN v ON abs(d.x - v.x) <= 750 AND abs(d.y - v.y) <= 750
  AND abs(epoch_us(d.acq_datetime) - epoch_us(v.v_at)) <= 1800000000 WHERE daynight = 'N' AND instrument = 'VIIRS' AND sqrt(pow(d.x - v.x, 2) + pow(d.y - v.y, 2)) <= 750)
SELECT detection_id, v_id, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY d, v_id) AS r FROM p) WHERE r = 1""")
def time_space_nearest(spark, sf_dir):
    det = detections(spark, sf_dir)
    night = det.filter("daynight = 'N' and instrument = 'VIIRS'").select("detection_id", "x", "y", passes.micros(F.col("acq_datetime")).alias("t"))
    other = det.filter("instrument = 'MODIS'").select(F.col("detection_id").alias("v_id"), "x", "y", passes.micros(F.col("acq_datetime")).alias("t"))
    return ingest.nearest_in_time(night, other, 750.0, 1800).select("detection_id", "v_id", _r("d"))


@query(f"""WITH {DETECTIONS}, a AS (SELECT detection_id AS id, sensor AS type, x, y FROM det WHERE daynight = 'D'), p AS (SELECT detection_id AS id, sensor AS type, x, y FROM det WHERE daynight = 'N')
SELECT id, type FROM p WHERE type = 'error' OR NOT EXISTS (SELECT 1 FROM a WHERE a.type = p.type AND sqrt(pow(a.x - p.x, 2) + pow(a.y - p.y, 2)) <= 200)""")
def not_exists_spatial(spark, sf_dir):
    det = detections(spark, sf_dir).select(F.col("detection_id").alias("id"), F.col("sensor").alias("type"), "x", "y", "daynight")
    by_day, by_night = (det.filter(F.col("daynight") == k).drop("daynight") for k in "DN")
    return risk.unmatched_plants(by_night, by_day, 200.0, "error").select("id", "type")


# Ingest


@query(f"""WITH {DETECTIONS}, d AS (SELECT *, CASE WHEN detection_id % 3 = 0 THEN 'NRT' ELSE 'SP' END AS product, floor(x / 300) * 300 AS gx, date_trunc('hour', acq_datetime) AS h FROM det),
k AS (SELECT d.* FROM d WHERE product = 'SP' OR NOT EXISTS (SELECT 1 FROM d s WHERE s.product = 'SP' AND s.sensor = d.sensor AND s.acq_datetime::DATE = d.acq_datetime::DATE AND s.source % 9 = 0 AND s.source % 9 = d.source % 9))
SELECT detection_id, product FROM (SELECT *, row_number() OVER (PARTITION BY sensor, h, gx, source ORDER BY detection_id) AS r FROM k) WHERE r = 1""")
def sp_nrt_dedupe(spark, sf_dir):
    det = detections(spark, sf_dir).withColumns({"product": F.when(F.col("detection_id") % 3 == 0, "NRT").otherwise("SP"), "zone": F.col("source") % 9, "gx": F.floor(F.col("x") / 300) * 300, "h": F.date_trunc("hour", "acq_datetime")})
    standard = det.filter("product = 'SP' and zone = 0")
    kept = ingest.drop_superseded(det, standard, ["sensor", "zone"])
    return ingest.first_per_key(kept, ["sensor", "h", "gx", "source"], "detection_id").select("detection_id", "product")


PRODUCTS = "d AS (SELECT *, CASE WHEN detection_id % 3 = 0 THEN 'NRT' ELSE 'SP' END AS product FROM det)"


def _products(spark, sf_dir):
    return detections(spark, sf_dir).withColumn("product", F.when(F.col("detection_id") % 3 == 0, "NRT").otherwise("SP"))


@query(f"WITH {DETECTIONS}, {PRODUCTS} SELECT instrument, product, count(*) AS n, epoch_us(min(acq_datetime)) AS first_us, epoch_us(max(acq_datetime)) AS last_us FROM d GROUP BY ALL")
def ingest_by_product(spark, sf_dir):
    found = ingest.by_product(_products(spark, sf_dir))
    return found.select("instrument", "product", "n", passes.micros(F.col("first")).alias("first_us"), passes.micros(F.col("last")).alias("last_us"))


@query(f"""WITH {DETECTIONS}, {PRODUCTS} SELECT sensor, count(*) AS n FROM d WHERE product = 'NRT' AND EXISTS (SELECT 1 FROM d s WHERE s.product = 'SP' AND s.sensor = d.sensor AND s.acq_datetime::DATE = d.acq_datetime::DATE) GROUP BY sensor""")
def nrt_on_sp_days(spark, sf_dir):
    return ingest.on_superseded_days(_products(spark, sf_dir))


@query("""WITH u AS (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS p FROM orders UNION ALL SELECT o_orderkey * 2, o_custkey, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC) AS r FROM u) WHERE r = 1""")
def upsert_keep_latest(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.filter("o_orderkey % 7 = 0").withColumns({"o_orderkey": F.col("o_orderkey") * 2, "o_totalprice": F.col("o_totalprice") + 1})
    return ingest.upsert(old, new, ["o_orderkey"])


@query("""WITH t AS (SELECT p_partkey, lower(p_type) AS ty, p_size FROM part)
SELECT p_partkey, CASE WHEN ty IN ('economy') THEN 'oil_gas' WHEN p_size % 5 = 0 AND regexp_matches(lower(ty), 'steel|standard') THEN 'steel_cement'
  WHEN p_size % 5 = 1 THEN 'mining' WHEN p_size % 5 = 2 THEN 'kiln' WHEN p_size % 5 = 3 OR p_size % 5 = 0 THEN 'industrial_other' END AS label_group FROM t""")
def regex_rules(spark, sf_dir):
    kind, n = F.lower("p_type"), F.col("p_size") % 5
    tags = F.create_map(F.lit("industrial"), F.when(kind == "economy", "refinery").when(n == 2, "brickyard").otherwise(""), F.lit("man_made"), F.when(n == 0, "works").otherwise(""), F.lit("product"), F.when(kind == "standard", "steel").otherwise("tiles"), F.lit("landuse"), F.when(n == 1, "quarry").when(n == 3, "industrial").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", rules.label_group(tags).alias("label_group"))


@query("""WITH g AS (SELECT p_size AS source, ['oil_gas', 'steel_cement', 'thermal_power', 'mining', 'kiln', 'industrial_other'][(p_partkey % 6 + 1)::INT] AS grp, p_partkey % 6 + 1 AS rank, p_retailprice AS d FROM part WHERE p_partkey % 6 >= p_size % 6),
n AS (SELECT source, grp, any_value(rank) AS rank, min(d) AS d FROM g GROUP BY source, grp)
SELECT source, grp AS label_group, CASE grp WHEN 'oil_gas' THEN 'oil_gas' WHEN 'mining' THEN 'mining' WHEN 'kiln' THEN NULL ELSE 'heavy_industry' END AS label, round(d, 1) AS distance_m, n_groups FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS r, count(*) OVER (PARTITION BY source) AS n_groups FROM n) WHERE r = 1""")
def label_priority(spark, sf_dir):
    n = F.col("p_partkey") % 6
    near = table(spark, sf_dir, "part").filter(n >= F.col("p_size") % 6).select(F.col("p_size").alias("source"), F.element_at(F.array(*map(F.lit, rules.GROUP_ORDER)), (n + 1).cast("int")).alias("grp"), F.col("p_retailprice").alias("d"))
    return ingest.label_sources(near).select("source", "label_group", "label", "distance_m", F.size("groups_near").cast("long").alias("n_groups"))


@query("""WITH g AS (SELECT p_size AS source, ['oil_gas', 'steel_cement', 'thermal_power', 'mining', 'kiln', 'industrial_other'][(p_partkey % 6 + 1)::INT] AS grp, p_partkey % 6 + 1 AS rank FROM part WHERE p_partkey % 6 >= p_size % 6),
n AS (SELECT source, grp, any_value(rank) AS rank FROM g GROUP BY source, grp),
f AS (SELECT grp, row_number() OVER (PARTITION BY source ORDER BY rank) AS r, count(*) OVER (PARTITION BY source) AS k FROM n)
SELECT grp AS label_group, count(*) AS n_sources, count(*) FILTER (WHERE k > 1) AS n_contested FROM f WHERE r = 1 GROUP BY grp""")
def label_census(spark, sf_dir):
    n = F.col("p_partkey") % 6
    near = table(spark, sf_dir, "part").filter(n >= F.col("p_size") % 6).select(F.col("p_size").alias("source"), F.element_at(F.array(*map(F.lit, rules.GROUP_ORDER)), (n + 1).cast("int")).alias("grp"), F.col("p_retailprice").alias("d"))
    return ingest.label_census(ingest.label_sources(near))


# Risk


@query("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders), k AS (SELECT o_totalprice AS v, count(*) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY v),
r AS (SELECT v, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS n FROM k)
SELECT id, round((coalesce(upto, 0) / (SELECT sum(k) FROM k))::DOUBLE, 6) AS rank FROM o ASOF LEFT JOIN r ON o.v >= r.v""")
def empirical_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    probes = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    ref = o.filter("o_orderstatus = 'F'").select(F.col("o_totalprice").alias("v"))
    return risk.percentile_of(probes, ref, "v", "rank").select("id", _r("rank", 6))



@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
e AS (SELECT o_custkey AS id, max(o_totalprice) AS peak, count(*) AS pixels, max(o_totalprice) FILTER (WHERE k = 1) AS last, max(o_totalprice) FILTER (WHERE k = 2) AS prev FROM r GROUP BY o_custkey),
c AS (SELECT e.*, c_acctbal AS bal, c_nationkey AS nk, cume_dist() OVER (ORDER BY peak) AS f, cume_dist() OVER (ORDER BY ln(1 + greatest(c_acctbal, 0))) AS p5 FROM e JOIN customer ON c_custkey = id),
h AS (SELECT *, CASE WHEN prev IS NULL OR prev <= 0 THEN 0.5 WHEN last / prev > 1.1 THEN 1.0 WHEN last / prev < 0.9 THEN 0.0 ELSE 0.5 END AS g FROM c),
s AS (SELECT id, least(greatest(0.5 * f + 0.3 * pixels / (pixels + 3.0) + 0.2 * g, 0.05), 1.0) AS hazard, least(greatest(0.75 * p5 + 0.25 * (1 - exp(-(nk / 5.0) / 2.0)), 0.05), 1.0) AS exposure, least(greatest(0.9 * exp(-(nk * 100.0) / 2000.0), 0.05), 1.0) AS vulnerability FROM h)
SELECT id, round(hazard, 6) AS hazard, round(exposure, 6) AS exposure, round(vulnerability, 6) AS vulnerability, round(100 * pow(hazard, 0.4) * pow(exposure, 0.35) * pow(vulnerability, 0.25), 4) AS risk FROM s""")
def risk_score(spark, sf_dir):
    return _risk(spark, sf_dir).select("id", _r("hazard", 6), _r("exposure", 6), _r("vulnerability", 6), _r("risk"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
e AS (SELECT o_custkey AS id, max(o_totalprice) AS peak, count(*) AS pixels, max(o_totalprice) FILTER (WHERE k = 1) AS last, max(o_totalprice) FILTER (WHERE k = 2) AS prev FROM r GROUP BY o_custkey),
c AS (SELECT e.*, c_acctbal AS bal, c_nationkey AS nk, cume_dist() OVER (ORDER BY peak) AS f, cume_dist() OVER (ORDER BY ln(1 + greatest(c_acctbal, 0))) AS p5 FROM e JOIN customer ON c_custkey = id),
h AS (SELECT *, CASE WHEN prev IS NULL OR prev <= 0 THEN 0.5 WHEN last / prev > 1.1 THEN 1.0 WHEN last / prev < 0.9 THEN 0.0 ELSE 0.5 END AS g FROM c),
s AS (SELECT id, least(greatest(0.5 * f + 0.3 * pixels / (pixels + 3.0) + 0.2 * g, 0.05), 1.0) AS hazard, least(greatest(0.75 * p5 + 0.25 * (1 - exp(-(nk / 5.0) / 2.0)), 0.05), 1.0) AS exposure, least(greatest(0.9 * exp(-(nk * 100.0) / 2000.0), 0.05), 1.0) AS vulnerability FROM h)
SELECT id, round(100 * pow(hazard, 0.4) * pow(exposure, 0.35) * pow(vulnerability, 0.25), 4) AS risk FROM s ORDER BY risk DESC NULLS LAST, id LIMIT 10""")
def top_risk_events(spark, sf_dir):
    return read.features(_risk(spark, sf_dir).select("id", _r("risk")), order=[F.desc_nulls_last("risk"), F.asc("id")], limit=10)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
e AS (SELECT o_custkey AS id, max(o_totalprice) AS peak, count(*) AS pixels, max(o_totalprice) FILTER (WHERE k = 1) AS last, max(o_totalprice) FILTER (WHERE k = 2) AS prev FROM r GROUP BY o_custkey),
c AS (SELECT e.*, c_acctbal AS bal, c_nationkey AS nk, cume_dist() OVER (ORDER BY peak) AS f, cume_dist() OVER (ORDER BY ln(1 + greatest(c_acctbal, 0))) AS p5 FROM e JOIN customer ON c_custkey = id),
h AS (SELECT *, CASE WHEN prev IS NULL OR prev <= 0 THEN 0.5 WHEN last / prev > 1.1 THEN 1.0 WHEN last / prev < 0.9 THEN 0.0 ELSE 0.5 END AS g FROM c),
s AS (SELECT id, least(greatest(0.5 * f + 0.3 * pixels / (pixels + 3.0) + 0.2 * g, 0.05), 1.0) AS hazard, least(greatest(0.75 * p5 + 0.25 * (1 - exp(-(nk / 5.0) / 2.0)), 0.05), 1.0) AS exposure, least(greatest(0.9 * exp(-(nk * 100.0) / 2000.0), 0.05), 1.0) AS vulnerability FROM h),
k AS (SELECT round(100 * pow(hazard, 0.4) * pow(exposure, 0.35) * pow(vulnerability, 0.25), 4) AS risk, CASE WHEN hazard >= 0.6 THEN 'strong' WHEN exposure <= 0.2 THEN 'remote' ELSE 'other' END AS grp FROM s)
SELECT grp, count(*) AS n, max(risk) AS max_risk, round(quantile_cont(risk, 0.5), 4) AS median_risk FROM k GROUP BY grp""")
def risk_by_group(spark, sf_dir):
    group = F.when(F.col("hazard") >= 0.6, "strong").when(F.col("exposure") <= 0.2, "remote").otherwise("other")
    return evaluate.by_group(_risk(spark, sf_dir).withColumn("risk", F.round("risk", 4)), group).select("grp", "n", "max_risk", _r("median_risk"))


def _risk(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    price = F.col("o_totalprice")
    e = o.withColumn("k", k).groupBy(F.col("o_custkey").alias("id")).agg(F.max(price).alias("peak_frp"), F.count(F.lit(1)).alias("pixels"), F.max(F.when(F.col("k") == 1, price)).alias("last"), F.max(F.when(F.col("k") == 2, price)).alias("previous"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("pop5"), (F.col("c_nationkey") / 5.0).alias("asset_weight"), (F.col("c_nationkey") * 100.0).alias("nearest_m"))
    rows = e.join(cust, "id").withColumns({"pop_downwind": F.lit(None).cast("double"), "nearest_criticality": F.lit(0.9), "own_criticality": F.lit(None).cast("double")})
    return risk.score(rows, rows.select(F.col("peak_frp").alias("v")), rows.select(F.col("pop5").alias("v")), None)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
e AS (SELECT o_custkey AS id, count(*) AS pixels, max(o_totalprice) AS peak, max(o_totalprice) FILTER (WHERE k = 1) AS last, max(o_totalprice) FILTER (WHERE k = 2) AS prev FROM r GROUP BY o_custkey)
SELECT id, pixels, round(peak, 1) AS peak, CASE WHEN prev IS NULL OR prev <= 0 THEN 'seen once' WHEN last / prev > 1.1 THEN 'growing' WHEN last / prev < 0.9 THEN 'shrinking' ELSE 'flat' END AS growth FROM e JOIN customer ON c_custkey = id""")
def risk_breakdown_json(spark, sf_dir):
    j = _risk(spark, sf_dir).select("id", risk.breakdown().alias("j"))
    get = lambda p: F.get_json_object("j", p)
    return j.select("id", get("$.hazard.pixels").cast("long").alias("pixels"), get("$.hazard.peak_frp_mw").cast("double").alias("peak"), get("$.hazard.growth").alias("growth"))


ASSETS = """f AS (SELECT p_partkey AS a, (3000000 + p_partkey % 15 * 5000 + p_partkey * 7919 % 900)::DOUBLE AS fx, (2000000 + p_partkey // 15 % 10 * 5000 + p_partkey * 104729 % 900)::DOUBLE AS fy, (p_partkey % 5 + 1) / 5.0 AS crit FROM part),
e AS (SELECT source AS id, min(x) AS x, min(y) AS y FROM det GROUP BY source)"""


def _assets(spark, sf_dir):
    p = F.col("p_partkey")
    x, y = (3_000_000 + p % 15 * 5000 + p * 7919 % 900).cast("double"), (2_000_000 + F.expr("p_partkey div 15") % 10 * 5000 + p * 104729 % 900).cast("double")
    return table(spark, sf_dir, "part").select(p.alias("asset_id"), x.alias("x"), y.alias("y"), ((p % 5 + 1) / 5.0).alias("criticality"))


def _incidents(spark, sf_dir):
    return detections(spark, sf_dir).groupBy(F.col("source").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))


@query(f"""WITH {DETECTIONS}, {ASSETS}, p AS (SELECT id, a, crit, sqrt(pow(x - fx, 2) + pow(y - fy, 2)) AS d FROM e JOIN f ON abs(x - fx) <= 10000 AND abs(y - fy) <= 10000),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, a) AS r FROM p WHERE d <= 2000) WHERE r = 1),
w AS (SELECT id, sum(crit) AS w, count(*) AS k FROM p WHERE d <= 10000 GROUP BY id)
SELECT e.id, round(n.d, 4) AS nearest_m, round(n.crit, 4) AS nearest_criticality, round(greatest(coalesce(w, 0) - coalesce(n.crit, 0), 0), 4) AS asset_weight, greatest(coalesce(k, 0) - (n.a IS NOT NULL)::INT, 0)::BIGINT AS assets_10km FROM e LEFT JOIN n USING (id) LEFT JOIN w USING (id)""")
def asset_terms(spark, sf_dir):
    return risk.asset_terms(_incidents(spark, sf_dir), _assets(spark, sf_dir)).select("id", _r("nearest_m"), _r("nearest_criticality"), _r("asset_weight"), "assets_10km")


@query(f"""WITH {DETECTIONS}, {ASSETS}, p AS (SELECT DISTINCT id, a FROM e JOIN f ON abs(x - fx) <= 400 AND abs(y - fy) <= 400 WHERE sqrt(pow(x - fx, 2) + pow(y - fy, 2)) <= 400),
k AS (SELECT id, count(*) AS k FROM p GROUP BY id),
o AS (SELECT avg((a IN (SELECT a FROM p))::INT) FILTER (WHERE a % 3 = 0) AS recall_active, avg((a IN (SELECT a FROM p))::INT) AS recall_all FROM f)
SELECT round(recall_active, 6) AS recall_active, round(recall_all, 6) AS recall_all, (SELECT round(avg((id IN (SELECT id FROM k))::INT), 6) FROM e) AS on_object, (SELECT count(*) FROM k WHERE k >= 2) AS merging_sources, (SELECT coalesce(sum(k), 0)::BIGINT FROM k WHERE k >= 2) AS merged_objects FROM o""")
def reference_scores(spark, sf_dir):
    objects = _assets(spark, sf_dir).select(F.col("asset_id").alias("id"), "x", "y", (F.col("asset_id") % 3 == 0).alias("active"))
    found = evaluate.reference_scores(_incidents(spark, sf_dir), objects, 400.0)
    return found.select(_r("recall_active", 6), _r("recall_all", 6), _r("on_object", 6), "merging_sources", "merged_objects")


# Events and read views


@query(f"""WITH {DETECTIONS}, d AS (SELECT source, acq_datetime::DATE AS day, epoch_us(min(acq_datetime)) AS t0, epoch_us(max(acq_datetime)) AS t1, count(*) AS n_det, max(frp) AS peak FROM det WHERE frp > 60 GROUP BY ALL),
f AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY source ORDER BY day) <= 72 * 3600000000 THEN 0 ELSE 1 END AS new FROM d)
SELECT source, day, t0, t1, n_det, peak, (sum(new) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM f""")
def event_runs_72h(spark, sf_dir):
    return events.source_runs(detections(spark, sf_dir).filter("frp > 60"))


@query(f"""WITH {DETECTIONS}, d AS (SELECT source, acq_datetime::DATE AS day, epoch_us(min(acq_datetime)) AS t0, epoch_us(max(acq_datetime)) AS t1, count(*) AS n_det, max(frp) AS peak FROM det WHERE frp > 60 GROUP BY ALL),
f AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY source ORDER BY day) <= 72 * 3600000000 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, (sum(new) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM f),
g AS (SELECT source, run, min(t0) AS first_us, max(t1) AS last_us, count(*) AS days, sum(n_det)::BIGINT AS n_detections, max(peak) AS peak FROM r GROUP BY source, run)
SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_us DESC, run DESC) AS k FROM g) WHERE k <= 50""")
def source_last_events(spark, sf_dir):
    runs = events.source_runs(detections(spark, sf_dir).filter("frp > 60"))
    return read.latest(events.run_totals(runs), "source", [F.desc("last_us"), F.desc("run")], 50)


@query(f"""WITH {DETECTIONS}, d AS (SELECT source, acq_datetime::DATE AS day, epoch_us(min(acq_datetime)) AS t0, epoch_us(max(acq_datetime)) AS t1, count(*) AS n, max(frp) AS max_frp, count(*) FILTER (WHERE frp > 100) AS alerts FROM det WHERE frp > 60 GROUP BY ALL),
f AS (SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY source ORDER BY day) <= 72 * 3600000000 THEN 0 ELSE 1 END AS new FROM d)
SELECT source, (sum(new) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS run, day, n, max_frp, alerts FROM f""")
def event_timeline(spark, sf_dir):
    det = detections(spark, sf_dir).filter("frp > 60").withColumn("alert", F.when(F.col("frp") > 100, "confirmed"))
    return events.timeline(det, events.source_runs(det))


@query(f"""WITH {PASS_DETECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY acq_datetime DESC, sensor DESC, session DESC) AS r FROM passes)
SELECT source AS event, max(frp) AS peak_frp, max(n_det) AS pixels, round(max(frp_sum) FILTER (WHERE r = 1), 4) AS last, round(max(frp_sum) FILTER (WHERE r = 2), 4) AS previous FROM k GROUP BY source""")
def event_pass_stats(spark, sf_dir):
    return build.pass_stats(pass_detections(spark, sf_dir).withColumnRenamed("source", "event")).select("event", "peak_frp", "pixels", _r("last"), _r("previous"))


@query(f"""WITH {DETECTIONS}, e AS (SELECT source, epoch_us(max(acq_datetime)) AS last, source % 3 = 0 AS alive FROM det WHERE frp > 60 GROUP BY source), g AS (SELECT *, 1706659200000000 - last AS gap FROM e)
SELECT source, CASE WHEN gap <= 24 * 3600000000 THEN 'active' WHEN alive OR gap <= 72 * 3600000000 THEN 'dormant' ELSE 'closed' END AS status FROM g""")
def event_status(spark, sf_dir):
    last = detections(spark, sf_dir).filter("frp > 60").groupBy("source").agg(F.max(passes.micros(F.col("acq_datetime"))).alias("last"))
    return last.select("source", events.status(F.col("last"), F.lit(1706659200000000), F.col("source") % 3 == 0).alias("status"))


@query(f"""{PLACES.replace("1 + detection_id % 3 AS weight", "acq_datetime::DATE AS day")}, e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.day = b.day AND abs(a.x - b.x) <= 750 AND abs(a.y - b.y) <= 750 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 750),
r AS (SELECT id, id AS comp FROM pts UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id)
SELECT id, min(comp) AS comp FROM r GROUP BY id""")
def day_clusters(spark, sf_dir):
    pts = detections(spark, sf_dir).select(F.col("detection_id").alias("id"), "x", "y", F.to_date("acq_datetime").alias("day"))
    return spatial.components_within(pts, 750.0, ("day",))


def _fires(spark, sf_dir):
    det = detections(spark, sf_dir)
    at_source = F.when(F.col("source") % 10 == 0, F.col("source"))
    return det.withColumns({"source_id": at_source, "provisional": F.col("source") % 20 == 0, "retired": F.lit(None).cast("long"), "pred_class": F.col("sensor"), "category": F.col("instrument"), "alert": F.when(at_source.isNotNull(), F.when(F.col("source") % 20 == 0, "new_source").otherwise("confirmed"))})


@query(None)
def fire_events_linking(spark, sf_dir):
    return events.assemble(_fires(spark, sf_dir))


@query(None)
def event_summaries(spark, sf_dir):
    det = _fires(spark, sf_dir)
    return events.summarise(events.assemble(det), det, 1706659200000000).drop("x", "y")


@query(None)
def promotion_replay(spark, sf_dir):
    det = detections(spark, sf_dir).withColumns({"day": F.unix_date(F.to_date("acq_datetime")), "pred_class": F.col("sensor")})
    return routing.promotions(det.select("detection_id", "x", "y", "day", "instrument", "pred_class"))


ROAD_A = """f AS (SELECT (p_partkey * 7919 % 90)::BIGINT AS k, p_partkey AS facility_id, ['oil_gas', 'steel_cement', 'thermal_power', 'mining', 'kiln', 'industrial_other'][(p_partkey % 6 + 1)::INT] AS grp, p_partkey % 6 + 1 AS rank,
  (3000000 + p_partkey % 15 * 5000 + p_partkey * 7919 % 900)::DOUBLE AS fx, (2000000 + p_partkey // 15 % 10 * 5000 + p_partkey * 104729 % 900)::DOUBLE AS fy FROM part),
c AS (SELECT *, [0, 10, 20, 40, 50, 60, 70, 80][(detection_id % 8 + 1)::INT] AS landcover FROM det),
n AS (SELECT detection_id, landcover, rank, facility_id, grp, sqrt(pow(greatest(abs(x - fx) - 60, 0), 2) + pow(greatest(abs(y - fy) - 60, 0), 2)) AS d FROM c JOIN f ON abs(x - fx) <= 2060 AND abs(y - fy) <= 2060),
b AS (SELECT detection_id, min(rank * 1000000.0 + d) FILTER (WHERE d <= 375 AND (grp <> 'industrial_other' OR d < 1 OR landcover IN (50, 60))) AS best, max((grp = 'mining' AND d <= 2000)::INT) AS mine FROM n GROUP BY detection_id),
k AS (SELECT c.*, (best // 1000000)::INT AS rank, coalesce(mine, 0) = 1 AS mine FROM c LEFT JOIN b USING (detection_id))"""


@query(f"""WITH {DETECTIONS}, {ROAD_A}, o AS (SELECT detection_id, CASE WHEN rank IS NOT NULL THEN ['oil_gas', 'heavy_industry', 'heavy_industry', 'mining', 'kiln', 'industrial'][rank] WHEN landcover = 60 AND mine THEN 'mining' WHEN landcover = 0 THEN 'offshore'
  WHEN landcover = 10 THEN 'forest' WHEN landcover = 40 THEN 'agricultural' WHEN landcover = 20 THEN 'vegetation' ELSE 'unclassified' END AS pred_class FROM k)
SELECT detection_id, pred_class, CASE WHEN pred_class IN ('forest', 'agricultural', 'unclassified') THEN pred_class WHEN pred_class = 'vegetation' THEN 'other_natural' ELSE 'industrial' END AS category FROM o""")
def road_a_rules(spark, sf_dir):
    det = detections(spark, sf_dir).withColumn("landcover", F.element_at(F.array(*map(F.lit, (0, 10, 20, 40, 50, 60, 70, 80))), (F.col("detection_id") % 8 + 1).cast("int")))
    p = F.col("p_partkey")
    x, y = (3_000_000 + p % 15 * 5000 + p * 7919 % 900).cast("double"), (2_000_000 + F.expr("p_partkey div 15") % 10 * 5000 + p * 104729 % 900).cast("double")
    corner = lambda i, j: F.struct((x + 60 * i).alias("x"), (y + 60 * j).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    facilities = table(spark, sf_dir, "part").select(p.alias("facility_id"), F.element_at(F.array(*map(F.lit, rules.GROUP_ORDER)), (p % 6 + 1).cast("int")).alias("group"), ring.alias("ring"))
    return routing.road_a(det, facilities).select("detection_id", "pred_class", "category")


@query(f"""WITH {DETECTIONS} SELECT source, acq_datetime::DATE AS day, max(frp) AS peak, count(*) AS n, count(*) FILTER (WHERE frp > 100) AS n_alerts, count(*) FILTER (WHERE daynight = 'N') AS n_night FROM det GROUP BY source, day""")
def daily_series(spark, sf_dir):
    return read.daily(detections(spark, sf_dir).withColumn("alert", F.when(F.col("frp") > 100, "confirmed")), "source")


@query(f"WITH {DETECTIONS} SELECT sensor, count(*) AS n, count(*) FILTER (WHERE daynight = 'N') AS night, count(*) FILTER (WHERE frp > 100) AS hot, max(frp) AS peak FROM det GROUP BY sensor")
def summary(spark, sf_dir):
    return read.summary(detections(spark, sf_dir))


@query(f"WITH {DETECTIONS} SELECT detection_id, source, frp FROM det WHERE daynight = 'N' AND acq_datetime >= TIMESTAMP '2024-01-10' AND acq_datetime < TIMESTAMP '2024-01-21' ORDER BY frp DESC, detection_id LIMIT 50")
def topk_feed(spark, sf_dir):
    return read.features(detections(spark, sf_dir), start="2024-01-10", end="2024-01-20", daynight="N", order=[F.desc_nulls_last("frp"), F.asc("detection_id")], limit=50).select("detection_id", "source", "frp")


@query(f"""WITH {LATLON}, p AS (SELECT event_type AS sensor, value AS frp, (radians(lon) * 6378137.0 + {read.WORLD}) / {2 * read.WORLD} * 32 AS ax, ({read.WORLD} - ln(tan(radians(lat) / 2 + 0.7853981633974483)) * 6378137.0) / {2 * read.WORLD} * 32 AS ay FROM ll JOIN events ON event_id = id),
b AS (SELECT *, floor(ax)::INT AS tile_x, floor(ay)::INT AS tile_y, floor((ax - floor(ax)) * 128)::INT AS bin_x, floor((ay - floor(ay)) * 128)::INT AS bin_y FROM p),
k AS (SELECT tile_x, tile_y, bin_x, bin_y, sensor, count(*) AS k FROM b GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y, bin_x, bin_y ORDER BY k DESC, sensor) AS r FROM k)
SELECT b.tile_x, b.tile_y, b.bin_x, b.bin_y, count(*) AS n, max(frp) AS peak, count(*) FILTER (WHERE frp > 100) AS alerts, any_value(s.sensor) AS sensor FROM b JOIN s ON s.r = 1 AND s.tile_x = b.tile_x AND s.tile_y = b.tile_y AND s.bin_x = b.bin_x AND s.bin_y = b.bin_y GROUP BY b.tile_x, b.tile_y, b.bin_x, b.bin_y""")
def tile_bins(spark, sf_dir):
    at = _latlon(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("sensor"), F.col("value").alias("frp")), "id")
    return read.tile_bins(at.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), 5)


@query(f"""WITH {PASS_DETECTIONS} SELECT d.detection_id, min(p.session) AS session FROM pdet d JOIN passes p ON p.source = d.source AND p.sensor = d.sensor AND epoch_us(d.acq_datetime) - epoch_us(p.acq_datetime) BETWEEN 0 AND 1200000000 GROUP BY d.detection_id""")
def interval_pass_join(spark, sf_dir):
    det = pass_detections(spark, sf_dir)
    return read.in_passes(det, passes.pass_table(det))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH p AS (SELECT event_id % 40 AS col, event_id // 40 % 25 AS row, sum(value) AS v FROM events GROUP BY ALL),
g AS (SELECT a.row, a.col, b.v, (a.row - b.row) * 1.5 AS north, (b.col - a.col) * 1.2 AS east FROM p a JOIN p b ON abs(a.row - b.row) <= 7 AND abs(a.col - b.col) <= 9)
SELECT row, col, round(coalesce(sum(v) FILTER (WHERE sqrt(north * north + east * east) <= 5), 0), 4) AS disk,
  round(coalesce(sum(v) FILTER (WHERE sqrt(north * north + east * east) <= 10 AND sqrt(north * north + east * east) > 0.5 AND abs((degrees(atan2(east, north)) - 90 + 540) % 360 - 180) <= 15), 0), 4) AS sector FROM g GROUP BY row, col""")
def population_kernels(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 40).alias("col"), (F.expr("event_id div 40") % 25).alias("row")).agg(F.sum("value").alias("v"))
    return risk.kernel_sums(e, 1.5, 1.2, F.lit(92.0)).select("row", "col", F.round("disk", 4).alias("disk"), F.round("sector", 4).alias("sector"))


@query("""WITH c AS (SELECT event_id // 40 % 250 AS row, event_id % 400 AS col, sum(value) AS v FROM events GROUP BY ALL)
SELECT a.row, a.col, round(sum(b.v) FILTER (WHERE abs(a.row - b.row) + abs(a.col - b.col) <= 6), 4) AS diamond, round(coalesce(sum(b.v) FILTER (WHERE b.row - a.row = 3 AND b.col < a.col), 0), 4) AS line
FROM c a JOIN c b ON b.row BETWEEN a.row - 6 AND a.row + 6 AND b.col BETWEEN a.col - 6 AND a.col + 6 GROUP BY a.row, a.col""")
def raster_correlation(spark, sf_dir):
    cells = table(spark, sf_dir, "events").groupBy((F.expr("event_id div 40") % 250).alias("row"), (F.col("event_id") % 400).alias("col")).agg(F.sum("value").alias("v"))
    around = range(-6, 7)
    offsets = [(r, c, [0] * (abs(r) + abs(c) <= 6) + [1] * (r == 3 and c < 0)) for r in around for c in around]
    found = raster.correlate(cells, offsets, 2)
    return found.select("row", "col", F.round(F.col("sums")[0], 4).alias("diamond"), F.round(F.col("sums")[1], 4).alias("line"))


@query("""SELECT ((o_orderkey // 50 % 40) * 20 + o_orderkey // 7 % 20) // 3 AS row, ((o_orderkey % 50) * 30 + o_orderkey // 11 % 30) // 3 AS col, max(o_totalprice) AS v FROM orders
WHERE ((o_orderkey // 50 % 40) * 20 + o_orderkey // 7 % 20) % 3 = 1 AND ((o_orderkey % 50) * 30 + o_orderkey // 11 % 30) % 3 = 1 GROUP BY ALL""")
def raster_mosaic(spark, sf_dir):
    k = lambda e: F.expr(e).alias
    tiles = table(spark, sf_dir, "orders").groupBy(k("o_orderkey div 50 % 40")("tile_row"), k("o_orderkey % 50")("tile_col"), k("o_orderkey div 7 % 20")("row"), k("o_orderkey div 11 % 30")("col")).agg(F.max("o_totalprice").alias("v"))
    return raster.mosaic(tiles, 20, 30, 3).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v")


@query(None)
def source_hulls(spark, sf_dir):
    return registry.hull(detections(spark, sf_dir).select("source", "x", "y"), "source")


@query(None)
def classifier_cv(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("block"), F.element_at(F.array(*map(F.lit, ("mining", "oil_gas", "heavy_industry"))), (F.col("p_size") % 3 + 1).cast("int")).alias("label"), F.col("p_retailprice").alias("frp_med"), (F.col("p_size") % 3 * 2.0 + F.col("p_partkey") % 5).alias("night_share"))
    out = model.cross_validated(rows, ["frp_med", "night_share"], "block")
    return out.select("p_partkey", "fold", "label", "predicted", _r("confidence", 6))


CONFUSED = """
j AS (SELECT l_returnflag AS label, CASE WHEN l_quantity > 25 THEN l_returnflag WHEN l_linenumber % 2 = 0 THEN 'N' ELSE 'R' END AS predicted FROM lineitem),
c AS (
  SELECT class, sum(support)::BIGINT AS support, sum(said) AS said, sum(hit) AS hit FROM (
    SELECT label AS class, 1 AS support, 0 AS said, (label = predicted)::INT AS hit FROM j UNION ALL SELECT predicted, 0, 1, 0 FROM j
  ) GROUP BY class
), s AS (
  SELECT class, support, hit, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c
), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s)"""


@query(f"""WITH {CONFUSED} SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
  round(sum(hit) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN r END) OVER (), 6) AS balanced_accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM f""")
def classifier_scores(spark, sf_dir):
    said = F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).when(F.col("l_linenumber") % 2 == 0, "N").otherwise("R")
    judged = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), said.alias("predicted"))
    shares = ("precision", "recall", "f1", "accuracy", "balanced_accuracy", "macro_f1")
    return model.scores(judged).select("class", "support", *[_r(c, 6) for c in shares])


# The registry as of a time, and nearest places at any distance

#: Cells of three kinds: of the registry, promoted and perhaps retired later, and retired before any promotion time was kept. Some users have two cells.
CELLS = """
u AS (SELECT DISTINCT user_id AS u FROM events),
src AS (SELECT u AS source, u % 3 > 0 AS provisional, CASE WHEN u % 3 = 1 THEN TIMESTAMP '2024-01-05' + to_days((u % 10)::INT) END AS promoted_at,
  CASE WHEN u % 3 = 1 AND u % 2 = 0 THEN TIMESTAMP '2024-01-12' + to_days((u % 7)::INT) WHEN u % 3 = 2 AND u % 5 = 0 THEN TIMESTAMP '2024-01-09' END AS retired_at FROM u),
cell AS (SELECT u * 2 + k AS cell, u AS source, (3000000 + u % 15 * 5000 + 200 + 550 * k)::DOUBLE AS cx, (2000000 + u // 15 * 5000 + 450)::DOUBLE AS cy FROM u, (VALUES (0), (1)) v(k) WHERE k = 0 OR u % 4 = 0),
other AS (SELECT cell + 1000000 AS cell, (source + 7) % 1000 AS source, cx + 60 AS cx, cy FROM cell WHERE source % 6 = 4),
cells AS (SELECT * FROM cell UNION ALL SELECT * FROM other)"""


def _cells(spark, sf_dir):
    """(sources, cells) of CELLS."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("source")).distinct()
    day = lambda d, n: (F.lit(d).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))).cast("timestamp_ntz")
    k, s = F.col("k"), F.col("source")
    sources = u.select("source", (s % 3 > 0).alias("provisional"), F.when(s % 3 == 1, day("2024-01-05", s % 10)).alias("promoted_at"), F.when((s % 3 == 1) & (s % 2 == 0), day("2024-01-12", s % 7)).when((s % 3 == 2) & (s % 5 == 0), F.lit("2024-01-09").cast("timestamp_ntz")).alias("retired_at"))
    own = u.withColumn("k", F.explode(F.when(s % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    cells = own.select((s * 2 + k).alias("cell"), "source", (3_000_000 + s % 15 * 5000 + 200 + 550 * k).cast("double").alias("x"), (2_000_000 + F.expr("source div 15") * 5000 + 450).cast("double").alias("y"))
    other = cells.filter(s % 6 == 4).select((F.col("cell") + 1_000_000).alias("cell"), ((s + 7) % 1000).alias("source"), (F.col("x") + 60).alias("x"), "y")
    return sources, cells.unionByName(other)


@query(f"""WITH {DETECTIONS}, {CELLS},
v AS (SELECT c.*, s.provisional, s.promoted_at, s.retired_at FROM cells c JOIN src s USING (source)),
near AS (SELECT detection_id, source, provisional, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d, row_number() OVER (PARTITION BY detection_id ORDER BY sqrt(pow(x - cx, 2) + pow(y - cy, 2)), cell) AS r
  FROM (SELECT detection_id, acq_datetime AS t, x, y, instrument FROM det) JOIN v ON abs(x - cx) < 1000 AND abs(y - cy) < 1000
  WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < CASE WHEN instrument = 'VIIRS' THEN 500 ELSE 1000 END
    AND (NOT provisional OR (promoted_at < t AND (retired_at IS NULL OR retired_at > t)) OR (promoted_at IS NULL AND retired_at IS NULL)))
SELECT det.detection_id, near.source, provisional, round(d, 3) AS d FROM det LEFT JOIN near ON near.detection_id = det.detection_id AND r = 1""")
def asof_routing(spark, sf_dir):
    det = detections(spark, sf_dir).drop("source")
    found = asof.assign_as_of(det, asof.versioned(*_cells(spark, sf_dir)))
    return found.select("detection_id", "source", "provisional", _r("d", 3))


@query(f"""WITH {DETECTIONS}, {CELLS},
near AS (SELECT detection_id, acq_datetime AS t, c.source, row_number() OVER (PARTITION BY detection_id ORDER BY sqrt(pow(x - cx, 2) + pow(y - cy, 2)), cell) AS r
  FROM det JOIN cells c ON abs(x - cx) < 500 AND abs(y - cy) < 500 JOIN src s ON s.source = c.source
  WHERE det.detection_id % 3 > 0 AND promoted_at IS NOT NULL AND sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 500)
SELECT detection_id, source FROM near JOIN src USING (source) WHERE r = 1 AND t >= promoted_at - INTERVAL 6 DAY AND t < promoted_at""")
def pre_promotion_backfill(spark, sf_dir):
    sources, cells = _cells(spark, sf_dir)
    promoted = sources.filter("promoted_at IS NOT NULL").select("source", F.date_sub(F.to_date("promoted_at"), 6).alias("first_seen"), "promoted_at")
    # two thirds of the detections are off every source, the others lie at one
    det = detections(spark, sf_dir).withColumns({"road": F.when(F.col("detection_id") % 3 > 0, 1).otherwise(2), "source": F.when(F.col("detection_id") % 3 == 0, F.lit(1))})
    return asof.pre_promotion(det, promoted, cells.join(promoted.select("source"), "source", "left_semi"))


@query(f"""WITH {DETECTIONS}, f AS (SELECT s_suppkey AS id, (3000000 + s_suppkey * 7919 % 140000)::DOUBLE AS fx, (1900000 + s_suppkey * 104729 % 300000)::DOUBLE AS fy FROM supplier),
m AS (SELECT detection_id, min(pow(x - fx, 2) + pow(y - fy, 2)) AS q, arg_min(id, (pow(x - fx, 2) + pow(y - fy, 2), id)) AS facility FROM det, f GROUP BY detection_id)
SELECT detection_id, facility, round(sqrt(q), 3) AS d FROM m""")
def nearest_facility(spark, sf_dir):
    k = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select(k.alias("facility"), (3_000_000 + k * 7919 % 140_000).cast("double").alias("x"), (1_900_000 + k * 104_729 % 300_000).cast("double").alias("y"))
    found = spatial.nearest_any(detections(spark, sf_dir), places, "detection_id", "facility", "facility")
    return found.select("detection_id", "facility", _r("d", 3))


# Sky and wind

SKY = """c AS (SELECT o_custkey % 2000 AS cell, o_orderdate::DATE AS day, ['A', 'D', 'N'][(o_orderkey % 3 + 1)::INT] AS daynight, max(o_orderkey % 97 / 97.0::DOUBLE) AS cloud FROM orders GROUP BY ALL),
ring AS (SELECT * FROM (VALUES (0, 0), (1, -50), (2, -1), (3, 1), (4, 50), (5, -51), (6, -49), (7, 49), (8, 51)) v(rank, step)),
p AS (SELECT s_suppkey AS key, s_suppkey * 7 % 2000 AS cell FROM supplier),
best AS (SELECT key, day, daynight, arg_min(1 - cloud, rank) AS clear FROM p, ring JOIN c ON c.cell = p.cell + step GROUP BY key, day, daynight),
sky AS (SELECT key, day, max(clear) FILTER (WHERE daynight = 'A') AS a, max(clear) FILTER (WHERE daynight = 'D') AS d, max(clear) FILTER (WHERE daynight = 'N') AS n FROM best GROUP BY key, day)"""


def _sky(spark, sf_dir, routing):
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("A"), F.lit("D"), F.lit("N")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    cloud = o.groupBy((F.col("o_custkey") % 2000).alias("cell"), F.to_date("o_orderdate").alias("day"), kind.alias("daynight")).agg(F.max(F.col("o_orderkey") % 97 / 97.0).alias("cloud_frac"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 7 % 2000).alias("cell"))
    return weather.clear_sky(places, cloud, 50, routing).select("key", "daynight", "day", _r("clear", 9))


@query(f"WITH {SKY} SELECT key, daynight, day, round(clear, 9) AS clear FROM (SELECT key, 'D' AS daynight, day, coalesce(d, a) AS clear FROM sky UNION ALL SELECT key, 'N', day, coalesce(n, a) FROM sky) WHERE clear IS NOT NULL")
def clear_sky_ring(spark, sf_dir):
    return _sky(spark, sf_dir, False)


@query(f"WITH {SKY} SELECT key, 'A' AS daynight, day, round(coalesce(a, CASE WHEN d IS NOT NULL OR n IS NOT NULL THEN 1 - (1 - coalesce(d, 0)) * (1 - coalesce(n, 0)) END), 9) AS clear FROM sky")
def clear_sky_routing(spark, sf_dir):
    return _sky(spark, sf_dir, True)


@query("""WITH w AS (SELECT o_custkey % 60 * 0.5 AS lat, o_custkey // 60 % 50 * 0.5 AS lon, o_orderdate::DATE AS day, max(o_orderkey % 41 - 20)::DOUBLE AS u, max(o_orderkey % 37 - 18)::DOUBLE AS v FROM orders GROUP BY ALL),
e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 300 / 10.0 AS lat, l_suppkey % 250 / 10.0 AS lon, l_shipdate::DATE AS day FROM lineitem)
SELECT id, round((degrees(atan2(u, v)) + 360) % 360, 6) AS bearing FROM e LEFT JOIN w ON floor(e.lat / 0.5 + 0.5) = floor(w.lat / 0.5 + 0.5) AND floor(e.lon / 0.5 + 0.5) = floor(w.lon / 0.5 + 0.5) AND e.day = w.day""")
def wind_bearing(spark, sf_dir):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    winds = table(spark, sf_dir, "orders").groupBy((c % 60 * 0.5).alias("latitude"), (F.expr("o_custkey div 60") % 50 * 0.5).alias("longitude"), F.to_date("o_orderdate").alias("day")).agg(F.max(k % 41 - 20).cast("double").alias("u"), F.max(k % 37 - 18).cast("double").alias("v"))
    at = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 300 / 10.0).alias("latitude"), (F.col("l_suppkey") % 250 / 10.0).alias("longitude"), F.to_date("l_shipdate").alias("day"))
    return weather.wind(at, winds, 0.5).select("id", _r("bearing", 6))


# Studies

PUBLISHED = DETECTIONS + """, v AS (
  SELECT s_suppkey AS event_id, (3000000 + s_suppkey % 15 * 5000 + 450)::DOUBLE AS vx, (2000000 + s_suppkey // 15 % 10 * 5000 + 450)::DOUBLE AS vy, 300 + s_suppkey % 5 * 100 AS match_m, s_suppkey % 3 > 0 AS known,
    (DATE '2024-01-05' + (s_suppkey % 20)::INT)::TIMESTAMP + CASE WHEN s_suppkey % 3 > 0 THEN INTERVAL 390 MINUTE ELSE INTERVAL 0 MINUTE END - INTERVAL 330 MINUTE AS a,
    CASE WHEN s_suppkey % 4 = 0 THEN (DATE '2024-01-05' + (s_suppkey % 20)::INT + 3)::TIMESTAMP - INTERVAL 330 MINUTE END AS published FROM supplier
), w AS (
  SELECT *, greatest(a + CASE WHEN known THEN INTERVAL 24 HOUR ELSE INTERVAL 48 HOUR END, coalesce(published, a)) AS b FROM v
), dd AS (
  SELECT *, 1 + detection_id % 3 AS road, (detection_id % 3 = 0 AND detection_id % 5 < 2) OR detection_id % 3 = 2 AS flag FROM det
), pair AS (
  SELECT w.*, dd.acq_datetime AS t, frp, road, flag, sqrt(pow(x - vx, 2) + pow(y - vy, 2)) AS d FROM w JOIN dd ON abs(x - vx) <= 3000 AND abs(y - vy) <= 3000
), near AS (
  SELECT event_id, count(*) FILTER (WHERE t >= a) AS detections, count(*) FILTER (WHERE t >= a AND flag) AS hits, count(*) FILTER (WHERE t >= a AND road = 2) AS routine, min(t) FILTER (WHERE t >= a) AS f, min(t) FILTER (WHERE t >= a AND flag) AS g,
    max(frp) FILTER (WHERE t >= a) AS max_frp, count(*) FILTER (WHERE t < a) AS lead_detections, count(DISTINCT (t + INTERVAL 330 MINUTE)::DATE) FILTER (WHERE t < a AND flag) AS lead_flag_days
  FROM pair WHERE d <= match_m AND t >= date_trunc('day', a - INTERVAL 60 DAY) AND t < b GROUP BY event_id
), close AS (SELECT event_id, round(min(d))::BIGINT AS nearest_in_window_m FROM pair WHERE t >= a AND t < b AND d <= 3000 GROUP BY event_id),
outcomes AS (
  SELECT w.event_id, known, epoch_us(a) AS start_us, epoch_us(b) AS end_us, CASE WHEN coalesce(detections, 0) = 0 THEN 'no signature' WHEN hits > 0 THEN 'flagged' WHEN routine > 0 THEN 'routine' ELSE 'misclassified' END AS outcome,
    coalesce(detections, 0) AS detections, CASE WHEN known THEN round((epoch_us(f) - epoch_us(a)) / 3.6e9, 1) END AS first_detection_h, CASE WHEN known THEN round((epoch_us(g) - epoch_us(a)) / 3.6e9, 1) END AS first_flag_h, max_frp, nearest_in_window_m,
    coalesce(lead_detections, 0) AS lead_detections, coalesce(lead_flag_days, 0) AS lead_flag_days, round(1 - pow(1 - coalesce(lead_flag_days, 0) / 60.0, (epoch_us(b) - epoch_us(a)) / 8.64e10), 3) AS chance
  FROM w LEFT JOIN near USING (event_id) LEFT JOIN close USING (event_id))"""


def _outcomes(spark, sf_dir):
    k, i = F.col("s_suppkey"), F.col("detection_id")
    day = F.date_add(F.lit("2024-01-05").cast("date"), (k % 20).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("event_id"), (3_000_000 + k % 15 * 5000 + 450).cast("double").alias("x"), (2_000_000 + F.expr("s_suppkey div 15") % 10 * 5000 + 450).cast("double").alias("y"), (300 + k % 5 * 100).alias("match_m"), day.alias("start"), F.when(k % 3 > 0, "06:30").otherwise(" ").alias("start_time"), F.when(k % 4 == 0, F.date_add(day, 2)).alias("end"))
    det = detections(spark, sf_dir).withColumns({"road": 1 + i % 3, "category": F.when(i % 5 < 2, "industrial").otherwise("forest")})
    return studies.event_outcomes(studies.event_windows(rows), det, 700.0, 3000.0)


@query(f"WITH {PUBLISHED} SELECT * FROM outcomes")
def verified_events(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _outcomes(spark, sf_dir).withColumns({"start_us": us("start_utc"), "end_us": us("end_utc")}).drop("start_utc", "end_utc")


@query(f"""WITH {PUBLISHED} SELECT count(*) AS events, count(*) FILTER (WHERE outcome = 'flagged') AS flagged, round(count(*) FILTER (WHERE outcome = 'flagged') / count(*), 3) AS recall, count(*) FILTER (WHERE detections > 0) AS signature, round(sum(chance), 2) AS expected_by_chance,
  round(avg(first_flag_h) FILTER (WHERE outcome = 'flagged'), 1) AS flag_h_mean, round(median(first_flag_h) FILTER (WHERE outcome = 'flagged'), 1) AS flag_h_median, round(avg(first_detection_h), 1) AS seen_h_mean, round(median(first_detection_h), 1) AS seen_h_median FROM outcomes""")
def verified_summary(spark, sf_dir):
    return studies.outcome_summary(_outcomes(spark, sf_dir))


CLUSTERED = DETECTIONS + """, p AS (
  SELECT x, y, CASE WHEN source % 3 = 0 THEN source END AS c, CASE WHEN sensor <> 'error' THEN (source + detection_id % 2) % 30 END AS a, [CASE WHEN daynight = 'N' THEN 'night' ELSE 'day' END, instrument] AS regions FROM det
), wd AS (SELECT a, count(*) AS n, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) / 1000 AS width_km FROM p WHERE a IS NOT NULL GROUP BY a)"""


def _clustered(spark, sf_dir):
    s = F.col("source")
    raw = F.when(F.col("sensor") != "error", (s + F.col("detection_id") % 2) % 30)
    return detections(spark, sf_dir).select("x", "y", F.when(s % 3 == 0, s).alias("c"), raw.alias("a"), F.array(F.when(F.col("daynight") == "N", "night").otherwise("day"), "instrument").alias("regions"))


@query(f"""WITH {CLUSTERED}, k AS (SELECT c, a, count(*) AS k FROM p WHERE c IS NOT NULL AND a IS NOT NULL GROUP BY c, a),
dom AS (SELECT c, a FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k DESC, a) AS r FROM k) WHERE r = 1), per AS (SELECT a, sum(k) AS p FROM k GROUP BY a)
SELECT c, a, round(width_km, 3) AS width_km, round(1 - per.p / n, 6) AS contamination FROM dom JOIN wd USING (a) JOIN per USING (a)""")
def clustering_absorption(spark, sf_dir):
    return studies.absorption(_clustered(spark, sf_dir)).select("c", "a", _r("width_km", 3), _r("contamination", 6))


@query(f"""WITH {CLUSTERED}, e AS (SELECT unnest(list_append(regions, NULL)) AS region, width_km FROM p LEFT JOIN (SELECT * FROM wd WHERE n >= 300) b ON b.a = p.a)
SELECT region, count(*) AS detections, round(avg((width_km IS NOT NULL)::INT), 4) AS skip_road_a, round(avg(coalesce((width_km > 10)::INT, 0)), 4) AS in_landscape, round(coalesce(max(width_km), 0), 1) AS widest_km FROM e GROUP BY region""")
def region_shares(spark, sf_dir):
    return studies.region_shares(_clustered(spark, sf_dir), "a", "regions", 300)


# Versions of the tables that runs write

#: Windows of the runs that window_rewrites makes, and what frp each takes for an alert: A, B, then A again, then B is undone.
WINDOW_A, WINDOW_B = ("2024-01-05", "2024-01-12"), ("2024-01-12", "2024-01-20")
RUNS = ((WINDOW_A, 50), (WINDOW_B, 80), (WINDOW_A, 120))


def _window_sql(name, window, limit, first):
    return f"""{name} AS (
  SELECT event_id AS detection_id, user_id, user_id % 40 AS home, CASE WHEN value > {limit} THEN 3 WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS road,
    sum((value > {limit})::INT) OVER (PARTITION BY user_id) >= 3 AS promoted, {first} + user_id AS new_id
  FROM events WHERE ts >= TIMESTAMP '{window[0]}' AND ts < TIMESTAMP '{window[1]}')"""


def _inference(spark, sf_dir, store, window, limit, first):
    """One run over a window: clear what an earlier one left, then write promotions, retirements, passes and roads as one version."""
    start, end = window
    old = {n: store.read(n) for n in ("sources", "cells", "passes", "detections")}
    clean = writes.without_window(**{"sources": old["sources"], "cells": old["cells"], "passes": old["passes"], "det": old["detections"]}, start=start, end=end)
    at = F.col("ts")
    rows = table(spark, sf_dir, "events").filter((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))
    if limit is not None:
        hot = (F.col("value") > limit).cast("int")
        users = rows.groupBy("user_id").agg(F.sum(hot).alias("n"), F.max("ts").alias("promoted_at")).filter("n >= 3")
        promoted = users.select((F.col("user_id") + first).alias("source_id"), "promoted_at")
        cells = users.select(F.col("user_id").alias("cell"), (F.col("user_id") + first).alias("source_id"))
        quiet = rows.groupBy((F.col("user_id") % 40).alias("source_id")).agg(F.sum(hot).alias("n")).filter("n < 40").select("source_id", F.lit(start).cast("timestamp_ntz").alias("retired_at"))
        road = F.when(F.col("value") > limit, 3).when(F.col("user_id") % 2 == 0, 2).otherwise(1)
        routed = rows.join(users.select("user_id", F.lit(True).alias("_p")), "user_id", "left").select(F.col("event_id").alias("detection_id"), F.when(F.col("_p"), F.col("user_id") + first).when(road > 1, F.col("user_id") % 40).alias("source_id"), road.cast("short").alias("road"))
        seen = rows.groupBy((F.col("user_id") % 40).alias("source_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("acq_datetime")).agg(F.max("value").alias("frp"))
        clean = writes.after_inference(clean, promoted, cells, quiet, seen, routed, start, end)
    days = [str(r[0]) for r in old["detections"].select("day").distinct().collect() if start <= str(r[0]) < end]
    parted = {"detections": (clean["detections"].filter(F.col("day").isin(days)), "day", days)}
    store.commit({n: clean[n] for n in ("sources", "cells", "passes")}, parted, {"window": window, "limit": limit})


def _runs_written(spark, sf_dir):
    """The store after the runs of RUNS and the undoing of B."""
    store = Versions(spark, shared_path(spark))
    e = table(spark, sf_dir, "events")
    none = F.lit(None)
    sources = e.select((F.col("user_id") % 40).alias("source_id")).distinct().select("source_id", F.lit("registry").alias("origin"), F.lit(False).alias("provisional"), none.cast("timestamp_ntz").alias("promoted_at"), none.cast("timestamp_ntz").alias("retired_at"))
    cells = e.select(F.col("user_id").alias("cell"), (F.col("user_id") % 40).alias("source_id")).distinct()
    passes_ = spark.createDataFrame([], "source_id long, acq_datetime timestamp_ntz, frp double")
    det = e.select(F.col("event_id").alias("detection_id"), F.col("ts").alias("acq_datetime"), F.to_date("ts").cast("string").alias("day"), none.cast("long").alias("source_id"), none.cast("short").alias("road"))
    all_days = [r[0] for r in det.select("day").distinct().collect()]
    store.commit({"sources": sources, "cells": cells, "passes": passes_}, {"detections": (det, "day", all_days)}, {"built": True})
    for k, (window, limit) in enumerate(RUNS):
        _inference(spark, sf_dir, store, window, limit, 100_000 * (k + 1))
    _inference(spark, sf_dir, store, WINDOW_B, None, 0)
    return store


@query(f"""WITH {_window_sql("a", *RUNS[2], 300_000)}, {_window_sql("b", *RUNS[1], 200_000)}
SELECT event_id AS detection_id,
  (CASE WHEN a.detection_id IS NOT NULL THEN CASE WHEN a.promoted THEN a.new_id WHEN a.road > 1 THEN a.home END
        WHEN b.promoted THEN NULL WHEN b.road > 1 THEN b.home END)::BIGINT AS source_id,
  coalesce(a.road, b.road)::SMALLINT AS road
FROM events LEFT JOIN a ON a.detection_id = event_id LEFT JOIN b ON b.detection_id = event_id""")
def window_rewrites(spark, sf_dir):
    return _runs_written(spark, sf_dir).read("detections").select("detection_id", "source_id", "road")


@query(f"""WITH {_window_sql("a", *RUNS[2], 300_000)},
s AS (SELECT DISTINCT user_id % 40 AS source_id FROM events),
q AS (SELECT home AS source_id, sum((road = 3)::INT) AS n FROM a GROUP BY home),
c AS (SELECT user_id % 40 AS source_id, count(DISTINCT user_id) AS n_cells FROM events GROUP BY 1),
p AS (SELECT DISTINCT user_id % 40 AS source_id, ts::DATE AS day FROM events WHERE ts >= TIMESTAMP '{WINDOW_A[0]}' AND ts < TIMESTAMP '{WINDOW_A[1]}')
SELECT source_id, 'registry' AS origin, coalesce(n < 40, false) AS retired, n_cells, (SELECT count(*) FROM p WHERE p.source_id = s.source_id) AS n_passes FROM s LEFT JOIN q USING (source_id) JOIN c USING (source_id)
UNION ALL SELECT DISTINCT new_id, 'promotion', false, 1, 0 FROM a WHERE promoted""")
def window_rewrites_registry(spark, sf_dir):
    store = _runs_written(spark, sf_dir)
    cells = store.read("cells").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_cells"))
    seen = store.read("passes").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_passes"))
    out = store.read("sources").join(cells, "source_id").join(seen, "source_id", "left")
    return out.select("source_id", "origin", F.col("retired_at").isNotNull().alias("retired"), "n_cells", F.coalesce("n_passes", F.lit(0)).alias("n_passes"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 40 AS k FROM orders),
id AS (SELECT DISTINCT k, CASE WHEN k < 35 THEN k ELSE 33 + k END AS source_id FROM o WHERE k < 35 OR k >= 38)
SELECT o_orderkey AS detection_id, CASE WHEN o_custkey % 3 > 0 AND id.k IS NOT NULL THEN source_id WHEN o.k IN (36, 37) THEN o.k END::BIGINT AS source_id FROM o LEFT JOIN id USING (k)""")
def registry_rewrite(spark, sf_dir):
    """Sources are customers modulo 40: those below 35 are found again (as labels from 1000 on) and keep their ids, 35 is lost, 36 and 37 are provisional and stay, 38 and 39 are new and get the ids after 70."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 40).alias("k"))
    old = o.filter("k < 38").select(F.col("k").alias("source_id"), F.col("k").isin(36, 37).alias("provisional")).distinct()
    old = old.unionByName(spark.createDataFrame([(70, False)], "source_id long, provisional boolean"))
    old_cells = o.filter("k < 38").select(F.col("o_custkey").alias("cell"), F.col("k").alias("source_id")).distinct()
    det = o.select(F.col("o_orderkey").alias("detection_id"), F.when(F.col("k") < 38, F.col("k")).alias("source_id"))
    found = o.filter("k < 35 OR k >= 38").withColumn("label", F.col("k") + 1000)
    sources = found.select("label").distinct()
    assigned = found.filter("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("detection_id"), "label")
    store = Versions(spark, shared_path(spark))
    store.commit({"sources": old, "cells": old_cells, "detections": det})
    new = writes.next_registry(store.read("sources"), store.read("cells"), store.read("detections"), sources, found.select(F.col("o_custkey").alias("cell"), "label").distinct(), assigned)
    store.commit({n: new[n] for n in ("sources", "cells", "detections")}, run={"gate": "test"})
    return store.read("detections").select("detection_id", "source_id")


# Streams


@query("SELECT event_id, epoch_us(ts) AS at_us, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS r FROM events) WHERE r = 1")
def streaming_dedupe(spark, sf_dir):
    out = live.drained(live.without_repeats(live.stream(spark, sf_dir)))
    return out.select("event_id", F.unix_micros("ts").alias("at_us"), "user_id", "event_type")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL")
def streaming_daily(spark, sf_dir):
    return live.daily_counts(spark, live.stream(spark, sf_dir))


@query(tiers_sql(2.0, 0.5).replace("SELECT source, sensor, session, baseline_key, round(z, 4) AS z, round(ratio_p99, 4) AS ratio_p99, breach, extreme,", "SELECT source, sensor, session, epoch_us(acq_datetime) AS at, breach,") + " WHERE known")
def streaming_tiers(spark, sf_dir):
    old, new = _history(spark, sf_dir)
    judged = passes.tiers(passes.scored(new, passes.baselines(old)), z_breach=2.0, p99_breach=0.5).filter("baseline_key is not null")
    folder = written(judged.select("source", "session", "sensor", passes.micros(F.col("acq_datetime")).alias("at"), "breach", "extreme"))
    path = folder.inputFiles()[0].rsplit("/", 1)[0]
    return live.drained(live.chained_alerts(spark.readStream.schema(folder.schema).parquet(path)))
