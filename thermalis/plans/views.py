"""Detections over the driver's tables. Integer arithmetic only, so that SQL gives the same bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: places are clumps of 900 m, 5 km apart."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("detection_id"), F.col("ts").alias("acq_datetime"), F.col("user_id").alias("source"), F.col("event_type").alias("sensor"),
        F.when(F.col("event_type").isin("click", "view", "error"), "VIIRS").otherwise("MODIS").alias("instrument"),
        F.when(F.hour("ts").between(6, 17), "D").otherwise("N").alias("daynight"), F.col("value").alias("frp"),
        (3_000_000 + F.col("user_id") % 15 * 5000 + F.col("event_id") * 7919 % 900).cast("double").alias("x"),
        (2_000_000 + F.expr("user_id div 15") * 5000 + F.col("event_id") * 104729 % 900).cast("double").alias("y"),
    )


DETECTIONS = """
det AS (
  SELECT event_id AS detection_id, ts AS acq_datetime, user_id AS source, event_type AS sensor,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN 'VIIRS' ELSE 'MODIS' END AS instrument,
    CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight, value AS frp,
    (3000000 + user_id % 15 * 5000 + event_id * 7919 % 900)::DOUBLE AS x,
    (2000000 + user_id // 15 * 5000 + event_id * 104729 % 900)::DOUBLE AS y
  FROM events
)"""


def pass_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events keyed so that passes hold several rows: the event type is the source, the user's parity the sensor."""
    return detections(spark, sf_dir).withColumns({"source": F.col("sensor"), "sensor": (F.col("source") % 2).cast("string")})


PASS_DETECTIONS = DETECTIONS + """, pdet AS (
  SELECT * REPLACE (sensor AS source, (source % 2)::VARCHAR AS sensor) FROM det
), flagged AS (
  SELECT *, CASE WHEN acq_datetime - lag(acq_datetime) OVER o <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM pdet
  WINDOW o AS (PARTITION BY source, sensor ORDER BY acq_datetime, detection_id)
), sess AS (
  SELECT *, (sum(new) OVER (PARTITION BY source, sensor ORDER BY acq_datetime, detection_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM flagged
), passes AS (
  SELECT source, sensor, session, arg_min(instrument, (acq_datetime, detection_id)) AS instrument, arg_min(daynight, (acq_datetime, detection_id)) AS daynight,
    min(acq_datetime) AS acq_datetime, max(frp) AS frp, sum(frp) AS frp_sum, count(*) AS n_det FROM sess GROUP BY ALL
), base_rows AS (
  SELECT source, frp, unnest(['*', instrument || '|' || daynight, instrument || '|' || daynight || '|' ||
    CASE WHEN month(acq_datetime) <= 2 THEN 'winter' WHEN month(acq_datetime) <= 5 THEN 'pre_monsoon' WHEN month(acq_datetime) <= 9 THEN 'monsoon' ELSE 'post_monsoon' END]) AS key
  FROM passes WHERE acq_datetime < TIMESTAMP '2024-01-16'
), base AS (
  SELECT source, key, round(median(frp), 3) AS med, round(mad(frp), 3) AS mad, round(quantile_cont(frp, 0.99), 3) AS p99, count(*) AS n
  FROM base_rows GROUP BY source, key HAVING count(*) >= 30 OR key = '*'
), judged AS (
  SELECT p.*, coalesce(s.key, g.key) AS baseline_key, coalesce(s.med, g.med) AS med, coalesce(s.mad, g.mad) AS mad, coalesce(s.p99, g.p99) AS p99
  FROM passes p
  LEFT JOIN base s ON s.source = p.source AND s.key = instrument || '|' || daynight || '|' || CASE WHEN month(acq_datetime) <= 2 THEN 'winter' WHEN month(acq_datetime) <= 5 THEN 'pre_monsoon' WHEN month(acq_datetime) <= 9 THEN 'monsoon' ELSE 'post_monsoon' END
  LEFT JOIN base g ON g.source = p.source AND g.key = instrument || '|' || daynight
  WHERE acq_datetime >= TIMESTAMP '2024-01-16'
), zed AS (SELECT *, 0.6745 * (frp - med) / greatest(mad, 1e-6) AS z, frp / CASE WHEN p99 > 0 THEN p99 END AS ratio_p99 FROM judged)"""


def tiers_sql(z_breach: float, p99_breach: float) -> str:
    return f"""WITH {PASS_DETECTIONS}, b AS (
  SELECT *, coalesce(z > {z_breach} AND frp > {p99_breach} * p99, false) AS breach, coalesce(z > 7.0 AND frp > 6.0 * p99, false) AS extreme, baseline_key IS NOT NULL AS known FROM zed
), c AS (SELECT *, coalesce(lag(breach) OVER (PARTITION BY source, known ORDER BY acq_datetime, sensor, session), false) AS before FROM b)
SELECT source, sensor, session, baseline_key, round(z, 4) AS z, round(ratio_p99, 4) AS ratio_p99, breach, extreme,
  CASE WHEN known AND breach AND before THEN 'confirmed' WHEN known AND extreme THEN 'provisional' END AS alert FROM c"""
