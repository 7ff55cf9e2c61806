"""How well a registry covers objects that are known, and how its incidents score by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial


def reference_scores(sources: DataFrame, objects: DataFrame, radius: float) -> DataFrame:
    """One row: recall of active and of all objects, share of sources on one, sources that merge several, and objects in such sources.

    sources: id, x, y; objects: id, x, y, active. A pair counts from `radius` metres down. Shares of
    nothing are null. Both sides are reduced to flags before anything is summed.
    """
    pairs = spatial.near_pairs(sources.select("id", "x", "y"), objects.select("id", "x", "y"), radius).select("id", "r_id").distinct()
    hit = pairs.select(F.col("r_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    found = objects.select("id", "active").join(hit, "id", "left").agg(F.avg(F.when(F.col("active"), F.coalesce("hit", F.lit(0)))).alias("recall_active"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall_all"))
    per_source = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    on = sources.select("id").join(per_source, "id", "left").agg(
        F.avg(F.col("k").isNotNull().cast("int")).alias("on_object"),
        F.count(F.when(F.col("k") >= 2, 1)).alias("merging_sources"),
        F.coalesce(F.sum(F.when(F.col("k") >= 2, F.col("k"))), F.lit(0)).alias("merged_objects"),
    )
    return found.crossJoin(on)  # one row each


def by_group(scored: DataFrame, group: Column) -> DataFrame:
    """(grp, n, max_risk, median_risk) of scored incidents; the median interpolates."""
    return scored.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("max_risk"), F.percentile("risk", 0.5).alias("median_risk"))
