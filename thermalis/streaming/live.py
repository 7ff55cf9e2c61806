"""The live path: detections stream in, repeats are dropped, passes are judged with state kept between batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..tables import written

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        written(spark.range(0))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str = "events.parquet", schema: str = SCHEMA) -> DataFrame:
    """The files of one table as a stream; ts is cast, as watermarks need a timestamp with zone."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream_: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, from the files of its sink."""
    spark, path = stream_.sparkSession, _folder(stream_.sparkSession)
    stream_.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream_.schema).parquet(f"{path}/out")


def without_repeats(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each natural key once while its watermark lasts; later copies pass through and are met by the load's anti-join."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type", "ts"])


def daily_counts(spark: SparkSession, events: DataFrame, delay: str = "2 days") -> DataFrame:
    """(day, event_type, n, peak): tumbling days under a watermark; each batch updates its days in place."""
    path = _folder(spark)
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.to_date("w.start").alias("day"), "event_type", "n", "peak")

    def put(batch: DataFrame, no: int) -> None:
        batch.withColumn("batch", F.lit(no)).write.mode("append").parquet(f"{path}/out")

    days.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{path}/out")
    return updates.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("peak", "batch").alias("peak"))


JUDGED = "source string, session long, sensor string, at long, breach boolean, alert string"


def _chain(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Alerts of one source's judged passes; the state is whether the last one breached."""
    rows = pd.concat(list(batches)).sort_values(["at", "sensor", "session"])
    last = state.get[0] if state.exists else False
    before = [last, *rows["breach"].tolist()[:-1]]
    alert = ["confirmed" if b and p else "provisional" if e else None for b, p, e in zip(rows["breach"], before, rows["extreme"], strict=True)]
    state.update((bool(rows["breach"].iloc[-1]),))
    yield rows.assign(alert=alert, source=key[0])[["source", "session", "sensor", "at", "breach", "alert"]]


def chained_alerts(judged: DataFrame) -> DataFrame:
    """Alert tiers of a stream of judged passes (source, session, sensor, at, breach, extreme), in the order in which batches bring them."""
    return judged.groupBy("source").applyInPandasWithState(_chain, JUDGED, "last boolean", "append", GroupStateTimeout.NoTimeout)
