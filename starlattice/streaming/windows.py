"""Structured Streaming over event tables: watermarked windows and sessions in append mode.

A window leaves the state and appears in the result when the watermark passes its end; rows that come later than that
are dropped, so the state holds only what lies within the delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_path

#: An event of nobody, far in the future, ends a replay: it moves the watermark past every window.
CLOSING_DAYS = 3650


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events, as they come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, size: str, delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session.start").alias("start"), "n")


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are remembered for the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def arrivals(events: DataFrame, is_late: F.Column) -> list[DataFrame]:
    """The table as it might have come: the first half of its time, the second half, and then the late rows of the first
    half with a closing event. Only two times reach the driver."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if ends["lo"] is None:
        return [rows]
    middle = F.lit(ends["lo"] + (ends["hi"] - ends["lo"]) / 2)
    early = F.col("ts") < middle
    closing = rows.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).withColumn("ts", F.lit(ends["hi"]).cast("timestamp") + F.expr(f"INTERVAL {CLOSING_DAYS} DAYS"))
    return [rows.filter(early & ~is_late), rows.filter(~early), rows.filter(early & is_late).unionByName(closing)]


def replay(batches: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a streaming query over batches that come one after the other; its result is a table in the shared folder.

    Each batch is written to the source folder and worked off from the same checkpoint, as if the query had been stopped
    and started again; the sink's log keeps a batch that is run twice from showing twice.
    """
    spark = batches[0].sparkSession
    home = shared_path(spark, "stream")
    for batch in batches:
        batch.write.mode("append").parquet(f"{home}/source")
        query = build(event_stream(spark, f"{home}/source", batch.schema))
        running = query.writeStream.outputMode("append").format("parquet").option("path", f"{home}/result").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        finally:
            running.stop()
    return spark.read.schema(query.schema).parquet(f"{home}/result")
