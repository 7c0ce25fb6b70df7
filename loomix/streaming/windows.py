"""Rewritten functions inside Structured Streaming: a watermarked window count over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import latest
from ..functions import scalars
from ..paths import new_path

ORACLE = """SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(CAST(round_even(value, 0) AS BIGINT)) AS total
FROM events GROUP BY 1, 2"""
SCHEMA = "day string, event_type string, n long, total long, batch long"


def daily(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events of each day and type, with changes as they come; a day's state is dropped ``late`` after its end.

    Event times need a zone for a watermark.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(scalars.round_half(F.col("value"))).alias("total"))
    return found.select(scalars.to_iso_date(F.col("w.start")).alias("day"), "event_type", "n", "total")


def run(counts: DataFrame, path: str, checkpoint: str):
    """Starts the stream: each batch's changed rows go to a folder of that batch, written anew if the batch is run again."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/{batch:09d}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each day and type."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)
    return latest(rows, ["day", "event_type"], ["batch"]).drop("batch")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream to its end over the events and returns its table, which executors wrote."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    path = new_path(spark, "daily")
    run(daily(stream), path, new_path(spark, "progress")).awaitTermination()
    return result(spark, path)
