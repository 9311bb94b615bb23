"""Incremental plans: new audio files, and rolling error rates with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import AUDIO_SUFFIXES
from ..functions.text import stem, suffix


def new_audio(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of audio files as they arrive: id, path, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return files.filter(suffix(F.col("path")).isin(*AUDIO_SUFFIXES)).select(stem(F.col("path")).alias("id"), "path", "content")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived since the last call, once, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rolling_totals(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and failures by window and type; state of closed windows is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rolling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals over the whole table as a batch (one code for both)."""
    return rolling_totals(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"s_rolling_totals": rolling_query}
ORACLE = {
    "s_rolling_totals": """SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
}
