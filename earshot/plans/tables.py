"""Reading the input tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one (``spark.checkpoint.dir``); below a temporary one only
    where none is named and all executors are on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "earshot-scratch")
    return f"{top.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """A scan of fewer tasks than cores, or of fewer than one for ``rows_a_task`` rows, is dealt before an
    expensive expression; any larger scan stays as it is, without a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        want = max(want, -(-df.count() // rows_a_task))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as per-file result rows: times, worker, error."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("value").alias("duration_s"), (F.col("value") / 10 + 0.05).alias("infer_s"),
        (F.col("value") / 64).alias("preprocess_s"), F.when(F.col("event_id") % 8 == 0, F.col("user_id") / 16).alias("model_load_s"),
        F.concat(F.lit("node:"), F.col("user_id").cast("string")).alias("worker"),
        F.when(F.col("event_type") == "error", F.lit("inference: stopped")).alias("error"),
        F.when(F.col("user_id") % 5 != 0, F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("user_id") % 4 + 1).cast("int"))).alias("language"),
    )


#: The same rows in SQL.
RESULT_SQL = """SELECT event_id AS id, value AS duration_s, value / 10 + 0.05 AS infer_s,
  value / 64 AS preprocess_s, CASE WHEN event_id % 8 = 0 THEN user_id / 16 END AS model_load_s, 'node:' || user_id AS worker,
  CASE WHEN event_type = 'error' THEN 'inference: stopped' END AS error,
  CASE WHEN user_id % 5 <> 0 THEN ['en', 'fr', 'de', 'es'][user_id % 4 + 1] END AS language FROM events"""
