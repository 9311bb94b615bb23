"""Deterministic sample signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import RATE

PADDING_SECONDS = 0.6


def tones_of(rows: DataFrame, seconds: float = 1.0, rate: int = RATE) -> DataFrame:
    """(id, rate, y) of rows (id): a sine tone between two silences, its pitch rising with the id."""
    quiet = F.array_repeat(F.lit(0.0), int(PADDING_SECONDS * rate))
    pitch = (F.col("id") % 24) * 20 + 220
    wave = F.transform(F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1)), lambda i: F.sin(i * pitch * (2 * 3.141592653589793 / rate)) * 0.5)
    return rows.select("id", F.lit(rate).alias("rate"), F.concat(quiet, wave, quiet).alias("y"))


def tones(spark: SparkSession, n: int, seconds: float = 1.0, rate: int = RATE) -> DataFrame:
    """The tones of the ids below ``n``."""
    return tones_of(spark.range(n), seconds, rate)
