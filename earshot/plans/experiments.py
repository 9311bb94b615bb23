"""Experiments over the batch plan: scaling and noise, as payload rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import relative_runs
from .transcribe import noise_sweep


def worker_counts(n: int) -> list[int]:
    """1, 2, 4, ... below ``n``, and ``n``."""
    return [1 << k for k in range(max(n, 1).bit_length()) if 1 << k < n] + [max(n, 1)]


def scaling(spark: SparkSession, run: Callable[[int], dict | None], counts: list[int], baseline: Callable[[], dict | None] | None = None) -> DataFrame:
    """Wall seconds of ``run(workers)`` for each count, after an optional baseline, with
    speed-ups and efficiency, and what runs say of themselves (rtfx, wer).  What limits a run to its
    workers is up to ``run``."""
    rows = []
    for engine, workers, go in [*([("local", 1, baseline)] if baseline else []), *(("spark", n, lambda n=n: run(n)) for n in counts)]:
        start = time.perf_counter()
        told = go() or {}
        rows.append((len(rows), engine, workers, max(round(time.perf_counter() - start, 3), 0.001), told.get("rtfx"), told.get("wer")))
    return relative_runs(spark.createDataFrame(rows, "run_no long, engine string, workers long, wall_s double, rtfx double, wer double"))


def benchmark_payload(runs: DataFrame, model: str, files: int, language: str | None = None) -> DataFrame:
    """One row: what was run, and its runs in order."""
    each = F.array_sort(F.collect_list(F.struct(*runs.columns)))
    return runs.agg(each.alias("runs")).select(
        F.lit("benchmark").alias("kind"), F.lit(model).alias("model"), F.lit(files).alias("files"), F.lit(language or "auto").alias("language"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "runs",
    )


def noise_payload(manifest: DataFrame, audio: DataFrame, model: str, language: str | None = None, plugins: tuple[str, ...] = ()) -> DataFrame:
    points = noise_sweep(manifest, audio, model, language=language, plugins=plugins).select("label", "wer", "cer")
    return points.agg(F.array_sort(F.collect_list(F.struct("label", "wer", "cer"))).alias("points")).select(
        F.lit("noise").alias("kind"), F.lit(model).alias("model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "points"
    )
