"""Sinks: manifests, experiments, result tables, WAV bytes."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MANIFEST


def write_manifest(rows: DataFrame, path: str) -> None:
    """The four columns with a header, blanks for what is missing; one file."""
    manifest_columns(rows).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def manifest_columns(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    columns = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in MANIFEST.names]
    return rows.select(*columns)


def write_results(rows: DataFrame, path: str, kind: str = "csv") -> None:
    writer = rows.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if kind == "csv" else writer.format(kind).save(path)


def write_experiment(payload: DataFrame, path: str) -> None:
    """The payload as JSON and, where it has runs or points, one CSV row for each."""
    payload.coalesce(1).write.mode("overwrite").json(path + "/json")
    for part in ("runs", "points"):
        if part in payload.columns:
            points(payload, part).coalesce(1).write.mode("overwrite").csv(path + "/csv", header=True)


def points(payload: DataFrame, part: str) -> DataFrame:
    return payload.select(F.inline(part))


def benchmark_table(runs: DataFrame) -> DataFrame:
    """The columns of a benchmark shown on the console."""
    return runs.select("engine", "workers", "wall_s", "rtfx", "speedup_vs_single", "efficiency", "wer")


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def upload_manifest(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Uploaded files (name) with references of uploaded text files (name, value); text
    and table files are no rows."""
    from ..functions.text import stem, strip, suffix

    audio = files.filter(~suffix(F.col("name")).isin(".txt", ".csv")).select(stem(F.col("name")).alias("id"), F.col("name").alias("path"))
    side = sidecars.select(stem(F.col("name")).alias("id"), strip(F.col("value")).alias("reference"))
    return audio.join(side, "id", "left").select("id", "path", F.coalesce("reference", F.lit("")).alias("reference"), F.lit("").alias("language"))


def wav_bytes(y: np.ndarray, rate: int = 16_000) -> bytes:
    """PCM16 WAV of one (samples) or more (samples, channels) channels, clipped at one."""
    y = np.asarray(y, float)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if y.ndim == 1 else y.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
