"""The batch plan: decode and clean, recognise, score, summarise.

Only bytes, ids and the few columns that need them go through Python stages; joins,
scores and totals stay in Catalyst.  A noise sweep decodes once and recognises every
level in one plan.
"""

from __future__ import annotations

import os
import socket
import time
import uuid
import zlib
from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal as G
from ..operators.relational import snr_label
from ..operators.scoring import corpus_scores, corpus_totals, run_summary, scorable, score_language, scored_pairs
from ..schemas import RESULT_COLUMNS
from ..sources.decode import decode
from .models import backend, check_language

FACTS = ("orig_sr", "duration_s", "processed_s", "rms_db", "mel_mean", "mel_std", "speech_ratio")
#: One row a chunk; what belongs to the file is on its first.
HEARD = "id string, owner string, snr_db double, pos int, text string, language string, " + ", ".join(f"{c} double" for c in FACTS) + ", preprocess_s double, infer_s double, model_load_s double, worker string, error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[t]) for n, t in (x.split() for x in HEARD.split(", "))])
BATCH = 8


def chunk_waves(wave: np.ndarray, samples: int) -> list[np.ndarray]:
    """Pieces of so many samples, the last one short; an empty signal is a tenth of a second of silence."""
    return np.split(wave, range(samples, len(wave), samples)) if len(wave) else [np.zeros(G.RATE // 10)]


def heard_batch(model: str, batch: list[tuple[dict, np.ndarray]], language: str | None, task: str) -> list[dict]:
    """Rows of the chunks in ``batch`` with what the model heard.  If it fails on them together, each is
    tried alone, so that only those that fail themselves are in error."""
    start = time.perf_counter()

    def told(pieces: list[tuple[dict, np.ndarray]]) -> list[tuple[str, str | None]]:
        held, seconds = backend(model)
        if seconds:
            pieces[0][0]["model_load_s"] = round(seconds, 4)
        out = held.transcribe([w for _, w in pieces], language, task)
        if len(out) != len(pieces):
            raise RuntimeError(f"{len(out)} results for {len(pieces)} chunks")
        return out

    try:
        answers = told(batch)
    except Exception:  # noqa: BLE001  found out one by one
        answers = []
        for piece in batch:
            try:
                answers += told([piece])
            except Exception as e:  # noqa: BLE001
                answers.append(e)
    each = round((time.perf_counter() - start) / len(batch), 4)
    for (row, _), answer in zip(batch, answers, strict=True):
        row["infer_s"] = each
        if isinstance(answer, Exception):
            row["error"] = f"inference: {type(answer).__name__}: {answer}"
        else:
            row["text"], row["language"] = answer[0], answer[1] or language
    return [row for row, _ in batch]


def hear_chunks(audio: DataFrame, model: str, language: str | None = None, task: str = "transcribe", snrs: tuple = (None,), trimmed: bool = True, batch: int = BATCH, seconds: float = G.CHUNK_SECONDS, plugins: tuple[str, ...] = ()) -> DataFrame:
    """Rows of chunks (``HEARD``) of rows (id, content), one set for each noise level.

    Chunks of ``seconds`` of all files of a task go to the model in batches of ``batch``; ``owner`` says which file
    each is of.  Workers import ``plugins``, modules that register backends."""
    check_language(model, language, task)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = f"{socket.gethostname()}:{os.getpid()}"
        for name in plugins:
            import_module(name)

        def pieces() -> Iterator[tuple[dict, np.ndarray | None]]:
            for b in batches:
                for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    owner, y, failed = uuid.uuid4().hex, None, None
                    try:
                        y, rate = decode(data or b"")
                    except Exception as e:  # noqa: BLE001
                        failed = f"preprocess: {type(e).__name__}: {e}"
                    for snr in snrs:
                        first = {"id": key, "owner": owner, "snr_db": snr, "worker": who, "error": failed, "pos": 0}
                        if failed:
                            yield first, None
                            continue
                        start = time.perf_counter()
                        x, facts = G.preprocess(y, rate, trimmed, snr, zlib.crc32((key or "").encode()))
                        first |= facts | {"preprocess_s": round(time.perf_counter() - start, 4)}
                        for pos, w in enumerate(chunk_waves(x, int(seconds * G.RATE))):
                            yield (first if pos == 0 else {"id": key, "owner": owner, "snr_db": snr, "worker": who, "pos": pos}), w

        rows, waiting = [], []
        for row, wave in pieces():
            if wave is None:
                rows.append(row)
            else:
                waiting.append((row, wave))
            if len(waiting) >= batch:
                rows += heard_batch(model, waiting, language, task)
                waiting = []
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if waiting:
            rows += heard_batch(model, waiting, language, task)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return audio.select("id", "content").mapInArrow(work, HEARD)


def hear(audio: DataFrame, model: str, language: str | None = None, task: str = "transcribe", snrs: tuple = (None,), trimmed: bool = True, batch: int = BATCH, seconds: float = G.CHUNK_SECONDS, plugins: tuple[str, ...] = ()) -> DataFrame:
    """(id, snr_db, hypothesis, ...) of rows (id, content), one for each noise level.

    A file that can't be read or recognised gives an error row; others go on.  Chunks are dealt by id alone,
    so a task that runs again sends a file where its first run did."""
    chunks = hear_chunks(audio, model, language, task, snrs, trimmed, batch, seconds, plugins).repartition("id")
    first = lambda c: F.max(c).alias(c)
    told = [first(c) for c in (*FACTS, "preprocess_s", "model_load_s", "worker")]
    x = rejoined(chunks, "id", "owner", "snr_db", more=[*told, F.sum("infer_s").alias("infer_s"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error")])
    good = F.col("error").isNull()
    columns = ["id", "snr_db", F.when(good, F.col("text")).otherwise("").alias("hypothesis"), F.when(good, F.col("language")).alias("language"), *FACTS]
    return x.select(*columns, "preprocess_s", F.when(F.col("infer_s").isNotNull(), F.bround("infer_s", 4)).alias("infer_s"), "model_load_s", "worker", "error")


def score(manifest: DataFrame, heard: DataFrame, language: str | None = None, task: str = "transcribe") -> DataFrame:
    """Result rows with their edit counts: the manifest joined back by id."""
    x = heard.withColumnRenamed("language", "detected").join(manifest.select("id", "path", "reference", F.nullif("language", F.lit("")).alias("ref_language")), "id")
    lang = score_language(F.col("ref_language"), F.lit(language).cast("string"), F.col("detected"), F.lit(task))
    good = scorable() & F.col("error").isNull()
    s = scored_pairs(x.withColumn("language", lang))
    for c in ("words", "char_errors", "char_n", "wer", "cer"):
        value = F.bround(F.col(c), 4) if c in ("wer", "cer") else F.col(c)
        s = s.withColumn(c, F.when(good, value))
    return s.drop("language").withColumnRenamed("detected", "language")


def results(scored: DataFrame) -> DataFrame:
    """The fixed columns in order."""
    return scored.select(*RESULT_COLUMNS)


def summary(scored: DataFrame, wall_s: float, *keys: str) -> DataFrame:
    """Run summary with corpus scores, by keys if any."""
    return run_summary(scored, wall_s, *keys, more=corpus_totals())


def listing(jobs: DataFrame, heavy: tuple[str, ...] = ("rows",)) -> DataFrame:
    """A listing without its heavy columns, which the scan then leaves out."""
    return jobs.drop(*heavy)


def rejoined(heard: DataFrame, *keys: str, more: list | None = None) -> DataFrame:
    """Texts of chunks (keys, pos, text, language) in order, the language most chunks
    have, ties to the least, and the aggregates ``more``."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text"))))
    further = more or []
    x = heard.groupBy(*keys).agg(parts.alias("parts"), F.mode("language", True).alias("language"), *further)
    texts = F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != "")
    carried = [c for c in x.columns if c not in (*keys, "parts", "language")]
    return x.select(*keys, F.when(F.col("language") == "ja", F.array_join(texts, "")).otherwise(F.array_join(texts, " ")).alias("text"), "language", *carried)


def noise_sweep(manifest: DataFrame, audio: DataFrame, model: str, snrs: tuple = (None, 20.0, 10.0, 5.0, 0.0), language: str | None = None, plugins: tuple[str, ...] = ()) -> DataFrame:
    """Error rates by noise level from one pass over the audio."""
    scored = score(manifest, hear(audio, model, language, snrs=snrs, plugins=plugins), language)
    return corpus_scores(scored.withColumn("label", snr_label(F.col("snr_db"))), "label")
