"""Command line: transcribe, batch, benchmark, noise, catalog, models, prefetch.

Results of a run go to a new folder below ``--out``, which must be a shared one where executors are
not on this machine; there it can't be left out.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import experiments, models, session, transcribe
from .plans.progress import Watch
from .plans.tables import scratch
from .sources import readers, sinks, writers


def _inputs(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    if a.manifest:
        manifest = readers.read_manifest(spark, a.manifest, a.limit)
        audio = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.manifest.rsplit("/", 1)[0])
        clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
        audio = manifest.join(audio.select(clean("path").alias("path"), "content"), "path").select("id", "content")
    elif a.folder:
        found = readers.scan_folder(spark, a.folder)
        manifest = (found.limit(a.limit) if a.limit else found).drop("length")
        audio = manifest.join(readers.read_audio(spark, a.folder), "path").select("id", "content")
    else:
        raise SystemExit("name a --manifest or a --folder")
    return manifest, audio


def _place(spark: SparkSession, out: str | None, name: str) -> str:
    """A new folder for a run's rows."""
    if not out:
        if session.needs_shipping(spark.sparkContext.master):
            raise SystemExit("executors are not on this machine: name a shared folder with --out")
        return "file://" + scratch(spark, name)
    return f"{out.rstrip('/')}/{name}-{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:8]}"


def _told(done: int, tasks: int) -> None:
    print(f"\r{done}/{tasks} tasks", end="" if done < tasks else "\n", file=sys.stderr, flush=True)


def _run(spark: SparkSession, manifest: DataFrame, audio: DataFrame, a: argparse.Namespace, at: str) -> tuple[DataFrame, float]:
    """Recognition once, into rows at ``at``; those rows, and the seconds this took."""
    heard = transcribe.hear(audio, a.model, a.language, a.task, plugins=tuple(a.plugin))
    start = time.perf_counter()
    with Watch(spark, _told, description=f"{a.model} on {a.manifest or a.folder}"):
        transcribe.score(manifest, heard, a.language, a.task).write.parquet(at)
    return spark.read.parquet(at), max(time.perf_counter() - start, 1e-3)


def batch(a: argparse.Namespace) -> None:
    spark = session.open_session(a.master, a.threads)
    at = _place(spark, a.out, "batch")
    scored, wall = _run(spark, *_inputs(spark, a), a, f"{at}/scored")
    if a.out:
        writers.write_results(transcribe.results(scored), f"{at}/csv")
    report = transcribe.summary(scored, wall)
    print(report.select(writers.as_json(report)).first()[0])


def transcribe_file(a: argparse.Namespace) -> None:
    """One file, as a table of one row."""
    spark = session.open_session(a.master, a.threads)
    with open(a.file, "rb") as f:
        audio = readers.audio_bytes(spark, [(a.file, f.read())]).select(F.lit("0").alias("id"), "content")
    manifest = spark.createDataFrame([("0", a.file, a.reference, "")], "id string, path string, reference string, language string")
    heard = transcribe.hear(audio, a.model, a.language, a.task, plugins=tuple(a.plugin))
    row = transcribe.results(transcribe.score(manifest, heard, a.language, a.task)).first().asDict()
    print(json.dumps({k: v for k, v in row.items() if v is not None and k != "id"}, ensure_ascii=False))
    if row["error"]:
        raise SystemExit(1)


def benchmark(a: argparse.Namespace) -> None:
    """The same files with one task and with more and more of them."""
    spark = session.open_session(a.master, a.threads)
    manifest, audio = _inputs(spark, a)
    at, files = _place(spark, a.out, "benchmark"), manifest.count()
    counts = [int(x) for x in a.workers.split(",")] if a.workers else experiments.worker_counts(spark.sparkContext.defaultParallelism)

    def run(workers: int, name: str = "spark") -> dict:
        scored, wall = _run(spark, manifest, audio.repartition(workers), a, f"{at}/{name}-{workers}")
        s = transcribe.summary(scored, wall).first()
        return {"rtfx": s.rtfx, "wer": s.wer}

    runs = experiments.scaling(spark, run, counts, lambda: run(1, "local"))
    writers.benchmark_table(runs).show(truncate=False)
    if a.out:
        sinks.save_experiment(experiments.benchmark_payload(runs, a.model, files, a.language), a.out)


def noise(a: argparse.Namespace) -> None:
    spark = session.open_session(a.master, a.threads)
    payload = experiments.noise_payload(*_inputs(spark, a), a.model, a.language, tuple(a.plugin))
    at = _place(spark, a.out, "noise") + "/payload"
    payload.write.parquet(at)  # the sweep runs once
    payload = spark.read.parquet(at)
    payload.select(F.inline("points")).show(truncate=False)
    if a.out:
        sinks.save_experiment(payload, a.out)


def catalog(a: argparse.Namespace) -> None:
    readers.dataset_catalog(session.open_session(a.master), a.folder).show(truncate=False)


def registry(a: argparse.Namespace) -> None:
    models.registry(session.open_session(a.master)).show(truncate=False)


def prefetch(a: argparse.Namespace) -> None:
    """Loads the model in as many tasks as run at once."""
    spark = session.open_session(a.master, a.threads)
    n, model, plugins = spark.sparkContext.defaultParallelism, a.model, tuple(a.plugin)

    def load(batches):
        seconds = models.warm_up(model, plugins)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f"{os.uname().nodename}:{os.getpid()}"] * b.num_rows), pa.array([seconds] * b.num_rows)], ["worker", "seconds"])

    spark.range(0, n, 1, n).mapInArrow(load, "worker string, seconds double").groupBy("worker").agg(F.max("seconds").alias("seconds")).orderBy("worker").show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="earshot")
    sub = p.add_subparsers(required=True)

    def command(name, run, *, model: bool = False, files: bool = False):
        s = sub.add_parser(name)
        s.add_argument("--master")
        s.set_defaults(run=run)
        if model:
            s.add_argument("--model", default="stand-in")
            s.add_argument("--threads", type=int, default=1)
            s.add_argument("--plugin", action="append", default=[], help="a module that registers backends")
        if files:
            s.add_argument("--manifest")
            s.add_argument("--folder")
            s.add_argument("--limit", type=int, default=0)
            s.add_argument("--out")
        if model:
            s.add_argument("--language")
            s.add_argument("--task", default="transcribe", choices=("transcribe", "translate"))
        return s

    command("batch", batch, model=True, files=True)
    command("noise", noise, model=True, files=True)
    command("benchmark", benchmark, model=True, files=True).add_argument("--workers", help="such as 1,2,4")
    one = command("transcribe", transcribe_file, model=True)
    one.add_argument("file")
    one.add_argument("--reference", default="")
    command("prefetch", prefetch, model=True)
    command("catalog", catalog).add_argument("folder")
    command("models", registry)
    a = p.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
