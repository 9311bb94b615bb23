"""Sinks that show all of their files or none.

Tasks write below a hidden staging folder of the target; the driver moves the files of the
tasks that were committed and removes the rest.  Names depend on what is written, so a rerun
replaces and never adds.  The target is a folder that driver and executors share.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tarfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .writers import upload_manifest


@dataclass
class Staged(WriterCommitMessage):
    """What one task left: its partition and its file, if it had rows."""

    partition: int
    file: str | None


class StagedWriter(DataSourceWriter):
    """Staging, commit and abort; ``fill`` writes one task's file, ``place`` the result."""

    def __init__(self, options: dict):
        self.target = options["path"].removeprefix("file://")
        self.options = dict(options)
        self.staging = os.path.join(self.target, f".staging-{uuid.uuid4().hex}")
        os.makedirs(self.staging)  # by the driver alone: once it is gone, no late task brings it back

    def write(self, iterator: Iterator[Row]) -> Staged:
        context = TaskContext.get()
        # Attempts of one task never share a file; only the committed one is named in its message.
        file = os.path.join(self.staging, f"{context.partitionId():05d}-{context.attemptNumber()}-{uuid.uuid4().hex}")
        try:
            n = self.fill(file, iterator)
        except BaseException:
            if os.path.exists(file):
                os.remove(file)
            raise
        return Staged(context.partitionId(), file if n else None)

    def commit(self, messages: list[Staged | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.partition)
        self.place([m.file for m in done])
        self._clear()

    def _clear(self) -> None:
        for _ in range(100):  # a task that still runs may add a file while others are removed
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.05)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()
        if os.path.isdir(self.target) and not os.listdir(self.target):
            os.rmdir(self.target)

    def fill(self, file: str, rows: Iterator[Row]) -> int:
        raise NotImplementedError

    def place(self, files: list[str]) -> None:
        raise NotImplementedError


def put_text(staging: str, target: str, name: str, text: str) -> None:
    """A whole file at once, by renaming."""
    at = os.path.join(staging, name)
    with open(at, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(at, os.path.join(target, name))


class ArchiveWriter(StagedWriter):
    """A tar archive a task, of rows (member, content)."""

    def fill(self, file: str, rows: Iterator[Row]) -> int:
        n = 0
        with tarfile.open(file, "w") as tar:
            for r in rows:
                info = tarfile.TarInfo(r["member"])
                info.size = len(r["content"])
                tar.addfile(info, io.BytesIO(bytes(r["content"])))
                n += 1
        return n

    def place(self, files: list[str]) -> None:
        old = [f for f in os.listdir(self.target) if f.startswith("part-") and f.endswith(".tar")]
        for k, f in enumerate(files):
            os.replace(f, os.path.join(self.target, f"part-{k:05d}.tar"))
        for f in set(old) - {f"part-{k:05d}.tar" for k in range(len(files))}:
            os.remove(os.path.join(self.target, f))


class ExperimentWriter(StagedWriter):
    """One JSON file of the payload, named by kind and time, and a CSV file of its runs or points."""

    def fill(self, file: str, rows: Iterator[Row]) -> int:
        n = 0
        with open(file, "w", encoding="utf-8") as out:
            for r in rows:
                out.write(r["payload"] + "\n")
                n += 1
        return n

    def place(self, files: list[str]) -> None:
        for f in files:
            with open(f, encoding="utf-8") as lines:
                for line in lines:
                    self.show(json.loads(line))

    def show(self, payload: dict) -> None:
        stamp = "".join(c if c.isdigit() else "" for c in str(payload.get("created", "")))[:14]
        name = f"{payload['kind']}_{stamp[:8]}_{stamp[8:]}"
        put_text(self.staging, self.target, name + ".json", json.dumps(payload, indent=1, ensure_ascii=False))
        for part in ("runs", "points"):
            if payload.get(part):
                text = io.StringIO()
                table = csv.DictWriter(text, list(dict.fromkeys(k for row in payload[part] for k in row)), lineterminator="\n")
                table.writeheader()
                table.writerows(payload[part])
                put_text(self.staging, self.target, name + ".csv", text.getvalue())


class UploadWriter(StagedWriter):
    """Audio files under their own names and a manifest of them, of rows (id, path, reference, language, content)."""

    COLUMNS = ("id", "path", "reference", "language")

    def fill(self, file: str, rows: Iterator[Row]) -> int:
        n = 0
        with open(file, "w", encoding="utf-8") as out:
            for r in rows:
                n += 1
                with open(f"{file}.{n}", "wb") as audio:
                    audio.write(bytes(r["content"]))
                out.write(json.dumps([f"{file}.{n}", *(r[c] for c in self.COLUMNS)]) + "\n")
        return n

    def place(self, files: list[str]) -> None:
        rows = []
        for f in files:
            with open(f, encoding="utf-8") as lines:
                rows += map(json.loads, lines)
        for staged, _, path, *_ in rows:
            os.replace(staged, os.path.join(self.target, os.path.basename(path)))
        text = io.StringIO()
        table = csv.writer(text, lineterminator="\n")
        table.writerow(self.COLUMNS)
        table.writerows(sorted((r[1:] for r in rows), key=lambda r: r[1]))
        put_text(self.staging, self.target, "manifest.csv", text.getvalue())


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "speech_tar_sink"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return ArchiveWriter(self.options)


class UploadSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upload_sink"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return UploadWriter(self.options)


class ExperimentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "experiment_sink"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return ExperimentWriter(self.options)


def _save(rows: DataFrame, source: type[DataSource], path: str) -> None:
    rows.sparkSession.dataSource.register(source)
    rows.write.format(source.name()).mode("append").save(path)


def write_archives(members: DataFrame, path: str) -> None:
    """Rows (member, content) as ``part-*.tar`` files below ``path``, one for each partition that
    has rows, members in the order of their rows; earlier parts there are replaced."""
    _save(members.select("member", F.col("content").cast("binary").alias("content")), ArchiveSink, path)


def save_experiment(payload: DataFrame, path: str) -> None:
    """Payload rows (kind, created, runs or points, ...) as ``<kind>_<date>_<time>.json`` and, where they have
    runs or points, ``.csv`` beside it.  The same payload again replaces its files."""
    _save(payload.select(F.to_json(F.struct(*payload.columns), {"ignoreNullFields": "false"}).alias("payload")), ExperimentSink, path)


def save_upload(files: DataFrame, path: str) -> None:
    """Uploaded files (name, content): audio under its own names and ``manifest.csv`` with the references of the
    text files beside it.  Names without audio among them, or one name twice, are refused before anything is written."""
    base = files.select(F.element_at(F.split("name", "/"), -1).alias("name"), "content")
    texts = base.filter(F.endswith(F.lower("name"), F.lit(".txt"))).select("name", F.decode("content", "utf-8").alias("value"))
    rows = upload_manifest(base.select("name"), texts)
    twice = rows.groupBy("path").count().filter("count > 1").orderBy("path").first()
    if twice:
        raise ValueError(f"{twice.path} was uploaded twice")
    if rows.isEmpty():
        raise ValueError("no audio among the uploaded files")
    _save(rows.join(base, F.col("path") == F.col("name")).select(*UploadWriter.COLUMNS, "content"), UploadSink, path)
