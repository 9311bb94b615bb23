"""Published Parquet sets of speech: files of several splits below one root.

Planning lists the files of the root, or, if it has none, those of its fallback revision, and
keeps the preferred split where the query names none.  Filters on ``split`` and ``file`` choose
files, those on ``path`` rows inside the scan; none of them is left above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

# Where a set keeps its converted files, and the split that is preferred.
FALLBACK, PREFERRED = "refs/convert/parquet", "clean"
SCHEMA = "split string, file string, id string, path string, reference string, content binary"
ROWS = 256


def split_of(file: str) -> str:
    """The folder of a file, or what its name has before its number."""
    folder, _, name = file.rpartition("/")
    return folder or re.sub(r"(-\d+(-of-\d+)?)?\.parquet$", "", name)


def list_files(root: str) -> list[str]:
    """Relative names of the files of a set, of its fallback revision if it has no others."""
    top = Path(root)
    below = lambda at: sorted(p.relative_to(at).as_posix() for p in at.rglob("*.parquet") if p.is_file())
    return [f for f in below(top) if not f.startswith("refs/")] or [f"{FALLBACK}/{f}" for f in below(top / FALLBACK)]


def named(file: str) -> str:
    return file.removeprefix(f"{FALLBACK}/")


class File(InputPartition):
    def __init__(self, file: str):
        self.file = file


class SplitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.prefer = options["path"].removeprefix("file://"), options.get("prefer", PREFERRED)
        self.splits: set[str] | None = None
        self.files: set[str] | None = None
        self.rows: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        meet = lambda held, new: set(new) if held is None else held & set(new)
        for f in filters:
            column = getattr(f, "attribute", ())
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if column == ("split",) and values is not None:
                self.splits = meet(self.splits, values)
            elif column == ("file",) and values is not None:
                self.files = meet(self.files, values)
            elif column in (("split",), ("file",)) and isinstance(f, IsNotNull):
                continue  # they never are
            elif column == ("path",) and values is not None:
                self.rows.append(("in", values))
            elif column == ("path",) and isinstance(f, (StringStartsWith, StringEndsWith, IsNotNull)):
                kind = {StringStartsWith: "starts", StringEndsWith: "ends", IsNotNull: "there"}[type(f)]
                self.rows.append((kind, (getattr(f, "value", None),)))
            else:
                yield f

    def partitions(self) -> list[File]:
        found = list_files(self.root)
        if self.splits is None and self.files is None and self.prefer:
            found = [f for f in found if self.prefer in named(f)] or found
        return [File(f) for f in found if (self.splits is None or split_of(named(f)) in self.splits) and (self.files is None or named(f) in self.files)]

    def condition(self):
        at, out = pc.field("audio", "path"), None
        for kind, values in self.rows:
            one = {"in": lambda v: at.isin(list(v)), "starts": lambda v: pc.starts_with(at, v[0]), "ends": lambda v: pc.ends_with(at, v[0]), "there": lambda v: at.is_valid()}[kind](values)
            out = one if out is None else out & one
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        data = ds.dataset(f"{self.root}/{partition.file}", format="parquet")
        keys = {"id": pc.field("id").cast(pa.string())} if "id" in data.schema.names else {}
        columns = keys | {"path": pc.field("audio", "path"), "reference": pc.field("text"), "content": pc.field("audio", "bytes")}
        for b in data.to_batches(columns=columns, filter=self.condition(), batch_size=ROWS):
            paths = b.column("path").to_pylist()
            given = b.column("id").to_pylist() if keys else [None] * len(paths)
            ids = pa.array([i or (p and PurePosixPath(p).stem) for i, p in zip(given, paths, strict=True)], pa.string())
            text = lambda v, n=b.num_rows: pa.array([v] * n, pa.string())
            file = named(partition.file)
            yield pa.RecordBatch.from_arrays(
                [text(split_of(file)), text(file), ids, b.column("path"), b.column("reference"), b.column("content").cast(pa.binary())], ["split", "file", "id", "path", "reference", "content"]
            )


class SplitSource(DataSource):
    """``spark.read.format("speech_splits").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "speech_splits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> SplitReader:
        return SplitReader(self.options)


def read_splits(spark: SparkSession, root: str, prefer: str = PREFERRED) -> DataFrame:
    """split, file, id, path, reference, content; the preferred split (if there is one) unless
    a filter names splits or files.  Turns on the session's filter pushdown into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SplitSource)
    return spark.read.format("speech_splits").option("prefer", prefer).load(root)
