"""Tar archives of speech: scans that stop early, skip members unread and count what they did.

An archive is one partition and is read as a stream, once.  Audio waits on its worker until its
transcript comes by, up to ``hold`` bytes; what had to be let go because transcripts came
too late is read in a second pass over that archive.  A key's transcript is the last one
before its audio, else the first after it, else blank.

A scan with a ``limit`` takes that many audio members of an archive (or until their bytes exceed
``max_bytes``), then reads transcripts only, and ends as soon as all it took have theirs.
Members that a pushed filter or the Bloom filter of ``wanted`` names rules out are passed over
without reading their contents.
"""

from __future__ import annotations

import base64
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

#: Bytes of audio that may wait for transcripts.
HOLD = 64 << 20
#: Bits a name in the filter of wanted names, hash functions, and names beyond which no filter is built.
BITS_PER_NAME, HASHES, MOST_NAMES = 16, 4, 1 << 24

# ------------------------------------------------------------------ wanted names


class Wanted:
    """A Bloom filter of names."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, 64 * len(bits)

    def __contains__(self, name: str) -> bool:
        data = name.encode()
        for seed in range(HASHES):
            at = xxhash.xxh64_intdigest(data, 42) if seed == 0 else xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little"), xxhash.xxh64_intdigest(data, 42))
            at %= self.size
            if not int(self.bits[at >> 6]) >> (at & 63) & 1:
                return False
        return True

    def text(self) -> str:
        return base64.b64encode(self.bits.tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Wanted:
        return Wanted(np.frombuffer(base64.b64decode(text), np.uint64))


def wanted_names(names: DataFrame) -> Wanted | None:
    """The filter of a one-column table of names, built as an aggregate of words of bits: at most
    one word for each four names reaches the driver.  None where there are too many names."""
    names = names.toDF("name").filter("name is not null").distinct()
    n = names.count()
    if n > MOST_NAMES:
        return None
    words = 1 << max(0, (n * BITS_PER_NAME - 1) // 64).bit_length()
    # The size is a power of two, so the low bits of the hash are the place.
    hashes = F.array(F.xxhash64("name"), *[F.xxhash64("name", F.lit(s)) for s in range(1, HASHES)])
    at = names.select(F.explode(hashes).alias("h")).select(F.col("h").bitwiseAND(F.lit(64 * words - 1)).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(words, np.int64)
    for r in bits.collect():
        out[r.word] = r.bits
    return Wanted(out.view(np.uint64))


# ------------------------------------------------------------------ one archive


@dataclass
class Scan:
    """What a scan of one archive did."""

    #: Members passed, audio taken, audio passed over unread, bytes of audio read.
    members: int = 0
    taken: int = 0
    skipped: int = 0
    size: int = 0
    stopped: bool = False
    #: Second passes for audio whose transcripts came too late.
    passes: int = 1


@dataclass
class Rules:
    """What a scan takes."""

    suffixes: tuple[str, ...]
    limit: int | None = None
    max_bytes: int | None = None
    hold: int = HOLD
    wanted: Wanted | None = None
    ids: frozenset[str] | None = None

    def takes(self, name: PurePosixPath) -> bool:
        return (self.ids is None or name.stem in self.ids) and (self.wanted is None or name.name in self.wanted)

    def full(self, scan: Scan) -> bool:
        return (self.limit is not None and scan.taken >= self.limit) or (self.max_bytes is not None and scan.size >= self.max_bytes)


def _lines(data: bytes) -> Iterator[tuple[str, str]]:
    for line in data.decode("utf-8", "replace").splitlines():
        key, blank, text = line.partition(" ")
        if blank:
            yield key, text


def speech(path: str, rules: Rules, scan: Scan) -> Iterator[tuple[int, str, str, bytes]]:
    """(position, member, reference, content) of an archive's audio, as its transcripts come by."""
    texts: dict[str, str] = {}
    waiting: dict[str, list[tuple[int, str, bytes]]] = {}
    held, late = 0, {}
    with tarfile.open(path, "r|*") as tar:
        for position, m in enumerate(tar):
            scan.members += 1
            name = PurePosixPath(m.name)
            if m.isfile() and m.name.endswith(".trans.txt"):
                for key, text in _lines(tar.extractfile(m).read()):
                    texts[key] = text
                    for at, member, content in waiting.pop(key, ()):
                        held -= len(content)
                        yield at, member, text, content
            elif m.isfile() and name.suffix.lower() in rules.suffixes:
                if rules.full(scan) or not rules.takes(name):
                    scan.skipped += 1
                else:
                    content = tar.extractfile(m).read()
                    scan.taken, scan.size = scan.taken + 1, scan.size + len(content)
                    if name.stem in texts:
                        yield position, m.name, texts[name.stem], content
                    elif held + len(content) > rules.hold:
                        late[position] = name.stem
                    else:
                        waiting.setdefault(name.stem, []).append((position, m.name, content))
                        held += len(content)
            if rules.full(scan) and not waiting and all(s in texts for s in late.values()):
                scan.stopped = True
                break
    for rest in waiting.values():
        for at, member, content in rest:
            yield at, member, "", content
    if late:
        scan.passes += 1
        with tarfile.open(path, "r|*") as tar:
            for position, m in enumerate(tar):
                if position in late:
                    yield position, m.name, texts.get(late.pop(position), ""), tar.extractfile(m).read()
                if not late:
                    break


# ------------------------------------------------------------------ data sources


class Archive(InputPartition):
    def __init__(self, place: int, path: str):
        self.place, self.path = place, path


class ArchiveReader(DataSourceReader):
    """Partitions and rules of a scan; filters on ``archive`` drop partitions, those on ``id`` members."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        number = lambda k: int(options[k]) if options.get(k) else None
        suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        wanted = Wanted.parse(options["wanted"]) if options.get("wanted") else None
        self.rules = Rules(suffixes, number("limit"), number("max_bytes"), number("hold") or HOLD, wanted)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, IsNotNull)) else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("archive",):
                self.paths = [p for p in self.paths if values is None or p in values]
            elif column == ("id",):
                if values is not None:
                    self.rules.ids = frozenset(values) if self.rules.ids is None else self.rules.ids & values
            else:
                yield f

    def partitions(self) -> list[Archive]:
        return [Archive(i, p) for i, p in enumerate(self.paths)]


class SpeechReader(ArchiveReader):
    def read(self, partition: Archive) -> Iterator[tuple]:
        for position, member, reference, content in speech(partition.path, self.rules, Scan()):
            yield partition.path, partition.place, position, PurePosixPath(member).stem, member, reference, content


class ReportReader(ArchiveReader):
    def read(self, partition: Archive) -> Iterator[tuple]:
        scan = Scan()
        for _ in speech(partition.path, self.rules, scan):
            pass
        yield partition.path, scan.members, scan.taken, scan.skipped, scan.size, scan.stopped, scan.passes


class SpeechSource(DataSource):
    """``spark.read.format("speech_tar").option("limit", 100).load("a.tar.gz,b.tar")``"""

    @classmethod
    def name(cls) -> str:
        return "speech_tar"

    def schema(self) -> str:
        return "archive string, place int, position long, id string, path string, reference string, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SpeechReader(self.options)


class ReportSource(DataSource):
    """What the same scan reads, without its rows."""

    @classmethod
    def name(cls) -> str:
        return "speech_tar_report"

    def schema(self) -> str:
        return "archive string, members long, taken long, skipped long, size long, stopped boolean, passes int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ReportReader(self.options)


def scan_archives(spark: SparkSession, paths: str, suffixes: tuple[str, ...], report: bool = False, **options) -> DataFrame:
    """One row an audio member (or, as ``report``, an archive); options are those of ``Rules``.
    Turns on the session's filter pushdown into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = ReportSource if report else SpeechSource
    spark.dataSource.register(source)
    r = spark.read.format(source.name()).option("suffixes", ",".join(suffixes))
    for k, v in options.items():
        if v is not None:
            r = r.option(k, v.text() if isinstance(v, Wanted) else str(v))
    return r.load(paths)


def speech_archive(spark: SparkSession, paths: str, suffixes: tuple[str, ...], limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """id, path, reference, content of the audio of archives; ``limit`` takes the first ones in the
    order of the archives and their members (none or 0: all)."""
    rows = scan_archives(spark, paths, suffixes, limit=limit or None, max_bytes=max_bytes)
    if limit:
        rows = rows.orderBy("place", "position").limit(limit)
    return rows.select("id", "path", "reference", "content")


def referenced_archive(spark: SparkSession, refs: DataFrame, paths: str, suffixes: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """id, path, reference, content of the audio members that ``refs`` (name, reference) names; the
    reader passes over the others.  Of repeated names the last reference by order of text holds."""
    one = refs.groupBy("name").agg(F.max("reference").alias("reference"))
    rows = scan_archives(spark, paths, suffixes, wanted=wanted_names(one.select("name")))
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).drop("reference").join(one, "name")
    if limit:
        rows = rows.orderBy("place", "position").limit(limit)
    return rows.select("id", F.col("name").alias("path"), "reference", "content")
