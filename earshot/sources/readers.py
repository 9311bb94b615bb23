"""Sources: manifests, audio folders, transcripts, archives, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import after_first_blank, stem, strip, suffix
from ..operators.relational import attach_references
from ..schemas import MANIFEST
from .archives import speech_archive

# What counts as audio.
AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a", ".webm", ".opus", ".aiff", ".aif")


def _blank(c: str) -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV with header; missing ids become file stems, relative paths resolve against the
    manifest's folder, ``limit`` takes the first rows (none or 0: all)."""
    raw = spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False, escape='"', multiLine=True)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = raw.select("*", F.col("_metadata.file_path").alias("_at"), place.alias("_place"))
    rows = raw.orderBy("_place").limit(limit) if limit else raw
    return manifest_rows(rows).select(*MANIFEST.names)


def manifest_rows(raw: DataFrame) -> DataFrame:
    """Rows of a manifest made whole; ``_at`` is the manifest's own path."""
    absolute = F.rlike("path", F.lit(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"))
    folder = F.regexp_replace(F.regexp_replace("_at", "^file:/+", "/"), "/[^/]*$", "/")
    return raw.select(
        F.coalesce(F.nullif("id", F.lit("")), stem(F.col("path"))).alias("id"), F.when(absolute, F.col("path")).otherwise(F.concat(folder, "path")).alias("path"),
        _blank("reference").alias("reference"), _blank("language").alias("language"),
    )


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``*.trans.txt`` lines "key text": id, reference, ordinal; other lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.trans.txt").text(folder)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return transcript_lines(lines.select("value", place.alias("ordinal")))


def transcript_lines(lines: DataFrame) -> DataFrame:
    """id, reference and further columns of lines (value, ...) that hold a blank."""
    key, text = after_first_blank(F.col("value"))
    return lines.filter(F.instr("value", " ") > 0).select(key.alias("id"), text.alias("reference"), *[c for c in lines.columns if c != "value"])


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Whole ``.txt`` files beside audio: path without suffix, side."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.filter(~F.endswith(path, F.lit(".trans.txt"))).select(F.regexp_replace(path, r"\.[^./]*$", "").alias("base"), strip(F.col("value")).alias("side"))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder with references from transcripts, else sidecars; file
    contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    audio = files.filter(suffix(F.col("path")).isin(*AUDIO_SUFFIXES)).select(
        stem(F.col("path")).alias("id"), "path", "length", F.regexp_replace("path", r"\.[^./]*$", "").alias("base")
    )
    side = read_sidecars(spark, folder)
    joined = audio.join(side, F.regexp_replace(audio["base"], "^file:/+", "/") == F.regexp_replace(side["base"], "^file:/+", "/"), "left").drop(side["base"])
    out = attach_references(joined, read_transcripts(spark, folder))
    return out.select("id", "path", F.coalesce(F.nullif("reference", F.lit("")), "side", F.lit("")).alias("reference"), F.lit("").alias("language"), "length").orderBy("path")


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Path and bytes of the audio files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(suffix(F.col("path")).isin(*AUDIO_SUFFIXES)).select("path", "content")


def audio_bytes(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    """Uploaded bytes as the same relation."""
    return spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")


def read_audio_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with id, text and a struct ``audio`` of bytes and path."""
    return nested_audio(spark.read.parquet(path))


def nested_audio(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("id"), F.col("audio.path").alias("path"), F.col("text").alias("reference"), F.col("audio.bytes").alias("content"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headless TSV of three columns or more: the second names the file, the third is its text."""
    return tsv_rows(spark.read.text(path))


def tsv_rows(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.filter(F.size(parts) >= 3).select(parts[1].alias("name"), parts[2].alias("reference"))


def read_speech_archive(spark: SparkSession, paths: str, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """id, path, reference, content of the audio of tar archives with the transcripts found in the same
    archives; with a limit, scans end once they have that many with their transcripts."""
    return speech_archive(spark, paths, AUDIO_SUFFIXES, limit, max_bytes)


def dataset_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every ``manifest.csv`` below a folder: name, path, count, languages."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.csv").csv(root, header=True, schema=MANIFEST, enforceSchema=False, escape='"')
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("en")).alias("lang"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("lang")).alias("languages")).select(
        F.element_at(F.split("path", "/"), -2).alias("name"), "path", "count", "languages"
    ).orderBy("path")


def result_history(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Experiment files, newest name first; files that aren't JSON are skipped."""
    schema = "kind string, model string, files long, language string, created string, runs array<map<string,string>>, points array<map<string,string>>, _bad string"
    x = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    return newest_first(x.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")), kind)


def newest_first(results: DataFrame, kind: str | None = None) -> DataFrame:
    """Readable results (kind, file, _bad, ...), of one kind if named."""
    x = results.filter("_bad is null and kind is not null").drop("_bad")
    return (x.filter(F.col("kind") == kind) if kind else x).orderBy(F.desc("file"))
