"""The corpus pipeline: five stages from documents to a mix of sources.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the
last return the columns of ``docs``.  A row travels as one struct, so extra columns
never meet a stage's own names.  Null texts count as empty (the first stage rejects
them), null ids stay, an empty table passes through, and of repeated rows the second
stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import small_side, stage, table
from earshot.llm.decontaminate import contamination
from earshot.llm.languages import fit, identify
from earshot.llm.mixing import mix_sources
from earshot.llm.secrets import find_secrets, redacted
from earshot.llm.similar import similar_rows

#: A document goes if its first language has less than this share of it.
LEAST_SHARE = 0.5
#: Near duplicates have sets of word shingles of this length that are so similar (Jaccard).
SHINGLE, SIMILARITY = 5, 0.8


def packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in a known language, or without a main language, go."""
    names, model = fit(docs)
    found = identify(packed(docs), names, model, ("_doc",))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the row of the least id stays."""
    rows = stage(packed(docs).select(F.monotonically_increasing_id().alias("row"), "_doc"), "pipeline-rows")
    texts = rows.select("row", F.col("_doc.text").alias("text"))
    found = stage(similar_rows(texts, SHINGLE, SIMILARITY).select("row", F.col("component_id").alias("component")), "pipeline-components")
    ids = rows.select(F.col("row").alias("r2"), F.col("_doc.doc_id").alias("doc_id"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = found.join(ids, F.col("row") == F.col("r2")).groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.row").alias("row"))
    gone = small_side(stage(found.join(first, "row", "left_anti").select("row"), "pipeline-gone"))
    return rows.join(gone, "row", "left_anti").select("_doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination(packed(docs), table(spark, sf_dir, "benchmark"), ("_doc",))
    return found.filter(F.size("hits") == 0).select("_doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    found = find_secrets(packed(docs), ("_doc",))
    text = redacted(F.col("_doc.text"), F.col("spans"))
    columns = []
    for c in docs.columns:
        old = F.col(f"_doc.`{c}`")
        if c == "text":
            old = text
        elif c == "n_chars":
            old = F.when(F.size("spans") > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return found.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of sources at their target weights."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix", mix),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
