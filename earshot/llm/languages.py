"""Language identification as inference in a mixture of languages.

Learning: character trigrams (lower-cased letters, other characters as blanks,
hashed to ``BUCKETS``) are counted by language over a sample of about
``DOCS_PER_LANGUAGE`` labelled documents of each language, drawn by hashed id, and
smoothed into one distribution a language.

Inference: a document's trigrams are draws from a mixture of those distributions.
Expectation-maximisation estimates the proportions; languages enter in the order of
their proportions as long as the penalised likelihood (BIC, with the likelihood
divided by three because neighbouring trigrams overlap) gains.  The prediction is
the language with the largest proportion among the chosen set, the score its
proportion.  Every whole text is used.

Defined cases: null text or a text without letters gives ``und`` with score 0 and an
empty mixture (symbols and emoji are no letters); equal proportions go to the language
first in order; with no labelled documents all others are ``und`` too; null ids are
scored but never learnt from; repeated rows are each scored and each learnt from; an
empty table gives no rows; further columns of the input are not read.  The model has a
column for each language, so languages (not documents) are what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, table

BUCKETS = 1 << 13
DOCS_PER_LANGUAGE = 3000
EM_STEPS = 15
SMOOTHING = 0.5

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def trigram_counts(text: str) -> np.ndarray:
    """Hashed trigram counts of one text; all zero where it has no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _LETTER[np.minimum(x, 0xFFFF)]
    beyond = np.flatnonzero(x > 0xFFFF)
    letter[beyond] = [chr(c).isalpha() for c in x[beyond].tolist()]
    if not letter.any():
        return np.zeros(BUCKETS, np.int64)
    x = np.where(letter, x, 32).astype(np.uint64)
    x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
    blank = x == 32
    keep = ~(blank[:-2] & blank[1:-1])
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    h = (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 13)
    return np.bincount(h[keep].astype(np.int64), minlength=BUCKETS)


def _em(p: np.ndarray, c: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood; ``p``: trigrams by languages, ``c``: counts."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] > 1:
        total = c.sum()
        for _ in range(steps):
            pi = pi * ((c / (p @ pi)) @ p) / total
    return pi, float(c @ np.log(p @ pi))


def mixture(counts: np.ndarray, model: np.ndarray) -> list[tuple[int, float]]:
    """Chosen languages and proportions, largest first; ``model``: buckets by languages."""
    at = np.flatnonzero(counts)
    if not len(at) or not model.shape[1]:
        return []
    c, p = counts[at].astype(float), model[at]
    pi, _ = _em(p, c, EM_STEPS)
    order = np.lexsort((np.arange(len(pi)), -pi))
    chosen, share, best = order[:1], np.ones(1), None
    penalty = 0.5 * np.log(c.sum() + 1)
    for k in range(1, len(order) + 1):
        now, like = _em(p[:, order[:k]], c, EM_STEPS)
        value = like / 3 - penalty * (k - 1)
        if best is not None and value <= best:
            break
        chosen, share, best = order[:k], now, value
    return sorted(((int(a), float(b)) for a, b in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed distributions, from rows (doc_id, text, lang)."""
    labelled = labelled.filter("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {x.lang: x["count"] for x in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    names = sorted(sizes)
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("lang") == name, docs_per_language / sizes[name]).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + trigram_counts(text or "")
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])

    # At most BUCKETS rows a language reach the driver.
    model = np.full((BUCKETS, len(names)), SMOOTHING)
    for row in drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        model[row.bucket, names.index(row.lang)] += row.n
    return names, model / model.sum(axis=0)


def identify(docs: DataFrame, names: list[str], model: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by ``keep``, lang_pred, score, mixture."""
    fields = docs.select("doc_id", *keep).schema
    schema = extended(fields, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mixed = [[(names[i], s) for i, s in mixture(trigram_counts(t), model)] if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            arrays += [
                pa.array([m[0][0] if m else "und" for m in mixed]), pa.array([min(1.0, m[0][1]) if m else 0.0 for m in mixed]),
                pa.array([[{"lang": a, "share": s} for a, s in m] for m in mixed], pairs),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*fields.names, "lang_pred", "score", "mixture"])

    x = docs.select("doc_id", *keep, F.col("text").alias("_text"))
    return x.mapInArrow(predict, schema)


def fold(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = fit(docs.filter(fold(3) != 1))
    out = identify(docs, names, model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


QUERIES = {"op2_languages": op2_languages}
ORACLE: dict[str, str] = {}
