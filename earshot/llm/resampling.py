"""Resampling of documents towards a target distribution by importance weights.

Features are runs of up to ``MOST_WORDS`` words, hashed to ``BUCKETS`` buckets by CRC-32.  The
counts of all documents are a sparse matrix, documents by buckets, which is written once as blocks in
compressed rows (ids, row starts, buckets, counts).  Column sums of the blocks give the
distribution of the source, the target's texts give theirs; the gain of a bucket is a floored
thousandfold log ratio.  The product of the matrix with the gains, block by block, gives the
weights.  Gumbel noise from a hash of the id turns the weights into scores, and the documents
with the highest scores are a draw without replacement.

Ranks come from counts of equal scores (scores are integers of a bounded range, so the counts
fit one task) and an order among equal scores only.

Defined cases: a null text has no features, weight 0 and is not eligible; a null id counts as
an empty string in the hash, and comes first among equal scores; repeated rows are documents of their own and may
both be drawn; an empty target has zero counts; an empty table gives no rows; further columns of the
input are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

MOST_WORDS, BUCKETS = 1, 10_000
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
#: Documents and entries of one block, at most (a document is never cut), and blocks written or read at once.
#: A document has ``BUCKETS`` entries at most, so a task holds at most eight megabytes of the matrix.
BLOCK_ROWS, BLOCK_ENTRIES, GROUP_BLOCKS = 4096, 1 << 15, 16
#: Features whose buckets a task remembers.
KNOWN = 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = "ids array<long>, words array<long>, starts array<int>, buckets array<int>, counts array<long>"


def bucket_counts(text: bytes, most: int, known: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of words, and counts by bucket."""
    words = _WORD.findall(text.lower())
    features = Counter(words)
    for n in range(2, most + 1):
        features.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out: Counter = Counter()
    for f, n in features.items():
        at = known.get(f)
        if at is None:
            if len(known) >= KNOWN:
                known.clear()
            at = known[f] = zlib.crc32(f) % BUCKETS
        out[at] += n
    return len(words), out


def count_blocks(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The count matrix of rows (doc_id, text) as blocks in compressed rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, words, starts, buckets, counts = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array([x], pa.list_(t)) for x, t in zip((ids, words, starts, buckets, counts), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "words", "starts", "buckets", "counts"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                n, row = bucket_counts(text or b"", most, known)
                ids.append(i)
                words.append(n)
                buckets += sorted(row)
                counts += [row[k] for k in sorted(row)]
                starts.append(len(buckets))
                if len(ids) >= BLOCK_ROWS or len(buckets) >= BLOCK_ENTRIES:
                    yield block()
                    ids, words, starts, buckets, counts = [], [], [0], [], []
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, BLOCK)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """Counts of every bucket over all blocks: at most ``BUCKETS`` rows leave a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for b in batches:
            np.add.at(sums, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in blocks.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of every bucket."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((float(t + 1) * all_s) / (float(s + 1) * all_t) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, over the row sums."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                starts, at, n = (b.column(c)[k].values.to_numpy() for c in (2, 3, 4))
                before = np.zeros((2, len(at) + 1), np.int64)
                np.cumsum(n, out=before[0, 1:])
                np.cumsum(gain[at] * n, out=before[1, 1:])
                features, total = before[:, starts[1:]] - before[:, starts[:-1]]
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, b.column(1)[k].values, pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.select("ids", "words", "starts", "buckets", "counts").mapInArrow(product, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a Gumbel variate g from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn); ``docs``: doc_id, text,
    ``target``: text."""
    blocks = stage(count_blocks(docs, most), "resampling-blocks", GROUP_BLOCKS)
    gain = gains(column_sums(blocks), column_sums(count_blocks(target.select(F.lit(0).alias("doc_id"), "text"), most)))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), SEED))
    scored = stage(scored, "resampling-scores")
    eligible = F.col("n_words") >= least_words
    # One row for each score: a few ten thousand whatever the input.
    counts = scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
    above = (counts["n"].cumsum() - counts["n"]).to_numpy()
    draw = int(counts["n"].sum()) * percent // 100
    starts = {int(s): int(a) for s, a in zip(counts["score"], above, strict=True) if a < draw}
    out = scored.select("doc_id", "n_features", "weight", "score", eligible.alias("fit"))
    least = min(starts, default=None)
    rest = out if least is None else out.filter(~F.col("fit") | (F.col("score") < least))
    rest = rest.withColumn("rank", F.lit(None).cast("long"))
    if least is not None:
        spark = docs.sparkSession
        ahead = F.broadcast(spark.createDataFrame(list(starts.items()), "s2 long, ahead long"))
        place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id")) + F.col("ahead")
        drawn = out.filter(F.col("fit") & (F.col("score") >= least)).join(ahead, F.col("score") == F.col("s2")).withColumn("at", place.cast("long"))
        rest = rest.unionByName(drawn.withColumn("rank", F.when(F.col("at") <= draw, F.col("at"))).select(*rest.columns))
    return rest.drop("fit")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_resampling": op13_resampling}

# CRC-32 from its definition: each byte goes in and eight bits are shifted out.
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op13_resampling": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
w AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM d) GROUP BY ALL),
t AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS word FROM benchmark) GROUP BY ALL),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM w UNION SELECT DISTINCT word FROM t)),
s AS (SELECT bucket, sum(n) AS n FROM w JOIN crc USING (word) GROUP BY bucket),
tb AS (SELECT bucket, sum(n) AS n FROM t JOIN crc USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(tb.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM w) + {BUCKETS})::DOUBLE) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN tb USING (bucket)),
f AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM w JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
""",
}
