"""Language-model scores by logistic context mixing.

Learning documents give every token's counts, in all and by class (one for each value of
the language column, and one for null).  A token's probability in
a class mixes its smoothed share there with the probability that the bit mixer
(``bitmixer``) gives its spelling; the spelling's weight is the share of tokens seen
once (Good-Turing).  Along the text, online mixing (``bitmixer.repeats``) predicts from the
tokens before whether the text repeats itself; its probability goes to the token so
foreseen, the rest to the model above.  A text's probability is the mixture of the classes', each
weighted by its share of the learning tokens, which is what weights adapted token by
token along the text come to.  Bits per byte follow from the score.

Nothing about tokens reaches the driver: dictionaries of tasks meet in token
partitions; texts are dealt into batches whose distinct tokens are sent to those
partitions and come back with their figures.  Only the mixer is broadcast; its
tables have a fixed size.

Defined cases: null text is empty (its end token is scored); null ids are scored and
held out; repeated rows count and are scored each time; without learning documents
the base is 0 and the mixer is untrained; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmixer import CELLS, ORDERS, SLOTS, BitMixer, count_bits, repeats
from .common import partitions, stage, table

PRIOR, TYPES_A_TASK = 300.0, 500_000
#: Tokens of texts scored together, and of one text more.
TOKENS = 1 << 16
#: The end of a text, as a token; words are never empty.
END = b""


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words and the end."""
    return [*(text or b"").lower().split(), END]


def _dealt(tokens: list[bytes], parts: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        out.setdefault(zlib.crc32(t) % parts, []).append(i)
    return out


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def dictionary(docs: DataFrame, parts: int, classes: int) -> DataFrame:
    """One row a token partition: part, tokens, counts (by class), types, once, totals.

    ``docs``: class (long), text."""

    def flush(counters: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        tokens = list(set().union(*counters.values()))
        counts = np.zeros((len(tokens), classes), np.int64)
        for k, c in counters.items():
            counts[:, k] = [c.get(t, 0) for t in tokens]  # c[t] calls Python where it is missing
        for part, at in _dealt(tokens, parts).items():
            yield _rows("part tokens counts", [part], [b"\n".join([tokens[i] for i in at])], [counts[at].tobytes()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, Counter] = {}
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counters.setdefault(k, Counter()).update(words(text))
            if sum(map(len, counters.values())) > 1_000_000:
                yield from flush(counters)
                counters = {}
        if counters:
            yield from flush(counters)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[dict[bytes, int], list]] = {}
        for b in batches:
            for part, tokens, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index, held = found.setdefault(part, ({}, [np.zeros((0, classes), np.int64)]))
                at = np.array([index.setdefault(t, len(index)) for t in tokens.split(b"\n")])
                if len(held[0]) < len(index):
                    held[0] = np.concatenate([held[0], np.zeros((len(index) * 3 // 2 - len(held[0]) + 1, classes), np.int64)])
                held[0][at] += np.frombuffer(counts, np.int64).reshape(-1, classes)
        for part, (index, held) in found.items():
            counts = held[0][: len(index)]
            yield _rows(
                "part tokens counts types once totals", [part], [b"\n".join(index)], [counts.tobytes()], [len(index)],
                [int((counts.sum(axis=1) == 1).sum())], [counts.sum(axis=0).tolist()],
            )

    dealt = docs.mapInArrow(count, "part long, tokens binary, counts binary").repartition(parts, "part")
    return dealt.mapInArrow(merge, "part long, tokens binary, counts binary, types long, once long, totals array<long>")


def train_mixer(tokens: DataFrame, types: int) -> BitMixer:
    """The bit mixer from all types of the dictionary (each counted once): counts are
    added up; then every task learns weights on its types against all counts, and the
    mean of the weights, by types, and the sums of the map's cells are taken."""
    spark = tokens.sparkSession
    counts = np.zeros((len(ORDERS), SLOTS, 2), np.uint32)
    tasks = min(64, -(-types // TYPES_A_TASK) or 1)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield [t for t in blob.split(b"\n") if t]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_ = np.zeros((len(ORDERS), SLOTS, 2), np.uint32), False
        for some in spelled(batches):
            count_bits(some, own)
            any_ = True
        for k in range(len(ORDERS) if any_ else 0):
            yield _rows("key data", [k], [own[k].tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[key] = sums.get(key, 0) + np.frombuffer(data, np.uint32)
        for key, x in sums.items():
            yield _rows("key data", [key], [np.asarray(x, np.uint32).tobytes()])

    summed = tokens.select("tokens").coalesce(tasks).mapInArrow(count, "key long, data binary")
    for row in summed.repartition(len(ORDERS), "key").mapInArrow(add, "key long, data binary").collect():
        counts[row.key] = np.frombuffer(row.data, np.uint32).reshape(SLOTS, 2)
    mixer = BitMixer(counts)
    sent = spark.sparkContext.broadcast(mixer)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitMixer(sent.value.counts)
        cells, n = np.zeros((2, 8 * CELLS)), 0
        for some in spelled(batches):
            cells += own.learn(sorted(some, key=lambda t: zlib.crc32(t, 2)))
            n += len(some)
        if n:
            values = np.concatenate([own.weights.ravel() * n, cells.ravel(), [n]])
            yield _rows("key value", np.arange(len(values)), values)

    sums = tokens.select("tokens").mapInArrow(learn, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).orderBy("key").collect()
    if sums:
        values = np.array([r.value for r in sums])
        cut = mixer.weights.size
        mixer.weights = (values[:cut] / values[-1]).reshape(mixer.weights.shape)
        mixer.refine(values[cut:-1].reshape(2, -1))
    return mixer


def figures(batched: DataFrame, tokens: DataFrame, mixer, parts: int, classes: int) -> DataFrame:
    """(batch, tokens, counts, spelling): figures of the distinct tokens of every batch."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set] = {}
        for b in batches:
            for batch, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found.setdefault(batch, set()).update(words(text))
        for batch, kinds in found.items():
            kinds = list(kinds)
            for part, at in _dealt(kinds, parts).items():
                yield _rows("part kind batch tokens counts", [part], [1], [batch], [b"\n".join([kinds[i] for i in at])], pa.array([None], pa.binary()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index, counts, spelling = None, {}, None, None
        for b in batches:
            for p, kind, batch, blob, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, index = p, {}
                    counts, spelling = np.zeros((0, classes), np.int64), np.zeros(0, np.float32)
                kinds = blob.split(b"\n")
                new = [t for t in kinds if t not in index]
                if new:
                    size = len(index)
                    index.update(zip(new, range(size, size + len(new)), strict=True))
                    if len(counts) < len(index):  # grows by a half, so that adding stays linear
                        more = len(index) * 3 // 2 - size
                        counts = np.concatenate([counts[:size], np.zeros((more, classes), np.int64)])
                        spelling = np.concatenate([spelling[:size], np.zeros(more, np.float32)])
                    counts[size : len(index)] = np.frombuffer(data, np.int64).reshape(-1, classes) if kind == 0 else 0
                    spelling[size : len(index)] = mixer.value.log10(new)
                if kind:
                    at = np.array([index[t] for t in kinds])
                    wide = counts[at]
                    small = wide if wide.max(initial=0) >= 1 << 31 else wide.astype(np.int32)
                    yield _rows("batch tokens counts spelling", [batch], [blob], [small.T.tobytes()], [spelling[at].tobytes()])

    schema = "part long, kind long, batch long, tokens binary, counts binary"
    asked = batched.select("batch", "text").mapInArrow(ask, schema)
    known = tokens.select("part", F.lit(0).cast("long").alias("kind"), F.lit(-1).cast("long").alias("batch"), "tokens", "counts")
    met = asked.unionByName(known).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(answer, "batch long, tokens binary, counts binary, spelling binary")


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    ``docs``: doc_id, text, lang; ``learn``: condition of the learning documents."""
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    learning = docs.filter(learn)
    names = [x.lang for x in learning.filter("lang is not null").select("lang").distinct().orderBy("lang").collect()]
    classes = len(names) + 1
    of = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("long") - 1, F.lit(len(names))) if names else F.lit(0)
    tokens = stage(dictionary(learning.select(of.cast("long").alias("class"), "text"), parts, classes), "lm-tokens")
    sums = tokens.agg(F.sum("types"), F.sum("once"), *[F.sum(F.get("totals", F.lit(k))) for k in range(classes)]).first()
    types, once, totals = sums[0] or 0, sums[1] or 0, np.array([x or 0 for x in sums[2:]], float)
    n = int(totals.sum())
    mixer = spark.sparkContext.broadcast(train_mixer(tokens, types))
    batched = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("batch"), "doc_id", "text").repartition(parts, "batch")
    told = figures(batched, tokens, mixer, parts, classes)
    live = np.flatnonzero(totals)
    new = min(max(once / n, 1e-6), 0.5) if n else 1.0
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"

    def total(own: pa.Table, found: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        seen, logs = [], []
        for blob, data, spelling in zip(*(found.column(c).to_pylist() for c in ("tokens", "counts", "spelling")), strict=True):
            kinds = blob.split(b"\n")
            index.update(zip(kinds, range(len(index), len(index) + len(kinds)), strict=True))
            wide = np.frombuffer(data, np.int64 if len(data) == 8 * classes * len(kinds) else np.int32).reshape(classes, -1).astype(float)
            c = wide.sum(axis=0)
            spelled = np.log(10) * np.frombuffer(spelling, np.float32).astype(float)
            seen.append(c)
            if len(live):
                share = (wide[live] + PRIOR * c / n) / (totals[live, None] + PRIOR)
                with np.errstate(divide="ignore"):
                    known = np.log((1 - new) * share)
                logs.append(np.logaddexp(known, np.log(new) + spelled).T / np.log(10))
            else:
                logs.append(spelled[:, None] / np.log(10))
        c, logs = np.concatenate(seen), np.concatenate(logs)
        base = np.log10(c + 1)
        prior = np.log10(totals[live] / n) if len(live) else np.zeros(1)
        out: list[np.ndarray] = []

        def score(at: list[int], lengths: list[int], sizes: list[int]) -> None:
            """Texts of these tokens, one after the other."""
            at, starts = np.array(at), np.cumsum([0, *lengths[:-1]])
            per = logs[at]
            place, hit, p = repeats(at, np.repeat(np.arange(len(lengths)), lengths))
            there = per[place] + np.log10(1 - p)[:, None]
            there[hit] = np.logaddexp(there[hit] * np.log(10), np.log(p[hit])[:, None]) / np.log(10)
            per[place] = there
            by = prior + np.add.reduceat(per, starts)
            top = by.max(axis=1)
            n_tokens, known = np.array(lengths), np.add.reduceat((c[at] > 0).astype(np.int64), starts)
            bases = np.add.reduceat(base[at], starts) - n_tokens * np.log10(n + types + 1)
            out.append(np.array([n_tokens, known, np.full(len(lengths), n), bases, top + np.log10((10 ** (by - top[:, None])).sum(axis=1)), sizes]))

        held, lengths, sizes = [], [], []
        for text in own.column("text").cast(pa.binary()).to_pylist():
            kinds = words(text)
            held += [index[t] for t in kinds]
            lengths.append(len(kinds))
            sizes.append(len(text or b""))
            if len(held) >= TOKENS:
                score(held, lengths, sizes)
                held, lengths, sizes = [], [], []
        if lengths:
            score(held, lengths, sizes)
        out = list(np.concatenate(out, axis=1)) if out else [np.zeros(0)] * 6
        return pa.Table.from_arrays(
            [own.column("doc_id").combine_chunks(), *(pa.array(x.astype(np.int64)) for x in out[:3]), pa.array(out[3]), pa.array(out[4]), pa.array(out[5].astype(np.int64))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    return batched.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(total, schema)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold != 2)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLE: dict[str, str] = {}
