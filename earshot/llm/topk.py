"""Exact top-k inner products over a bit-sliced index.

Components become integers ``floor(SCALE * x)``.  The index holds, for blocks of
rows in id order, one bitmap for each binary digit of each component (less the
block's least value).  A query adds the slices: the digits of its own components
say which slices to add at which place, negative components add complements, and
carry-save adders (exclusive-or and majority over whole bitmaps) sum them into the
slices of the scores.  The top rows are then selected from the most significant
score slice downward; rows still tied after the last slice are the boundary and are
resolved by id.  No score is computed row by row.

All rows are indexed.  Queries meet the index in cells of up to ``SIDE`` by ``SIDE``
blocks, so a block is sent once for ``SIDE`` of those it meets.  A cell holds its queries,
builds the slices of each of its row blocks once and keeps the k best rows a query.

Defined cases: vectors that are null or hold null, NaN or infinite components, and
rows with a null id, take no part; shorter vectors count as padded with zeros; rows
that share an id are each indexed and each a query, and only a query's own row is no
candidate; fewer than k candidates give all; ties go to the smaller id; sums must fit
a signed long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stage, table

SCALE, K, EVERY = 64, 20, 20
ROWS, QUERIES_A_BLOCK = 8192, 1024
#: Blocks of rows, and of queries, in a cell, at most.
SIDE = 16


class Slices:
    """Bitmaps of one block of integer vectors, ordered by id, then row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, x = ids[order], rows[order], x[order]
        self.low = x.min(axis=0) if x.size else np.zeros(x.shape[1], np.int64)
        x = (x - self.low).astype(np.uint64)
        self.digits = max(1, int(x.max(initial=0)).bit_length())
        self.words = -(-len(ids) // 64)
        bits = np.zeros((x.shape[1], self.digits, self.words * 64), np.uint8)
        for b in range(self.digits):
            bits[:, b, : len(ids)] = (x >> np.uint64(b) & np.uint64(1)).T
        plain = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        #: As stored and complemented.
        self.both = np.stack([plain, ~plain])
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices, least significant first, and what to add to their number."""
        size, sign = np.abs(q).astype(np.uint64), (q < 0).astype(np.int64)
        top = (1 << self.digits) - 1
        # |q| * (top - x) - |q| * top for negative components
        offset = int((q * self.low).sum()) - int(size[sign == 1].sum()) * top
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero(size >> np.uint64(j) & np.uint64(1))
            if len(at):
                rows = self.both[sign[at], at]
                for b in range(self.digits):
                    columns.setdefault(j + b, []).append(rows[:, b])
        out: list[np.ndarray] = []
        w = 0
        while any(k >= w for k in columns):
            col = columns.pop(w, [])
            rows = np.concatenate(col) if col else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(rows) > 2:
                m = len(rows) // 3
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                ab = a ^ b
                carries.append(a & b | c & ab)
                rows = np.concatenate([ab ^ c, rows[3 * m :]])
            if len(rows) == 2:
                carries.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
            if carries:
                columns.setdefault(w + 1, []).extend(carries)
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            w += 1
        return out, offset

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, rows and scores of the k best rows but the row ``own``."""
        slices, offset = self.scores(q)
        tied, sure = self.valid.copy(), np.zeros(self.words, np.uint64)
        for at in np.flatnonzero(self.rows == own).tolist():
            tied[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        for s in reversed(slices):
            more = sure | tied & s
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied &= s
            else:
                sure, tied = more, tied & ~s
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        rows = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, tied)]
        chosen = np.concatenate([rows[0], rows[1][: k - len(rows[0])]])
        score = np.full(len(chosen), offset, np.int64)
        for w, s in enumerate(slices):
            score += ((s[chosen >> 6] >> (chosen & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        return self.ids[chosen], self.rows[chosen], score


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, q): the integer vector of each row that takes part; to be staged
    before it is read twice, as ``row`` is given here."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = vectors.filter("vec_id is not null and embedding is not null").filter(~F.coalesce(bad, F.lit(True)))
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return fit.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _pack(kind: int):
    """One record a block: its rows, ids and vectors as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            for block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for column, v in zip(held.setdefault(block, ([], [], [])), row, strict=True):
                    column.append(v)
        for block, (rows, ids, xs) in held.items():
            width = max(map(len, xs))
            x = np.zeros((len(ids), width), np.int64)
            for row, v in zip(x, xs, strict=True):
                row[: len(v)] = v
            small = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64
            values = (block, kind, width, np.dtype(small).itemsize, np.array(rows, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), x.astype(small).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], BLOB.replace("long", "").replace("binary", "").replace(" ", "").split(","))

    return pack


BLOB = "block long, kind long, width long, bytes long, rows binary, ids binary, data binary"
#: Kinds of blocks; queries come first in a cell.
ASK, ROW = 0, 1


def _blocks(rows: DataFrame, kind: int, n: int) -> DataFrame:
    keyed = rows.select(F.pmod(F.xxhash64("row"), F.lit(n)).alias("block"), "row", "vec_id", "q")
    return keyed.repartition(min(n, 4 * partitions(rows.sparkSession)), "block").mapInArrow(_pack(kind), BLOB)


def _unpack(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(x["ids"], np.int64)
    data = np.frombuffer(x["data"], np.int16 if x["bytes"] == 2 else np.int64)
    return ids, np.frombuffer(x["rows"], np.int64), data.reshape(len(ids), x["width"]).astype(np.int64)


class Best:
    """The k best rows seen so far of each query of some blocks."""

    def __init__(self, k: int):
        self.k, self.asks = k, []

    def ask(self, ids: np.ndarray, rows: np.ndarray, qs: np.ndarray) -> None:
        nothing = (np.zeros(0, np.int64),) * 3
        self.asks += [[i, r, q, nothing] for i, r, q in zip(ids.tolist(), rows.tolist(), qs, strict=True)]

    def meet(self, slices: Slices) -> None:
        width = slices.both.shape[1]
        for ask in self.asks:
            q = np.zeros(width, np.int64)
            q[: min(width, len(ask[2]))] = ask[2][:width]
            ids, rows, scores = (np.concatenate(x) for x in zip(ask[3], slices.top(q, ask[1], self.k), strict=True))
            best = np.lexsort((rows, ids, -scores))[: self.k]
            ask[3] = ids[best], rows[best], scores[best]

    def found(self) -> pa.RecordBatch:
        sizes = [len(a[3][0]) for a in self.asks]
        keys = [np.repeat(np.array([a[i] for a in self.asks], np.int64), sizes) for i in (0, 1)]
        values = [np.concatenate([np.zeros(0, np.int64), *(a[3][i] for a in self.asks)]) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *values)], ["query_id", "query_row", "vec_id", "row", "score"])


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs are rows of one ``quantised`` table."""
    spark = index.sparkSession
    n_rows, n_queries = index.count(), queries.count()
    nb, nq = -(-max(n_rows, 1) // ROWS), -(-max(n_queries, 1) // QUERIES_A_BLOCK)
    side, want = SIDE, 2 * partitions(spark)
    while side > 1 and -(-nb // side) * -(-nq // side) < want:
        side //= 2
    down, across = -(-nb // side), -(-nq // side)
    at = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    in_cell = lambda n: F.pmod(F.col("block"), F.lit(n)).cast("int")
    asks = _blocks(queries, ASK, nq).select("*", in_cell(across).alias("qc"), at(down, "rc"))
    rows = _blocks(index, ROW, nb).select("*", in_cell(down).alias("rc"), at(across, "qc"))
    cells = asks.unionByName(rows).repartition(max(partitions(spark), min(down * across, 1 << 14)), "rc", "qc").sortWithinPartitions("rc", "qc", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best = None, Best(k)
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                if (x["rc"], x["qc"]) != cell:
                    yield best.found()
                    cell, best = (x["rc"], x["qc"]), Best(k)
                if x["kind"] == ASK:
                    best.ask(*_unpack(x))
                else:
                    best.meet(Slices(*_unpack(x)))
        yield best.found()

    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    found = cells.mapInArrow(search, "query_id long, query_row long, vec_id long, row long, score long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stage(quantised(table(spark, sf_dir, "embeddings")), "topk")
    return top_k(index, index.filter(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op10_topk": op10_topk}
ORACLE = {"op10_topk": SQL}
