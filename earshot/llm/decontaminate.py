"""Benchmark decontamination by greedy string tiling.

Texts are token sequences (``tokens.token_hashes``).  Runs of ``SEED`` tokens shared by
a document and a benchmark item are joined through their Karp-Rabin hashes.  For each
pair met so, the longest run of tokens unmarked on both sides is marked as a tile, until
no run of ``SEED`` tokens is left.  Tiles may stand in any order, so reordered passages
count in full.  A document is contaminated by an item when tiles cover at least
``COVERAGE`` of the item's tokens.

How it scales: a bitmap of the benchmark's seeds (fixed size, the only broadcast) lets
through the documents' runs that may be seeds, with few others as long as the benchmark
has fewer seeds than bits; beyond that more rows are joined, with the same result.  What
passes is joined with the seeds by hash.  A pair goes on only if enough places of the
item are met for the coverage (each tile of n tokens holds n - SEED + 1 of them, so that
many at least), and only then do its two texts meet.  Texts are told apart by a 128-bit
hash, so copies are tiled once.  Tiling takes memory in proportion to both texts.

Defined cases: null and empty texts match nothing; items with fewer than ``SEED``
tokens can't be tiled and match nothing; equal longest matches are taken in the
order of the item, then of the document; repeated rows are each reported, repeated
items each by their id; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import shingle_hashes, slices_of, token_hashes

SEED, COVERAGE = 5, 0.8
#: Bits of the bitmap of seeds (8 MB), and of one of its rows.
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15
_BASE = 0x9E3779B97F4A7C15


class Runs:
    """Karp-Rabin hashes of the runs of a token sequence, for any length."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, _BASE, np.uint64), out=self.power[1:])
        # Sums of tokens times powers; runs compare after a shift to equal powers.
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.power[:n], out=self.sums[1:])
        self.n = n
        self.marked = np.zeros(n + 1, np.int64)

    def mark(self, start: int, length: int) -> None:
        more = np.zeros(self.n + 1, np.int64)
        more[start + 1 : start + length + 1] = np.arange(1, length + 1)
        more[start + length + 1 :] = length
        self.marked += more

    def free(self, length: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked runs of a length, and their hashes (as if all began at
        the power ``last``)."""
        at = np.arange(self.n - length + 1)
        at = at[self.marked[at + length] == self.marked[at]]
        return at, (self.sums[at + length] - self.sums[at]) * self.power_at(last - at)

    def power_at(self, k: np.ndarray) -> np.ndarray:
        if len(k) and k.max() >= len(self.power):
            self.power = np.ones(int(k.max()) + 1, np.uint64)
            np.multiply.accumulate(np.full(len(self.power) - 1, _BASE, np.uint64), out=self.power[1:])
        return self.power[k]


def tiles(a: np.ndarray, b: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of two token sequences."""
    x, y, out = Runs(a), Runs(b), []
    last = max(len(a), len(b))

    def first(length: int) -> tuple[int, int] | None:
        """The first unmarked run of a that is one of b, and the first such of b."""
        if length > min(len(a), len(b)):
            return None
        (i, h), (j, g) = x.free(length, last), y.free(length, last)
        found = np.flatnonzero(np.isin(h, g))
        for k in found.tolist():
            for m in np.flatnonzero(g == h[k]).tolist():
                if np.array_equal(a[i[k] : i[k] + length], b[j[m] : j[m] + length]):
                    return int(i[k]), int(j[m])
        return None

    most = min(len(a), len(b))
    while True:
        low, high = seed - 1, most  # runs of low tokens match (or low < seed), of more than high don't
        place = None
        while low < high:
            middle = (low + high + 1) // 2
            met = first(middle)
            if met:
                low, place = middle, met
            else:
                high = middle - 1
        if low < seed:
            return out
        # Further tiles of this length need no search for it.
        while place:
            out.append((*place, low))
            x.mark(place[0], low)
            y.mark(place[1], low)
            place = first(low)
        most = low - 1
        if most < seed:
            return out


HIT = "struct<item_id:bigint,n_tiles:bigint,covered:bigint,item_tokens:bigint,coverage:double>"


def text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def _seeds(texts: DataFrame, seed: int, bitmap=None) -> DataFrame:
    """(k1, k2, seed, place): runs of tokens of rows (k1, k2, text), with their places
    without a bitmap, else once each and only those it may hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            keys = [c.to_numpy() for c in b.columns[:2]]
            for s, e in slices_of(texts):
                h, at = token_hashes(texts[s:e])
                run = shingle_hashes(h, seed)
                pos = np.flatnonzero(at[: len(run)] == at[seed - 1 :]) if len(run) else np.zeros(0, np.int64)
                run, owner = run[pos], at[pos]
                place = pos - np.searchsorted(at, owner)
                if bitmap is not None:
                    bit = (run >> np.uint64(38)).astype(np.int64)
                    here = np.flatnonzero(bitmap.value[bit >> 3] >> (bit & 7) & 1)
                    if len(here):
                        here = here[np.unique(np.stack([owner[here].astype(np.uint64), run[here]]), axis=1, return_index=True)[1]]
                    run, owner, place = run[here], owner[here], place[here]
                if len(run):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][s:e][owner]), pa.array(keys[1][s:e][owner]), pa.array(run.view(np.int64)), pa.array(place.astype(np.int64))], ["k1", "k2", "seed", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(work, "k1 long, k2 long, seed long, place long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """MAP_BITS bits, set by the upper bits of the seeds; of a fixed size."""
    bit = F.shiftrightunsigned("seed", 38)
    rows = seeds.select(F.floor(bit / ROW_BITS).alias("k"), F.pmod(bit, F.lit(ROW_BITS)).alias("bit"))
    out = np.zeros((MAP_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.k] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def contaminating(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(k1, k2, hits): the texts, by the hashes of ``text_key``, that items contaminate."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    kinds = items.select(*text_key(), "text").dropDuplicates(["k1", "k2"])
    places = stage(_seeds(kinds, seed).select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "seed", "place"), "tiling-seeds")
    sent = spark.sparkContext.broadcast(_bitmap(places))
    texts = docs.select(*text_key(), "text")
    met = _seeds(texts, seed, sent).select("k1", "k2", "seed").join(places, "seed")
    sizes = places.groupBy("i1", "i2").agg((F.max("place") + seed).alias("tokens"))
    pairs = met.groupBy("k1", "k2", "i1", "i2").agg(F.countDistinct("place").alias("n")).join(sizes, ["i1", "i2"])
    pairs = stage(pairs.filter(F.col("n") * seed >= F.col("tokens") * coverage).select("k1", "k2", "i1", "i2"), "tiling-pairs")
    wanted = pairs.select("k1", "k2").distinct()
    own = texts.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    both = pairs.join(own, ["k1", "k2"]).join(kinds.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("text").alias("item")), ["i1", "i2"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                x, y = token_hashes([item])[0], token_hashes([doc])[0]
                found = tiles(x, near_seeds(x, y, seed), seed)
                rows.append((len(found), sum(t[2] for t in found), len(x)))
            n = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(n[:, k]) for k in range(3))], ["k1", "k2", "i1", "i2", "n_tiles", "covered", "item_tokens"])

    tiled = both.select("k1", "k2", "i1", "i2", "text", "item").mapInArrow(tile, "k1 long, k2 long, i1 long, i2 long, n_tiles long, covered long, item_tokens long")
    named = tiled.filter(F.col("covered") >= F.col("item_tokens") * coverage).join(items.select(*[c.alias(n) for c, n in zip(text_key(), ("i1", "i2"), strict=True)], "item_id"), ["i1", "i2"])
    hit = F.struct("item_id", "n_tiles", "covered", "item_tokens", (F.col("covered") / F.col("item_tokens")).alias("coverage"))
    return named.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def near_seeds(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The tokens of ``b`` that lie in some seed of ``a``; a token of no text stands for
    each stretch of others, so that no run crosses it."""
    run = shingle_hashes(b, seed)
    at = np.flatnonzero(np.isin(run, shingle_hashes(a, seed)))
    inside = np.zeros(len(b) + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + seed, -1)
    keep = np.cumsum(inside[:-1]) > 0
    # Touching seeds may come from places apart only where tokens go on, as in the text.
    edge = np.flatnonzero(~keep[:-1] & keep[1:]) if len(b) else np.zeros(0, np.int64)
    kept = keep.copy()
    kept[edge] = True
    out = b.copy()
    out[edge] = 0
    return out[kept]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, the columns named by ``keep``, hits: the items that contaminate the
    document, by item_id."""
    found = stage(contaminating(docs, benchmark, seed, coverage).select(F.col("k1").alias("_h1"), F.col("k2").alias("_h2"), F.col("hits").alias("_hits")), "tiling-hits")
    keyed = docs.select("doc_id", *keep, *[c.alias(f"_{n}") for c, n in zip(text_key(), ("k1", "k2"), strict=True)])
    met = keyed.join(found, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
    return met.select("doc_id", *keep, F.coalesce("_hits", F.array().cast(f"array<{HIT}>")).alias("hits"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that contaminates it."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE: dict[str, str] = {}
