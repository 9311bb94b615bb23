"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles.  Fingerprints within ``RADIUS`` differing bits are linked and a
document's component is the least id reachable.

Finding links, over distinct fingerprints only:

1. The 64 bits fall into blocks of which, within the radius, some must agree; a
   fingerprint meets others under each choice of agreeing blocks.  The number of
   blocks follows the number of fingerprints, so that groups stay small and the work
   grows with the input; no choice loses a pair.
2. Each fingerprint's Hamming distances to the reference fingerprints (``PIVOT``) form its
   row of the pivot table.  By the triangle inequality a pair whose rows differ by
   more than the radius in any coordinate is discarded; survivors are verified.
3. A group above ``LARGE`` members is not compared pairwise: two fingerprints are
   within 4 bits exactly if they share a point within 2 bits of both, so members meet
   at those points, which costs a fixed number of points a member.
4. Verified pairs leave a task as a star for each of its components; the stars of
   all tasks are joined by ``components``.

A pivot table alone compares all pairs (its pruning is a factor, not an order), hence
step 1.  Equal fingerprints need no pairs: they are one node.

Defined cases: null text is empty; no word gives fingerprint 0, linked like any
other; fewer words than a shingle give one shingle; repeated rows each give their row;
null ids never name a component that has an id; an empty table gives no rows.

Where a similarity is asked for instead of a radius (the pipeline), see ``similar``: the
same fingerprints and pivot tables at a wider radius, then true similarities.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, partitions, stage, table
from .components import components, local_roots, name_rows
from .similar import PIVOT

SHINGLE, SEED, RADIUS, LARGE = 4, 42, 4, 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    h = xxhash.xxh64_digest
    digests = b"".join([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(raw[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns named by ``keep``, fp (the 64 bits as a signed long)."""
    fields = docs.select("doc_id", *keep).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns - 1
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(k).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(fps.view(np.int64))], [*fields.names, "fp"])

    return docs.select("doc_id", *keep, F.col("text").alias("_text")).mapInArrow(of, extended(fields, "fp long"))


def blocks_for(n: int) -> tuple[int, int]:
    """Blocks, and how many of them agree within the radius, for ``n`` fingerprints."""
    for agree in range(2, 12):
        blocks = RADIUS + agree
        if 2 ** (64 * agree // blocks) >= n // 4:
            return blocks, agree
    return RADIUS + 12, 12


def _masks(blocks: int, agree: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), agree)]


def near_pairs(fps: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among rows of equal ``group`` (sorted by it)."""
    pivot = np.bitwise_count(fps[:, None] ^ PIVOT[None, :]).astype(np.int8)
    at, d = np.arange(len(fps)), 0
    while len(at):
        d += 1
        at = at[at + d < len(fps)]
        at = at[group[at] == group[at + d]]
        for k in range(0, len(at), 1 << 20):
            i = at[k : k + (1 << 20)]
            i = i[(np.abs(pivot[i] - pivot[i + d]) <= RADIUS).all(axis=1)]
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= RADIUS]
            if len(i):
                yield i, i + d


def meeting_pairs(fps: np.ndarray, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links with the components of the pairs within four bits, which differ only in
    the bits of ``free``: members meet at the points within two bits of them."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    ball = np.array([0, *bits, *(a | b for a, b in combinations(bits, 2))], np.uint64)
    parts = max(1, len(fps) * len(ball) >> 23)
    step = max(1, (1 << 22) // len(ball))
    for part in range(parts):
        points, owners = [], []
        for k in range(0, len(fps), step):
            p = (fps[k : k + step, None] ^ ball[None, :]).ravel()
            own = np.repeat(np.arange(k, min(k + step, len(fps))), len(ball))
            if parts > 1:
                here = (p * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part
                p, own = p[here], own[here]
            points.append(p)
            owners.append(own)
        p, own = np.concatenate(points), np.concatenate(owners)
        order = np.argsort(p, kind="stable")
        p, own = p[order], own[order]
        same = np.flatnonzero(p[1:] == p[:-1])
        if len(same):
            yield own[same], own[same + 1]


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links with the components of all pairs within the radius; ``distinct``: fp."""
    n = distinct.count()
    masks = _masks(*blocks_for(n))
    pos = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in pos])).alias("choice", "bits")
    )
    keyed = keyed.repartition(partitions(distinct.sparkSession, keyed), "choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        u, v = local_roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def work(fps: np.ndarray, choice: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
        group = np.cumsum(change) - 1
        size = np.bincount(group)[group]
        found = []
        small = np.flatnonzero((size > 1) & (size <= LARGE))
        found += [(fps[small][i], fps[small][j]) for i, j in near_pairs(fps[small], group[small])] if len(small) else []
        for g in np.unique(group[size > LARGE]):
            own = np.flatnonzero(group == g)
            free = ((1 << 64) - 1) ^ masks[int(choice[own[0]])]
            for i, j in meeting_pairs(fps[own], free):
                yield stars(fps[own][i], fps[own][j])
        if found:
            yield stars(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()))
            if sum(len(x[0]) for x in held) < 1 << 18:
                continue
            fps, choice, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield from work(fps[:cut], choice[:cut], bits[:cut])
            held = [(fps[cut:], choice[cut:], bits[cut:])]
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keyed.mapInArrow(pairs, "u long, v long")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns named by ``keep``, fp, component_id for every row."""
    marked = stage(fingerprints(docs, keep, shingle), "simhash")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    return name_rows(marked, nodes, components(links(nodes.select("fp"))))


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
