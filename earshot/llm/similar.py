"""Near duplicates by the Jaccard similarity of sets of word shingles, proposed by SimHash.

1. Equal sets are one node, named by a 64-bit hash of the set.  A node carries a SimHash of
   ``WORDS`` words of 64 bits, since similarity 0.8 is a radius of 15 % of the bits.
2. As in ``simhash``, the fingerprint falls into blocks: nodes that agree in a block of 8 bits
   meet in its cell.  A pair of similarity 0.8 agrees in none of the 32 blocks with probability
   (1 - 0.8485**8)**32 = 5e-5, a pair within 31 bits never.  Cells above ``LARGE`` members
   are parted by further choices of bits, as many as keep that probability.
3. Inside a cell each component of near fingerprints has a reference, and the cell's distances
   to it are a column of the pivot table: by the triangle inequality a member of the component
   only meets what is as far from the reference as itself, give or take ``WIDE`` bits.
   ``WIDE``, ``REACH_TWO`` and ``REACH`` (for one word) are 4.4, five and five standard deviations above the
   distance expected at 0.8.  A cell yields a forest, never more links than members.
4. What is linked so is a group.  Its texts come together, in pairs of blocks of ``MOST``
   members where it is large, and true similarities decide: first of a spanning forest of the
   largest estimates, then of all pairs still apart that pivot rows, fingerprints and minima of hash functions over the shingles do not
   rule out (an estimate ``SLACK`` under the threshold is three and a half standard deviations
   below it).  Pairs are compared where they are listed; only forests of links leave a task.

Defined cases: sets are of lower-cased words parted by white space; null text is empty;
texts without words are equal; fewer words than a shingle give one shingle; repeated rows
are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_side, stage
from .components import components, local_roots, name_rows
from .tokens import shingle_hashes, slices_of, word_hashes

SEED, BANDS, ROWS, PIVOTS = 42, 32, 6, 16
MINIMA = BANDS * ROWS
REACH, SLACK = 24, 0.1
#: Words of a fingerprint; bits in which two may differ.
WORDS, WIDE = 4, 64
#: Bits in which the first two words may differ; members looked at side by side.
REACH_TWO, SIDE = 40, 64
#: Members of a cell compared directly, at most; bits of further choices leave about ``FEW`` together.
LARGE, FEW = 2048, 128
#: Links a task holds before it hands on their forest.
LINKS = 1 << 16
#: Members of a block of a large group, and bytes of its texts.
MOST, MOST_BYTES = 2048, 16 << 20
#: Members compared together for a forest; of what was linked before, one stands for all.
CHUNK = 2048
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, MINIMA, np.uint32)
_BANDS = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)
_WIDER = _RANDOM.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
PIVOT = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(PIVOTS)], np.uint64)


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Of every text the sorted distinct hashes of its shingles."""
    out: list[np.ndarray] = []
    for s, e in slices_of(texts):
        h, at = word_hashes(texts[s:e])
        cuts = np.searchsorted(at, np.arange(e - s + 1))
        runs = shingle_hashes(h, shingle)
        runs = (runs ^ runs >> np.uint64(32)) * _MIX
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > shingle:
                out.append(np.unique(runs[a : b - shingle + 1]))
            elif b > a:
                out.append(shingle_hashes(h[a:b], b - a) * _MIX)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_hash(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def simhash(own: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 65536):
        ones += np.unpackbits(own[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(own), bitorder="little").tobytes(), "little")


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, ((x[None, k : k + 1024] ^ _SHIFTS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Keys of ``ROWS`` minima each: places where sets may have met (``crossing``); they propose nothing here."""
    key = _BANDS.copy()
    for m in least.astype(np.uint64).reshape(ROWS, BANDS):
        key = (key ^ m) * _MIX
        key ^= key >> np.uint64(31)
    return key


#: Bytes of marks before the keys: pivot distances, minima.
_KEYS = PIVOTS + MINIMA


def wide(own: np.ndarray) -> bytes:
    """The SimHash of ``WORDS`` words; each sees the hashes mixed anew."""
    out = []
    for k in range(WORDS):
        x = own
        if k:
            x = (own ^ own >> np.uint64(31 - k)) * _WIDER[k]
            x ^= x >> np.uint64(32)
        out.append(simhash(x))
    return np.array(out, np.uint64).tobytes()


def marked(rows: DataFrame, shingle: int) -> DataFrame:
    """row, fp (the set's hash), wide (null for an empty set), bytes (of the text); ``rows``: row, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sets = shingle_sets(texts, shingle)
            fps = np.array([set_hash(s) for s in sets], np.uint64)
            wides = pa.array([wide(s) if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), wides, sizes], ["row", "fp", "wide", "bytes"])

    return rows.select("row", "text").mapInArrow(of, "row long, fp long, wide binary, bytes long")


def reached(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``WIDE`` bits; ``sims``: a row of words each.

    The first member of a tree is its reference; the others meet by their distances to it."""
    distance = lambda at, i: np.bitwise_count(sims[at] ^ sims[i]).sum(axis=1, dtype=np.int64)
    found: list[tuple[int, np.ndarray]] = []
    x, y = (np.ascontiguousarray(sims[:, k]) for k in range(2))
    alive = np.ones(len(sims), bool)
    for s in range(0, len(sims), SIDE):
        own, others = (np.flatnonzero(alive[s:e]) + s for e in (s + SIDE, len(sims)))
        bits = np.bitwise_count(x[own, None] ^ x[others]) + np.bitwise_count(y[own, None] ^ y[others])
        for i in own[(bits <= REACH_TWO).sum(axis=1) > 1].tolist():  # itself and another
            if not alive[i]:
                continue
            left = np.flatnonzero(alive[i + 1 :]) + i + 1
            far = distance(left, i)
            todo = [(i, left[far <= WIDE], far[far <= WIDE])]
            rest, far = left[far > WIDE], far[far > WIDE]
            while todo:
                from_, at, depth = todo.pop()
                if not len(at):
                    continue
                found.append((from_, at))
                alive[at] = False
                for z, d in zip(at.tolist(), depth.tolist(), strict=True):
                    ring = np.flatnonzero(np.abs(far - d) <= WIDE)
                    ring = ring[distance(rest[ring], z) <= WIDE]
                    if len(ring):
                        todo.append((z, rest[ring], far[ring]))
                        rest, far = np.delete(rest, ring), np.delete(far, ring)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(np.full(len(at), i) for i, at in found)]), np.concatenate([none, *(at for _, at in found)])


def cell_links(sims: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links with the components of the near pairs of a cell."""
    n = len(sims)
    if n <= LARGE:
        yield reached(sims)
        return
    more = max(1, int(np.ceil(np.log2(n / FEW))))
    choices, random = int(np.ceil(10 / 0.8485**more)), np.random.default_rng(more)
    for _ in range(choices):
        key = np.zeros(n, np.uint64)
        for bit in random.choice(64 * WORDS, more, replace=False).tolist():
            key = key << np.uint64(1) | sims[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(own) > 1:
                i, j = reached(sims[own])
                yield own[i], own[j]


def star_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = local_roots(*(np.concatenate([x[k] for x in held]) for k in range(2)))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def proposed(nodes: DataFrame, parts: int) -> DataFrame:
    """(u, v): links with the components of the nodes whose fingerprints share a block and are near."""
    width = 8 + 8 * WORDS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a batch the members of a cell in one row, so that rows do not outweigh fingerprints."""
        for b in batches:
            if not b.num_rows:
                continue
            sims = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            members = np.concatenate([b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), sims], axis=1)
            for block in range(sims.shape[1]):
                order = np.argsort(sims[:, block], kind="stable")
                cuts = np.flatnonzero(np.diff(sims[order, block])) + 1
                parts = np.split(members[order], cuts)
                names = block * 256 + sims[order[[0, *cuts.tolist()]], block].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([p.tobytes() for p in parts], pa.binary())], ["cell", "members"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cell, parted = [], 0, None, []

        def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            own = np.frombuffer(b"".join(parted), np.uint64).reshape(-1, width // 8)
            fps = own[:, 0].view(np.int64)
            for i, j in cell_links(own[:, 1:]):
                if len(i):
                    yield fps[i], fps[j]

        def stars(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for pair in done():
                held.append(pair)
                size += len(pair[0])
                if size >= LINKS:
                    yield star_batch(held)
                    held, size = [], 0
            if last and held:
                yield star_batch(held)

        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != cell and parted:
                    yield from stars(False)
                    parted = []
                cell = c
                parted.append(part)
        if parted:
            yield from stars(True)

    met = nodes.filter("wide is not null").select("fp", "wide").mapInArrow(cells, "cell int, members binary")
    met = met.repartition(parts, "cell").sortWithinPartitions("cell")
    return met.mapInArrow(links, "u long, v long")


class Members:
    """Nodes that are compared: names, components, fingerprints, pivot rows, bytes of minima, keys of
    places where they met before (none here)."""

    FIELDS = ("fp", "label", "sim", "far", "small", "keys")

    def __init__(self, fp, label, sim, marks):
        self.fp, self.label, self.sim = fp, label, sim
        self.far, self.small = marks[:, :PIVOTS].astype(np.int8), marks[:, PIVOTS:_KEYS]
        self.keys = np.ascontiguousarray(marks[:, _KEYS:]).view(np.uint32)

    @classmethod
    def _of(cls, fields) -> Members:
        out = object.__new__(cls)
        for name, x in zip(cls.FIELDS, fields, strict=True):
            setattr(out, name, x)
        return out

    def take(self, at: np.ndarray) -> Members:
        return self._of(getattr(self, name)[at] for name in self.FIELDS)

    def join(self, other: Members) -> Members:
        return self._of(np.concatenate([getattr(self, name), getattr(other, name)]) for name in self.FIELDS)

    def near(self, i: int, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of ``others`` those that may be as similar to ``i``, and the estimates."""
        at = others[np.abs(self.far[others] - self.far[i]).max(axis=1, initial=0) <= REACH]
        at = at[np.bitwise_count(self.sim[at] ^ self.sim[i]) <= REACH]
        share = (self.small[at] == self.small[i]).mean(axis=1) if len(at) else np.zeros(0)
        value = (share * 256 - 1) / 255
        return at[value >= least], value[value >= least]


def forest(m: Members, least: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of the largest estimates between different labels, and
    one member for each of its trees: the one with the most edges."""
    n = len(m.fp)
    best, by = np.full(n, -1.0), np.zeros(n, np.int64)
    degree, left, edges, stands, tree = np.zeros(n, np.int64), np.ones(n, bool), [], [], []
    of = np.unique(m.label, return_inverse=True)[1]
    while left.any():
        at = np.flatnonzero(left)
        i = int(at[np.argmax(best[at])])
        if best[i] < 0:
            if tree:
                stands.append(max(tree, key=lambda x: degree[x]))
            tree, i = [], int(at[0])
        elif best[i] < 2:
            edges.append((int(by[i]), i))
            degree[[i, by[i]]] += 1
        left[i] = False
        tree.append(i)
        same = np.flatnonzero(left & (of == of[i]))
        best[same] = 2.0  # linked before
        at, value = m.near(i, np.flatnonzero(left & (best < 2)), least)
        more = value > best[at]
        best[at[more]], by[at[more]] = value[more], i
    if tree:
        stands.append(max(tree, key=lambda x: degree[x]))
    return edges, np.array(stands, np.int64)


def crossing(m: Members, least: float, place: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(member, others): pairs between different labels that may be similar.  Members of the largest
    label are only compared with the rest, never among themselves.

    Given the ``place`` of the band, all pairs that share no band before it; without, of every member
    compared the best partner in each other label."""
    names, of, sizes = np.unique(m.label, return_inverse=True, return_counts=True)
    largest = of == int(np.argmax(sizes)) if len(names) else np.zeros(0, bool)
    order = np.concatenate([np.flatnonzero(~largest), np.flatnonzero(largest)])
    m, of = m.take(order), of[order]
    for i in range(int((~largest).sum())):
        later = np.arange(i + 1, len(order))
        at, value = m.near(i, later[of[later] != of[i]], least)
        if place is None:
            best = at[np.argsort(-value, kind="stable")]
            at = best[np.unique(of[best], return_index=True)[1]]
        elif len(at):
            at = at[~(m.keys[at, :place] == m.keys[i, :place]).any(axis=1)]
        if len(at):
            yield int(order[i]), order[at]


class Roots:
    """Components of members by their numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def labels(self) -> np.ndarray:
        return np.array([self.of(i) for i in range(len(self.up))], np.int64)


def marks_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one word, and marks."""
    sims = np.array([simhash(s) for s in sets], np.uint64)
    far = np.bitwise_count(sims[:, None] ^ PIVOT[None, :]).astype(np.uint8)
    small = [((minima(s) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8) for s in sets]
    return sims, np.concatenate([far, np.stack(small)], axis=1)


def true_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at least as similar."""
    roots, found = Roots(len(sets)), []

    def check(pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            x, y = roots.of(i), roots.of(j)
            if x == y:
                continue
            both = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if common >= similarity * (len(both) - common) - 1e-9:
                roots.up[max(x, y)] = min(x, y)
                found.append((i, j))

    n, least = len(sets), similarity - SLACK
    if n == 2:
        check(iter([(0, 1)]))
        return found
    sims, marks = marks_of(sets)
    members = lambda: Members(np.arange(n), roots.labels(), sims, marks)
    m = members()
    kept = np.arange(min(n, CHUNK))
    for k in range(CHUNK, n + CHUNK, CHUNK):
        own = m.take(kept)
        edges, stands = forest(own, least)
        check((int(kept[i]), int(kept[j])) for i, j in edges)
        kept = np.concatenate([kept[stands], np.arange(k, min(n, k + CHUNK))])
    check((i, j) for i, others in crossing(members(), least, 0) for j in others.tolist())
    return found


def verified(groups: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links with the components of all pairs at least as similar of the nodes of a group;
    ``groups``: node, label."""
    spark = nodes.sparkSession
    placed = stage(groups.join(nodes, F.col("node") == F.col("fp")).select("label", "fp", F.col("row").alias("r2"), "bytes"), "similar-placed")
    sizes = placed.groupBy(F.col("label").alias("l2")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / MOST, F.col("bytes") / MOST_BYTES)).cast("int")
    large = small_side(stage(sizes.select("l2", blocks.alias("blocks")).filter("blocks > 1"), "similar-large"))
    x = F.pmod("fp", "blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != x)
    pairs = F.transform(others, lambda y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))
    alone = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    texts = rows.join(small_side(placed.drop("bytes")), F.col("row") == F.col("r2")).join(large, F.col("label") == F.col("l2"), "left")
    texts = texts.select("label", F.explode(F.coalesce(pairs, alone)).alias("pair"), "fp", "text")
    met = texts.select("label", "pair.x", "pair.y", "fp", "text").repartition(partitions(spark, rows), "label", "x", "y").sortWithinPartitions("label", "x", "y", "fp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name, fps, sets = [], 0, None, [], []

        def stars(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if len(sets) > 1:
                at = np.array(true_links(sets, similarity), np.int64).reshape(-1, 2)
                own = np.array(fps, np.int64)
                held.append((own[at[:, 0]], own[at[:, 1]]))
                size += len(at)
            if held and (last or size >= LINKS):
                yield star_batch(held)
                held, size = [], 0

        for b in batches:
            new = shingle_sets(b.column(4).cast(pa.binary()).to_pylist(), shingle)
            names = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            for key, fp, s in zip(names, b.column(3).to_pylist(), new, strict=True):
                if key != name:
                    yield from stars(False)
                    name, fps, sets = key, [], []
                fps.append(fp)
                sets.append(s)
        yield from stars(True)

    return met.mapInArrow(links, "u long, v long")


def similar_rows(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row, fp, component_id (the least row of the component); ``rows``: row, text, to be
    read more than once."""
    found = stage(marked(rows, shingle), "similar")
    nodes = found.groupBy("fp").agg(F.min(F.struct("row", "wide", "bytes")).alias("x"), F.count(F.lit(1)).alias("n"))
    nodes = stage(nodes.select("fp", "n", "x.*", F.col("x.row").alias("least")), "similar-nodes")
    near = stage(proposed(nodes, partitions(rows.sparkSession, rows)), "similar-near")  # it is read twice
    groups = components(near)
    links = stage(verified(groups, nodes, rows, shingle, similarity), "similar-links")
    return name_rows(found.select("row", "fp"), nodes.select("fp", "n", "least"), components(links))
