"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte is removed when a string of ``WINDOW`` bytes that covers it also starts
earlier: in a document before (by id, then text hash), or in the same document at an
earlier byte.  Strings are judged on the input and never cross documents.

How it scales:

1. Anchors.  Every window of ``WINDOW`` bytes has one anchor, its leftmost least
   hashed run of ``GRAM`` bytes; equal windows have equal anchors at equal places.
   The windows of one anchor form a segment of up to ``2 * WINDOW - GRAM`` bytes, and
   there is about one anchor for 35 bytes, so the suffixes to index are sparse.
2. Equal segments (128 bits of hash) are repeats as a whole.  A task settles those
   among its own documents; the rest meet by anchor and all but the first go.
3. What is left of anchors that still have several segments (the borders of copied
   passages) goes by anchor to the index family: the windows of an arriving batch get a
   suffix array, which is merge-scanned against every level for matches of
   ``WINDOW`` bytes; of two equal windows the later is reported and the earlier
   kept.  What is new becomes a level, and levels of like size merge, so a partition
   holds a logarithmic number of sorted arrays.
4. An anchor that more than ``HOT_SHARE`` of documents hold (found in a sample of about
   ``HOT_SAMPLE`` documents, which decides routes but no result) would gather in one
   place; its windows are dealt one by one by their own 128-bit hash instead, after a
   task has merged its equal ones.

Defined cases: null and empty texts keep nothing and remove nothing; texts shorter
than a window are kept; repeated rows (equal id and text) are one document and
give equal rows; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, stage, table

WINDOW, GRAM = 100, 32
SPREAD = WINDOW - GRAM  # an anchor starts 0 to SPREAD bytes after its window
HOT_SHARE, HOT_SAMPLE = 0.004, 4000
PIECE = 1 << 19
#: Index families a task works through one after the other.
TURNS = 8
#: Anchors a task settles together.
ROWS_HELD = 400_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _M3
    h ^= h >> np.uint64(32)
    return h


def _pair(h: np.ndarray, d: int) -> np.ndarray:
    return _mix(h[:-d] * _M1 + h[d:] * _M2) if len(h) > d else h[:0]


def gram_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of 32 and of 64 bytes."""
    u = x.astype(np.uint64)
    u = u[:-1] << np.uint64(8) | u[1:]
    u = u[:-2] << np.uint64(16) | u[2:]
    u = u[:-4] << np.uint64(32) | u[4:]
    h = _pair(_pair(_mix(u + _M1), 8), 16)
    return h, _pair(h, 32)


def anchors(h: np.ndarray) -> np.ndarray:
    """Of every window, the place of its leftmost least hash among SPREAD + 1."""
    v, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width * 2 <= SPREAD + 1:
        right = v[width:] < v[:-width]
        v, at = np.where(right, v[width:], v[:-width]), np.where(right, at[width:], at[:-width])
        width *= 2
    d = SPREAD + 1 - width
    return np.where(v[d:] < v[: len(v) - d], at[d:], at[: len(at) - d])


def segments(x: np.ndarray, ends: np.ndarray):
    """Segments of a buffer of texts that end at ``ends``: first window, number of
    windows, anchor, anchor hash, segment hash."""
    if len(x) < WINDOW:
        return None
    h32, h64 = gram_hashes(x)
    at = anchors(h32)
    valid = np.zeros(len(x) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    long_ = ends - starts >= WINDOW
    np.add.at(valid, starts[long_], 1)
    np.add.at(valid, ends[long_] - WINDOW + 1, -1)
    ok = np.cumsum(valid[: len(at)]) > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    # A text that ends just where the next begins leaves windows between, so runs part.
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    keep = ok[first]
    first, n = first[keep], n[keep]
    size = n + WINDOW - 1
    sh = _mix(h64[first] * _M1 + h64[first + (size - 64) // 2] * _M2 + size.astype(np.uint64))
    sh = _mix(sh + h64[first + size - 64] * _M1)
    return first, n, at[first], h32[at[first]], sh


def window_hashes(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the segments: start and 64-bit hash."""
    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    _, h64 = gram_hashes(x)
    return start, _mix(h64[start] * _M1 + h64[start + WINDOW - 64] * _M2)


class Docs:
    """A slice of a batch: its bytes and its documents' places in order."""

    def __init__(self, ids: list, fps: list, texts: list, base: list):
        self.x = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        self.ids, self.fps, self.base = np.array(ids, np.int64), np.array(fps, np.int64), np.array(base, np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def pieces(ids: list, fps: list, texts: list) -> Iterator[Docs]:
    """Slices of about PIECE bytes; longer texts in pieces that share WINDOW - 1 bytes."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for i, f, t in zip(ids, fps, texts, strict=True):
        for a in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[a : a + PIECE + WINDOW - 1] if len(t) > PIECE else t
            for column, v in zip(held, (i, f, part, a), strict=True):
                column.append(v)
            size += len(part)
            if size >= PIECE:
                yield Docs(*held)
                held, size = ([], [], [], []), 0
    if held[0]:
        yield Docs(*held)


FIELDS = ("kh", "sh", "ids", "fps", "lo", "n", "off")


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by all keys, and where runs of the first two begin in that order."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new, np.cumsum(new) - 1


def _same_place(ids, fps, lo, order, first):
    """Rows that are the very place of their run's first row (repeated input rows)."""
    f = order[first]
    return (ids[order] == ids[f]) & (fps[order] == fps[f]) & (lo[order] == lo[f])


def settle(kh, sh, ids, fps, lo):
    """Of equal (kh, sh): the sorted order, which rows are later repeats, which are firsts."""
    order, new, run = _first_of(kh, sh, ids, fps, lo)
    first = np.flatnonzero(new)[run]
    return order, ~_same_place(ids, fps, lo, order, first), new


def _blob(part: int, kind: int, columns: dict) -> tuple:
    return part, kind, *(columns[k].tobytes() for k in FIELDS)


BLOB = "part long, kind long, " + ", ".join(f"{k} binary" for k in FIELDS)
TYPES = {"kh": np.uint64, "sh": np.uint64, "ids": np.int64, "fps": np.int64, "lo": np.int64, "n": np.int32, "off": np.int32}
#: Kinds of blobs: segments by anchor, windows of hot anchors by their hash, repeats settled.
SEGMENT, HOT, SETTLED = 0, 1, 2


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "kind", *FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names)


def _texts(b: pa.RecordBatch) -> tuple[list, list, list]:
    return b.column("rid").to_pylist(), b.column("fp").to_pylist(), [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[Docs]:
    """The batch's documents, a few hundred at a time."""
    for i in range(0, b.num_rows, rows):
        yield from pieces(*_texts(b.slice(i, rows)))


def places(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of an array of lists of structs: the offsets, and each field's values together."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
    return offsets, [np.asarray(f) for f in column.flatten().flatten()]


def hot_anchors(docs: DataFrame, total: int) -> np.ndarray:
    """Anchor hashes that many sampled documents hold; at most 100 / HOT_SHARE or so."""
    mod = max(1, total // HOT_SAMPLE)
    sample = docs.filter(F.pmod("fp", F.lit(mod)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in slices(b):
                s = segments(d.x, d.ends)
                if s is not None and len(s[0]):
                    once = np.unique(np.stack([s[3], d.owner(s[0]).astype(np.uint64)]), axis=1)[0]
                    kh, n = np.unique(once, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64)), pa.array(n)], ["kh", "n"])

    least = max(8, int(HOT_SHARE * min(total, HOT_SAMPLE)))
    rows = sample.mapInArrow(count, "kh long, n long").groupBy("kh").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("kh").collect()
    return np.sort(np.array([r.kh for r in rows], np.int64).view(np.uint64))


def index_rows(docs: DataFrame, hot, parts: int) -> DataFrame:
    """Blobs of segments, hot windows and settled repeats, dealt to partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        warm: list[dict] = []
        for b in batches:
            for d in slices(b):
                s = segments(d.x, d.ends)
                if s is None or not len(s[0]):
                    continue
                first, n, at, kh, sh = s
                o = d.owner(first)
                cols = {"kh": kh, "sh": sh, "ids": d.ids[o], "fps": d.fps[o], "lo": first - d.starts[o] + d.base[o], "n": n.astype(np.int32), "off": (at - first).astype(np.int32)}
                is_hot = np.isin(kh, hot.value) if len(hot.value) else np.zeros(len(kh), bool)
                if is_hot.any():
                    start, wh = window_hashes(d.x, first[is_hot], n[is_hot])
                    o = d.owner(start)
                    k = len(start)
                    warm.append({"kh": np.repeat(kh[is_hot], n[is_hot]), "sh": wh, "ids": d.ids[o], "fps": d.fps[o], "lo": start - d.starts[o] + d.base[o], "n": np.ones(k, np.int32), "off": np.zeros(k, np.int32)})
                found.append({k: v[~is_hot] for k, v in cols.items()})
                if sum(len(x["kh"]) for x in found) + sum(len(x["kh"]) for x in warm) >= ROWS_HELD:
                    yield from deal(SEGMENT, found)
                    yield from deal(HOT, warm)
        yield from deal(SEGMENT, found)
        yield from deal(HOT, warm)

    def deal(kind: int, many: list[dict]) -> Iterator[pa.RecordBatch]:
        """Settle the rows held, give them out by partition and hold none."""
        if not many:
            return
        c = {k: np.concatenate([m[k] for m in many]).astype(TYPES[k]) for k in FIELDS}
        many.clear()
        rows = []
        order, later, new = settle(c["kh"], c["sh"], c["ids"], c["fps"], c["lo"])
        done, go = order[later], np.sort(order[new])
        if len(done):
            # Settled rows may go anywhere; equal shares by document keep them from one place.
            spot = (_mix(c["ids"][done].view(np.uint64) + _M1) >> np.uint64(32)) % np.uint64(min(parts, 16))
            for i in np.unique(spot):
                own = done[spot == i]
                rows.append(_blob(int((_mix(c["ids"][own[:1]].view(np.uint64) + _M2)[0] >> np.uint64(32)) % np.uint64(parts)), SETTLED, {k: v[own] for k, v in c.items()}))
        part = ((c["kh"] if kind == SEGMENT else c["sh"])[go] % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[by], np.arange(parts + 1))
        for p in range(parts):
            if cut[p + 1] > cut[p]:
                own = go[by[cut[p] : cut[p + 1]]]
                rows.append(_blob(p, kind, {k: v[own] for k, v in c.items()}))
        if rows:
            yield _emit(rows)

    return docs.mapInArrow(work, BLOB).repartition(parts, "part")


PLACES = "rid long, fp long, s long, e long, off long"


def _places(ids, fps, s, e, off=None) -> pa.RecordBatch:
    off = np.full(len(ids), -1, np.int64) if off is None else off
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (ids, fps, s, e, off)], ["rid", "fp", "s", "e", "off"])


def resolve(blobs: DataFrame) -> DataFrame:
    """(rid, fp, s, e, off): removed bytes (off -1), and segments whose anchor has other
    segments too (off: the anchor's place), still to be compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {SEGMENT: [], HOT: []}
        for b in batches:
            for x in b.to_pylist():
                c = {k: np.frombuffer(x[k], TYPES[k]) for k in FIELDS}
                if x["kind"] == SETTLED:
                    yield _places(c["ids"], c["fps"], c["lo"], c["lo"] + c["n"] + WINDOW - 1)
                else:
                    held[x["kind"]].append(c)
        for kind, many in held.items():
            if not many:
                continue
            c = {k: np.concatenate([m[k] for m in many]) for k in FIELDS}
            many.clear()
            # Anchors that occur once need no more work.
            by = np.argsort(c["kh"], kind="stable")
            kh = c["kh"][by]
            same = np.zeros(len(kh), bool)
            same[1:] = kh[1:] == kh[:-1]
            same[:-1] |= same[1:]
            c = {k: v[by[same]] for k, v in c.items()}
            if not len(c["kh"]):
                continue
            order, later, new = settle(c["kh"], c["sh"], c["ids"], c["fps"], c["lo"])
            gone = order[later]
            if len(gone):
                yield _places(c["ids"][gone], c["fps"][gone], c["lo"][gone], c["lo"][gone] + c["n"][gone] + WINDOW - 1)
            if kind == SEGMENT:
                one = order[new]
                kh = c["kh"][one]
                several = np.zeros(len(kh), bool)
                several[1:] = kh[1:] == kh[:-1]
                several[:-1] |= several[1:]
                one = one[several]
                if len(one):
                    yield _places(c["ids"][one], c["fps"][one], c["lo"][one], c["lo"][one] + c["n"][one] + WINDOW - 1, c["off"][one])

    return blobs.mapInArrow(work, PLACES)


class Level:
    """A suffix array: windows in byte order with the first place of each."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, lo: np.ndarray):
        self.keys, self.ids, self.fps, self.lo = keys, ids, fps, lo

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, at: np.ndarray) -> Level:
        return Level(self.keys[at], self.ids[at], self.fps[at], self.lo[at])


class Family:
    """Levels of geometrically growing sizes with every window once."""

    def __init__(self):
        self.levels: list[Level] = []

    @staticmethod
    def array(batch: Level) -> tuple[Level, Level]:
        """The batch's suffix array, and its windows that repeat inside the batch."""
        order = np.argsort(batch.keys, kind="stable")
        keys = batch.keys[order]
        new = np.ones(len(order), bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.cumsum(new) - 1
        order = order[np.lexsort((batch.lo[order], batch.fps[order], batch.ids[order], run))]
        first = np.flatnonzero(new)[run]
        later = ~_same_place(batch.ids, batch.fps, batch.lo, order, first)
        return batch.take(order[new]), batch.take(order[later])

    def add(self, batch: Level) -> Iterator[Level]:
        """Index a batch; gives the places that repeat an earlier one."""
        mine, repeats = self.array(batch)
        yield repeats
        for level in self.levels:
            at = np.searchsorted(level.keys, mine.keys)
            at[at == len(level)] = 0
            hit = np.flatnonzero(level.keys[at] == mine.keys)
            if not len(hit):
                continue
            a = at[hit]
            di, df, dl = mine.ids[hit] - level.ids[a], mine.fps[hit] - level.fps[a], mine.lo[hit] - level.lo[a]
            before = (mine.ids[hit] < level.ids[a]) | (di == 0) & ((mine.fps[hit] < level.fps[a]) | (df == 0) & (dl < 0))
            same = (di == 0) & (df == 0) & (dl == 0)
            yield mine.take(hit[~before & ~same])
            yield level.take(a[before])
            for own, new in ((level.ids, mine.ids), (level.fps, mine.fps), (level.lo, mine.lo)):
                own[a[before]] = new[hit[before]]
            rest = np.ones(len(mine), bool)
            rest[hit] = False
            mine = mine.take(rest)
        if len(mine):
            self.levels.append(mine)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            both = Level(*(np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("keys", "ids", "fps", "lo")))
            self.levels.append(both.take(np.argsort(both.keys, kind="stable")))


def fetch(docs: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """Segments to compare with their bytes, dealt by anchor: part, ids, fps, lo, n, data."""
    open_ = lists.filter("off >= 0").groupBy("rid", "fp").agg(F.collect_list(F.struct("s", "e", "off")).alias("open"))
    held = docs.join(open_.hint("shuffle_hash"), ["rid", "fp"]).select("rid", "fp", "text", "open")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, tuple[list, ...]] = {}
            ends, (ss, es, offs) = places(b.column("open"))
            for k, (i, f, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rid", "fp")), b.column("text").cast(pa.binary()), strict=True)):
                t = t.as_py() or b""
                at = slice(ends[k], ends[k + 1])
                for x, y, o in zip(ss[at].tolist(), es[at].tolist(), offs[at].tolist(), strict=True):
                    data = t[x:y]
                    part = int.from_bytes(hashlib.blake2b(data[o : o + GRAM], digest_size=8).digest(), "big") % (parts * TURNS)
                    for column, v in zip(out.setdefault(part, ([], [], [], [], [])), (i, f, x, y - x - WINDOW + 1, data), strict=True):
                        column.append(v)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out)), *(pa.array([np.array(c[k], np.int64).tobytes() for c in out.values()]) for k in range(4)), pa.array([b"".join(c[4]) for c in out.values()])],
                    ["part", "ids", "fps", "lo", "n", "data"],
                )

    return held.mapInArrow(work, "part long, ids binary, fps binary, lo binary, n binary, data binary").repartition(parts, "part").sortWithinPartitions("part")


def compare(fetched: DataFrame) -> DataFrame:
    """(rid, fp, s, e, off): removed bytes, from the index family of each partition."""

    def windows(x: dict) -> Level:
        ids, fps, lo, n = (np.frombuffer(x[k], np.int64) for k in ("ids", "fps", "lo", "n"))
        data = np.frombuffer(x["data"], np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        size = n + WINDOW - 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        keys = np.ascontiguousarray(view[np.repeat(begin, n) + inside]).view(f"S{WINDOW}").ravel()
        return Level(keys, np.repeat(ids, n), np.repeat(fps, n), np.repeat(lo, n) + inside)

    def runs(found: list[Level]) -> Iterator[pa.RecordBatch]:
        ids, fps, lo = (np.concatenate([getattr(x, k) for x in found]) for k in ("ids", "fps", "lo"))
        if not len(ids):
            return
        order = np.lexsort((lo, fps, ids))
        ids, fps, lo = ids[order], fps[order], lo[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1]) | (lo[1:] > lo[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(ids)]]) - 1
        yield _places(ids[at], fps[at], lo[at], lo[last] + WINDOW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, family = None, Family()
        found: list[Level] = []
        for b in batches:
            for x in b.to_pylist():
                if x["part"] != part:  # rows come sorted, so the family before is complete
                    part, family = x["part"], Family()
                for level in family.add(windows(x)):
                    found.append(Level(level.keys[:0].copy(), level.ids, level.fps, level.lo))
            if sum(len(f.ids) for f in found) > 500_000:
                yield from runs(found)
                found = []
        if found:
            yield from runs(found)

    return fetched.mapInArrow(work, PLACES)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans: array of (s, e) removed."""
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rid"), F.xxhash64("text").alias("fp"), "doc_id", "text")
    slim = own.select("rid", "fp", "text")
    hot = spark.sparkContext.broadcast(hot_anchors(slim, docs.count()))
    lists = stage(resolve(index_rows(slim, hot, parts)), "suffix-places")
    compared = stage(compare(fetch(slim, lists, parts)), "suffix-compared")
    gone = lists.filter("off < 0").select("rid", "fp", "s", "e").unionByName(compared.select("rid", "fp", "s", "e"))
    gone = gone.groupBy("rid", "fp").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    whole = own.join(gone.hint("shuffle_hash"), ["rid", "fp"], "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, 512) for w in batches for i in range(0, w.num_rows, 512)):
            ends, (ss, es) = places(b.column("gone"))
            kept, spans, sizes, removed = [], [], [], []
            for k, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                t = t or b""
                s, e = ss[ends[k] : ends[k + 1]], es[ends[k] : ends[k + 1]]
                if len(s):
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    s, e = s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
                s, e = s.tolist(), e.tolist()
                kept.append(b"".join(t[x:y] for x, y in zip([0, *e], [*s, len(t)], strict=True)))
                sizes.append(len(t))
                removed.append(sum(e) - sum(s))
                spans.append([{"s": x, "e": y} for x, y in zip(s, e, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:bigint,e:bigint>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE: dict[str, str] = {}
