"""Edit distance with counts of substitutions, deletions and insertions.

One Arrow batch of pairs is solved together: all pairs advance along the
anti-diagonals of their tables at once, so the number of numpy steps follows the
longest pair of a slice, not the number of cells.  Slices hold pairs of like size.
Ties prefer substitution, then deletion, then insertion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in ("errors", "S", "D", "I", "N", "H")])
ALIGNMENT = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("op", "hyp", "ref")]))
_BITS = 20  # each count in its own field of one integer, the cost on top
_S, _D, _I = np.int64(1) << 40, np.int64(1) << 20, np.int64(1)
_CELLS = 1 << 20


def _codes(rows: list) -> tuple[list[np.ndarray], list[int]]:
    index: dict = {}
    coded = [np.fromiter((index.setdefault(t, len(index)) for t in r), np.int64, len(r)) for r in rows]
    return coded, [len(r) for r in rows]


def _solve(ref: np.ndarray, hyp: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(pairs, 3) counts S, D, I for padded codes."""
    rows, wide, tall = len(n), ref.shape[1], hyp.shape[1]
    at = np.arange(wide + 1)
    far = np.int64(1) << 20
    cost = [np.full((rows, wide + 1), far) for _ in range(3)]
    count = [np.zeros((rows, wide + 1), np.int64) for _ in range(3)]
    out = np.zeros(rows, np.int64)
    for d in range(wide + tall + 1):
        c, k = cost[d % 3], count[d % 3]
        c1, k1, c2, k2 = cost[(d - 1) % 3], count[(d - 1) % 3], cost[(d - 2) % 3], count[(d - 2) % 3]
        lo, hi = max(0, d - tall), min(wide, d)
        c[:], k[:] = far, 0
        if lo == 0:  # no reference tokens: insertions
            c[:, 0], k[:, 0] = d, d * _I
        a = max(lo, 1)
        b = min(hi, d - 1)
        if a <= b:
            i = at[a : b + 1]
            same = ref[:, i - 1] == hyp[:, d - i - 1]
            sub, dele, ins = c2[:, i - 1], c1[:, i - 1], c1[:, i]
            best = np.minimum(np.minimum(sub, dele), ins)
            pick = np.where(sub == best, k2[:, i - 1] + _S, np.where(dele == best, k1[:, i - 1] + _D, k1[:, i] + _I))
            c[:, i] = np.where(same, sub, best + 1)
            k[:, i] = np.where(same, k2[:, i - 1], pick)
        if hi == d:  # no hypothesis tokens: deletions
            c[:, d], k[:, d] = d, d * _D
        done = np.flatnonzero(n + m == d)
        out[done] = k[done, n[done]]
    return np.stack([out >> 40, out >> 20 & (1 << 20) - 1, out & (1 << 20) - 1], axis=1)


def edit_counts(refs: list, hyps: list) -> np.ndarray:
    """(pairs, 3) counts S, D, I of token lists."""
    coded, _ = _codes([list(x) for x in refs] + [list(x) for x in hyps])
    ref, hyp = coded[: len(refs)], coded[len(refs) :]
    n, m = np.array([len(x) for x in ref], np.int64), np.array([len(x) for x in hyp], np.int64)
    out = np.zeros((len(ref), 3), np.int64)
    order = np.lexsort((m, n))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * (n[order[start : end + 1]].max() + 1) <= _CELLS // 8:
            end += 1
        own = order[start:end]
        r = np.full((len(own), max(1, n[own].max())), -1, np.int64)
        h = np.full((len(own), max(1, m[own].max())), -2, np.int64)
        for k, i in enumerate(own):
            r[k, : n[i]], h[k, : m[i]] = ref[i], hyp[i]
        out[own] = _solve(r, h, n[own], m[own])
        start = end
    return out


@F.pandas_udf(COUNTS)
def _counts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for refs, hyps in pairs:
        r = [() if x is None else x for x in refs]
        h = [() if x is None else x for x in hyps]
        c = edit_counts(r, h)
        n = np.array([len(x) for x in r], np.int64)
        yield pd.DataFrame({"errors": c.sum(axis=1), "S": c[:, 0], "D": c[:, 1], "I": c[:, 2], "N": n, "H": n - c[:, 0] - c[:, 1]})


def edit_ops(ref: Column, hyp: Column) -> Column:
    """Counts of the cheapest edit of token array ``ref`` into ``hyp``."""
    return _counts(ref, hyp)


def rate(errors: Column, n: Column) -> Column:
    """Errors a reference token; without any, 1 if there are errors, else 0."""
    return F.when(n > 0, errors / n).otherwise((errors > 0).cast("double"))


def char_errors(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp)


#: Moves of an alignment and the reference and hypothesis tokens each takes.
_PAIR, _DELETE, _INSERT = range(3)
_BACK = ((1, 1), (1, 0), (0, 1))
#: Moves held at once, and tokens of the pairs that are aligned together.
_MOVES, _TOKENS = 1 << 22, 1 << 16


def align(ref: list, hyp: list) -> list[tuple[str, str | None, str | None]]:
    """One cheapest alignment as (op, hypothesis token, reference token): pairs
    (hits, substitutions) before deletions before insertions, chosen from the end."""
    n, m = len(ref), len(hyp)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    h, steps = np.array([codes[t] for t in hyp], np.int64), np.arange(m + 1)

    def row_after(before: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        match, drop = before[:-1] + (h != codes[ref[i - 1]]), before[1:] + 1
        # Insertions run along the row: the least of entry minus place, plus place.
        return np.minimum.accumulate(np.concatenate([[i], np.minimum(match, drop)]) - steps) + steps, match, drop

    # Moves are kept for a block of rows at a time; a block is made again from the row before it.
    size = max(1, _MOVES // (m + 1))
    starts = list(range(0, n, size)) or [0]
    heads = [steps]
    for i in range(1, starts[-1] + 1):
        last = row_after(last if i > 1 else steps, i)[0]
        if i % size == 0:
            heads.append(last)
    i, j, path = n, m, []
    for start, before in zip(reversed(starts), reversed(heads), strict=True):
        end = min(start + size, n)
        moves = np.full((end - start + 1, m + 1), _DELETE, np.uint8)
        moves[0] = _INSERT
        for k in range(start + 1, end + 1):
            before, match, drop = row_after(before, k)
            moves[k - start, 1:] = np.select([before[1:] == match, before[1:] == drop], [_PAIR, _DELETE], _INSERT)
        while i > start or (start == 0 and j > 0):
            move = int(moves[i - start, j])
            path.append(move)
            i, j = i - _BACK[move][0], j - _BACK[move][1]
    r, y, out = iter(ref), iter(hyp), []
    for move in reversed(path):
        a = next(r) if move != _INSERT else None
        b = next(y) if move != _DELETE else None
        out.append(({_DELETE: "D", _INSERT: "I"}.get(move, "H" if a == b else "S"), b, a))
    return out


def _slices(refs: pa.Array, hyps: pa.Array) -> Iterator[tuple[list, list]]:
    """The pairs of a batch as lists, about ``_TOKENS`` tokens at a time; null counts as empty."""
    sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in (refs, hyps))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(refs):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + _TOKENS, "right")))
        yield tuple([t or [] for t in x.slice(start, end - start).to_pylist()] for x in (refs, hyps))
        start = end


@F.arrow_udf(ALIGNMENT)
def alignment(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for refs, hyps in pairs:
        for some in _slices(refs, hyps):
            ops, heard, meant, ends = [], [], [], [0]
            for r, h in zip(*some, strict=True):
                for op, y, x in align(r, h):
                    ops.append(op)
                    heard.append(y)
                    meant.append(x)
                ends.append(len(ops))
            steps = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (ops, heard, meant)], ["op", "hyp", "ref"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)


def distance(ref: list, hyp: list) -> int:
    """Fewest edits of ``ref`` into ``hyp``, by bit vectors (Myers, Hyyro): a column of the table is two long
    integers, so a token costs the length of ``ref`` in machine words."""
    a = 0
    while a < min(len(ref), len(hyp)) and ref[a] == hyp[a]:
        a += 1
    b = 0
    while b < min(len(ref), len(hyp)) - a and ref[-1 - b] == hyp[-1 - b]:
        b += 1
    ref, hyp = ref[a : len(ref) - b], hyp[a : len(hyp) - b]
    n = len(ref)
    if not n:
        return len(hyp)
    places: dict = {}
    for i, t in enumerate(ref):
        places.setdefault(t, []).append(i)
    where = {}
    for t, at in places.items():
        bits = bytearray(at[-1] // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        where[t] = int.from_bytes(bits, "little")
    full, up, down, errors = (1 << n) - 1, (1 << n) - 1, 0, n
    for t in hyp:
        same = where.get(t, 0)
        flat = ((((same & up) + up) ^ up) | same | down) & full
        more, less = down | (full ^ (flat | up)), flat & up
        errors += (more >> (n - 1)) - (less >> (n - 1))
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full ^ (flat | more)), more & flat
    return errors


@F.arrow_udf(T.LongType())
def token_errors(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Fewest edits of token array ``ref`` into ``hyp``: the errors of ``edit_ops`` without their kinds."""
    for refs, hyps in pairs:
        for some in _slices(refs, hyps):
            yield pa.array([distance(r, h) for r, h in zip(*some, strict=True)], pa.int64())
