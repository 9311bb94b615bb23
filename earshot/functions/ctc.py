"""Texts from connectionist scores: matrices of frames by symbols, symbol 0 is the blank.

The greedy text takes the best symbol of every frame, makes runs one and drops blanks; it is a
Column expression.  Prefix beam search adds up the probabilities of all paths of a text, which the best path alone
does not, and keeps the ``width`` best prefixes after every frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .signal import _let

BLANK = 0


def best_symbols(scores: Column) -> Column:
    """The first best symbol of every frame of an array of arrays of scores."""
    return F.transform(scores, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def collapse(symbols: Column) -> Column:
    """Runs of equal symbols become one, blanks go."""

    def use(s):
        kept = F.transform(s, lambda v, i: F.when((i == 0) | (v != F.get(s, i - 1)), v))
        return F.filter(kept, lambda v: v.isNotNull() & (v != BLANK))

    return _let(symbols, use)


def greedy(scores: Column) -> Column:
    return collapse(best_symbols(scores))


def beam(log_p: np.ndarray, width: int) -> tuple[list[int], float]:
    """The best text of a matrix of log probabilities, and the log of its probability as far as it was
    searched; ties go to the lesser text."""
    none = -np.inf
    # Of every prefix: log probabilities of the paths that end in a blank, and in its last symbol.
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, none)}
    for row in log_p:
        grown: dict[tuple[int, ...], list[float]] = {}

        def add(prefix: tuple[int, ...], place: int, value: float) -> None:
            both = grown.setdefault(prefix, [none, none])
            both[place] = float(np.logaddexp(both[place], value))

        for prefix, (blank, symbol) in beams.items():
            whole = float(np.logaddexp(blank, symbol))
            add(prefix, 0, whole + row[BLANK])
            for s in range(1, len(row)):
                same = bool(prefix) and prefix[-1] == s
                if same:  # the same symbol again goes on with a run; only behind a blank it is a new one
                    add(prefix, 1, symbol + row[s])
                add((*prefix, s), 1, (blank if same else whole) + row[s])
        order = sorted(grown, key=lambda p: (-np.logaddexp(*grown[p]), p))
        beams = {p: tuple(grown[p]) for p in order[:width]}
    best = min(beams, key=lambda p: (-np.logaddexp(*beams[p]), p))
    return list(best), float(np.logaddexp(*beams[best]))


BEST = StructType([StructField("symbols", ArrayType(IntegerType())), StructField("log_p", DoubleType())])


def beam_search(scores: Column, width: int = 8) -> Column:
    """struct(symbols, log_p) of the best text found; ``scores`` are logits of any scale, null gives null."""

    @F.pandas_udf(BEST)
    def search(frames: pd.Series) -> pd.DataFrame:
        rows = []
        for f in frames:
            if f is None or not len(f):
                rows.append((None, None) if f is None else ([], 0.0))
                continue
            x = np.stack([np.asarray(v, float) for v in f])
            x -= x.max(axis=1, keepdims=True)
            rows.append(beam(x - np.log(np.exp(x).sum(axis=1, keepdims=True)), width))
        return pd.DataFrame(rows, columns=["symbols", "log_p"])

    return search(scores)
