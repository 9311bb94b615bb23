"""Readings of texts by a table of words: a trie and a cheapest way through it.

``readings`` holds (surface, reading, cost).  A text is cut into table words and
single other characters so that the costs add up to the least; each word is replaced by its reading, other
characters stay (katakana become hiragana).  The table is broadcast once, behind a check of its size.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import katakana_to_hiragana

#: Characters of a table that is broadcast, at most.
MOST_CHARACTERS = 32 << 20
#: What a character outside the table costs; words of the table cost less by default.
UNKNOWN, KNOWN = 100.0, 1.0


class Trie:
    """Words by their characters.  A node is a dictionary of its followers; under "" it has the least cost
    and its reading where a word ends."""

    def __init__(self, words: list[tuple[str, str, float]]):
        self.root: dict = {}
        for surface, reading, cost in words:
            node = self.root
            for c in surface:
                node = node.setdefault(c, {})
            if surface and ("" not in node or (cost, reading) < node[""]):
                node[""] = (cost, reading)

    def words_at(self, text: str, start: int):
        """(end, cost, reading) of the table words that begin at a place, shortest first."""
        node = self.root
        for end in range(start, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if "" in node:
                yield end + 1, *node[""]

    def cut(self, text: str) -> list[tuple[str, str | None]]:
        """(piece, reading or none) along the cheapest way; of equal ones that with the longest last word."""
        least = [0.0] + [float("inf")] * len(text)
        came: list[tuple[int, str | None]] = [(0, None)] * (len(text) + 1)
        for i in range(len(text)):
            if least[i] + UNKNOWN < least[i + 1]:
                least[i + 1], came[i + 1] = least[i] + UNKNOWN, (i, None)
            for end, cost, reading in self.words_at(text, i):
                if least[i] + cost < least[end]:
                    least[end], came[end] = least[i] + cost, (i, reading)
        out, at = [], len(text)
        while at:
            start, reading = came[at]
            out.append((text[start:at], reading))
            at = start
        return out[::-1]


@lru_cache(maxsize=4)
def _trie(words: tuple) -> Trie:
    return Trie(list(words))


def load_readings(table: DataFrame) -> tuple[tuple[str, str, float], ...]:
    """Rows (surface, reading[, cost]) for ``to_kana``; an error where they are too large to be broadcast."""
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(KNOWN)) if "cost" in table.columns else F.lit(KNOWN)
    rows = table.filter("surface is not null and surface <> '' and reading is not null").select("surface", "reading", cost.alias("cost"))
    size = rows.agg(F.sum(F.char_length("surface") + F.char_length("reading"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"a table of readings of {size} characters is not broadcast; at most {MOST_CHARACTERS} are")
    return tuple(sorted((r.surface, r.reading, r.cost) for r in rows.collect()))


def to_kana(text: Column, df: DataFrame, words: tuple = ()) -> Column:
    """``text`` in hiragana as far as the table goes; without a table only katakana are changed.  ``df`` is
    the frame the column is of; its session broadcasts the table."""
    if not words:
        return katakana_to_hiragana(text)
    held = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        trie = _trie(held.value)
        return texts.map(lambda t: None if t is None else "".join(p if r is None else r for p, r in trie.cut(t)))

    return katakana_to_hiragana(read(text))
