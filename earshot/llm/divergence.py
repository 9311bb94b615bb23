"""Source divergence audit: which terms tell a source of a language from the language, and how
far the sources of a language are from each other.

Terms are runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII; a language keeps those that at
least ``LEAST_DOCS`` of its documents hold.  A group (lang, source), or a language, gives a
kept term p = 1 + floor(10**9 (count + 1) / (N + V)).  Divergence of p from q is
floor((p - q)**2 / q).  All arithmetic is on integers.

Terms: the terms of a group are put in buckets of like counts.  A bucket's largest p and the
least probability of the language among its terms bound the divergence of all its terms.  Best
first: buckets are evaluated in the order of their bounds, in rounds of growing size for all
groups side by side; a group stops when the bounds of its unseen buckets are strictly below its
k-th value.

Pairs: a term that neither source holds adds the same to a pair, so only postings (the sources
that hold a term) are read.  What one source alone would add comes from its histogram of counts;
terms that both hold add the difference, summed over blocks of postings by numpy and written as
sums of a block, never as rows of a term.

Defined cases: null text, lang and source are ''; repeated rows count as documents of their own;
a group without terms, or a language without kept terms, still has its pairs (value 0 if no term
is kept); an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, small_table, stage, table

LEAST_DOCS = 3
TOP = 200
#: Entries of a task's counts before they are handed on.
HELD = 1 << 18
#: Terms evaluated for a group in the first round, at least; each later round evaluates that many times more.
FIRST, GROWTH = TOP, 8
#: Pairs of postings in memory together.
BLOCK = 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for the kept terms; ``total`` is the language's count and
    ``head`` true on one row of each (lang, term).  ``docs``: text, lang, source."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                     pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for b in batches:
            for text, lang, source in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(_TERM.findall(text.lower()))
                before = len(n)
                n.update(own)
                d.update(own.keys())
                size += len(n) - before
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    found = docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    found = found.withColumn("term", F.col("term").cast("string")).repartition(partitions(docs.sparkSession, docs), "lang", "term")
    each = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    each = each.withColumns({"total": F.sum("n").over(of), "in_docs": F.sum("docs").over(of), "first": F.min("source").over(of)})
    return each.filter(F.col("in_docs") >= LEAST_DOCS).select("lang", "term", "source", "n", "total", (F.col("source") == F.col("first")).alias("head"))


def share(count: Column, all_: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 1) / (all + kept)), exactly."""
    plain = F.call_function("div", F.lit(1_000_000_000) * (count + 1), all_ + kept)
    wide = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (all_ + kept).cast("decimal(20,0)"))
    return 1 + F.when(count < 9_000_000_000, plain).otherwise(wide)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(g, lang, source, n_all, kept, lang_all): every occurring group, numbered."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    there = docs.select(empty("lang"), empty("source")).distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("lang_all"), F.count_if("head").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return there.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        F.monotonically_increasing_id().alias("g"), "lang", "source", zero("n_all"), zero("kept"), zero("lang_all")
    )


def bucket(n: Column) -> Column:
    """Counts up to 32 alone, larger ones by eighths of a power of two."""
    return F.when(n <= 32, n).otherwise(32 + F.floor(8 * F.log2(n / 32.0)))


def top_terms(rated: DataFrame, k: int = TOP) -> DataFrame:
    """(g, term, value, rank): of every group the ``k`` terms with p > q that diverge most.
    ``rated``: g, term, bucket, p, q, staged."""
    buckets = rated.groupBy("g", "bucket").agg(F.max("p").alias("most"), F.min("q").alias("least"), F.count(F.lit(1)).alias("terms"))
    buckets = buckets.filter("most > least").withColumn("bound", divergence(F.col("most"), F.col("least")))
    ahead = Window.partitionBy("g").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = stage(buckets.select("g", "bucket", "bound", F.coalesce(F.sum("terms").over(ahead), F.lit(0)).alias("ahead")), "divergence-buckets")
    best, limit = None, FIRST
    place = Window.partitionBy("g").orderBy(F.desc("value"), "term")
    while True:
        now = small_table(stage(left.filter(F.col("ahead") < limit).select(F.col("g").alias("g2"), F.col("bucket").alias("b2")), "divergence-round"))
        seen = rated.join(now, (F.col("g") == F.col("g2")) & (F.col("bucket") == F.col("b2"))).filter("p > q")
        seen = seen.select("g", "term", divergence(F.col("p"), F.col("q")).alias("value"))
        best = stage((seen if best is None else seen.unionByName(best.drop("rank"))).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), "divergence-best")
        kth = best.filter(F.col("rank") == k).select(F.col("g").alias("g3"), F.col("value").alias("kth"))
        left = left.join(kth, F.col("g") == F.col("g3"), "left").filter((F.col("ahead") >= limit) & (F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))))
        left = stage(left.select("g", "bucket", "bound", "ahead"), "divergence-buckets")
        if left.isEmpty():
            return best
        limit *= GROWTH


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def postings_sums(rated: DataFrame) -> DataFrame:
    """(g, h, value): for pairs of groups that share terms, what the terms of both add beyond
    what they would add one by one.  ``rated``: lang, term, g, p, p0."""

    def gain(a, b, a0, b0) -> np.ndarray:
        return _f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0)

    def even(g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple]:
        """Rows are terms that equally many groups hold."""
        step = max(1, BLOCK // g.shape[1] ** 2)
        for k in range(0, len(g), step):
            at = slice(k, k + step)
            value = gain(p[at, :, None], p[at, None, :], p0[at, :, None], p0[at, None, :])
            yield *np.broadcast_arrays(g[at, :, None], g[at, None, :]), value

    def wide(g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple]:
        """One term that more groups hold than a block has room for."""
        step = max(1, BLOCK // len(g))
        for k in range(0, len(g), step):
            at = slice(k, k + step)
            yield *np.broadcast_arrays(g[at, None], g[None]), gain(p[at, None], p[None], p0[at, None], p0[None])

    def merged(parts: list[tuple]) -> tuple:
        g, h, value = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((h, g))
        g, h, value = g[order], h[order], value[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        return (g[new], h[new], np.add.reduceat(value, np.flatnonzero(new))) if len(g) else (g, h, value)

    def summed(g: np.ndarray, h: np.ndarray, value: np.ndarray) -> tuple:
        names, at = np.unique(h, return_inverse=True)  # every g is among them
        g, h = np.searchsorted(names, g), at.reshape(h.shape)
        n = len(names)
        if n * n > BLOCK:
            return merged([(names[g.ravel()], names[h.ravel()], value.ravel())])
        out, seen = np.zeros(n * n, np.int64), np.zeros(n * n, bool)
        key = (g * n + h).ravel()
        np.add.at(out, key, value.ravel())
        seen[key] = True
        keys = np.flatnonzero(seen)
        return names[keys // n], names[keys % n], out[keys]

    def starts(t: pa.Table) -> np.ndarray:
        """First rows of the terms of a sorted table, and its end."""
        same = np.ones(t.num_rows - 1, bool)
        for c in ("lang", "term"):
            x = t.column(c).combine_chunks()
            same &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(~same) + 1, [t.num_rows]])

    def pieces(t: pa.Table, at: np.ndarray) -> Iterator[tuple]:
        """Sums over the terms that begin and end at ``at``."""
        begin, sizes = at[:-1], np.diff(at)
        columns = [t.column(c).to_numpy() for c in ("g", "p", "p0")]
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = begin[sizes == size]
            if size * size > BLOCK:
                found = (x for k in rows.tolist() for x in wide(*(c[k : k + size] for c in columns)))
            else:
                found = even(*(c[rows[:, None] + np.arange(size)] for c in columns))
            for x in found:
                yield summed(*x)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = None, []

        def batch(parts: list[tuple]) -> pa.RecordBatch:
            g, h, value = merged(parts)
            other = g != h
            return pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (g, h, value)], ["g", "h", "value"])

        for b in chain(batches, [None]):  # the last term is complete when batches end
            if b is not None and not b.num_rows:
                continue
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None:
                break
            at = starts(t)
            rest = t.slice(int(at[-2]))
            for x in pieces(t, at if b is None else at[:-1]):
                held.append(x)
                if sum(len(x[0]) for x in held) > BLOCK:
                    held = [merged(held)]
                    if len(held[0][0]) > BLOCK // 2:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    n = partitions(rated.sparkSession, rated)
    x = rated.select("lang", "term", "g", "p", "p0").repartition(n, "lang", "term").sortWithinPartitions("lang", "term")
    return x.mapInArrow(work, "g long, h long, value long").groupBy("g", "h").agg(F.sum("value").alias("value"))


def pair_values(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, value) for every ordered pair of groups of one language."""
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("n_all"), F.col("kept")))
    g = groups.select("g", "lang", "kept", zero.alias("p0"))
    h = small_table(stage(g.select(F.col("g").alias("h"), F.col("lang").alias("l2"), F.col("p0").alias("q0")), "divergence-groups"))
    none = g.join(h, (F.col("lang") == F.col("l2")) & (F.col("g") != F.col("h"))).select("g", "h", F.coalesce(F.col("kept") * divergence(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # By group one row for each distinct count, of which it has far fewer than terms.
    counts = stage(rated.groupBy("lang", "g", "p", "p0").agg(F.count(F.lit(1)).alias("k")), "divergence-counts")
    lone = counts.join(h, (F.col("lang") == F.col("l2")) & (F.col("g") != F.col("h")))
    p, p0, q0, k = (F.col(c) for c in ("p", "p0", "q0", "k"))
    there = lone.select("g", "h", (k * (divergence(p, q0) - divergence(p0, q0))).alias("value"))
    back = lone.select(F.col("h").alias("g"), F.col("g").alias("h"), (k * (divergence(q0, p) - divergence(q0, p0))).alias("value"))
    return none.unionByName(there).unionByName(back).unionByName(postings_sums(rated)).groupBy("g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    terms = stage(term_counts(docs), "divergence-terms")
    groups = stage(groups_of(docs, terms), "divergence-all")
    few = small_table(groups).withColumnsRenamed({"lang": "l2", "source": "s2"})
    rated = terms.join(few, (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s2"))).select(
        "g", "lang", "term", bucket(F.col("n")).alias("bucket"), share(F.col("n"), F.col("n_all"), F.col("kept")).alias("p"),
        share(F.lit(0).cast("long"), F.col("n_all"), F.col("kept")).alias("p0"), share(F.col("total"), F.col("lang_all"), F.col("kept")).alias("q"),
    )
    rated = stage(rated, "divergence-rated")
    names = small_table(groups.select("g", "lang", "source"), groups)
    terms_part = top_terms(rated, k).join(names, "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    other = small_table(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), groups)
    pairs = pair_values(rated, groups).join(names, "g").join(other, "h")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    return terms_part.unionByName(pairs)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}

ORACLE = {
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
lang_n AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
lp AS (SELECT lang, term, 1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q FROM kept k JOIN lang_n l USING (lang)),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.n + l.v) AS p
  FROM gn JOIN lang_n l USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pv AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)),
tv AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pv UNION ALL SELECT * FROM tv) QUALIFY part = 'pair' OR rank <= 200
""",
}
