"""Mixing sources to target weights by entropy balancing (DataFrame only).

Every source gets a share of all words.  Among document rates ``r`` that give a
source its words, entropy balancing takes those nearest to 1 in relative entropy;
they are exponentially tilted, ``r = min(cap, exp(lambda * size / mean size))``.

The convex dual has one multiplier a source.  Each Newton step is an aggregate over the
cells (source, size) of all documents: the words at the present multipliers and their
derivatives, summed by source as exact decimals, so that reruns agree in every digit.  Steps go on, side by side
for all sources and within brackets, until each source's words are those wanted.

Rates become copies by error feedback.  Cells of sizes from ``LONG`` words up are rounded along running
sums of their copies, taken in ranges of sizes and then over ranges, so that the words of any run of
cells are off by half a document at most.  What these leave goes to the shorter ones, of which a source has fewer than ``LONG``
cells: from the longest to the shortest, the words taken so far never leave the words wanted so far by more than the
next sizes can mend.  Documents of equal source and size then share the copies of
their cell by the rank of a hash of their id and text, counted in sub-cells of a bounded size
so that no cell, however hot, is ranked in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; null ids are kept; repeated rows are separate documents; size-0 documents
are taken with 0 words and 0 copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import is_small, small_table, stage, table, word_count

#: Newton steps; each keeps a bracket, so 60 also bound pure bisection.
NEWTON_STEPS = 60
#: A source's words are those wanted if they differ by less than this share.
CLOSE = 1e-9
#: Cells of fewer words are fed one after the other, larger ones in ranges of so many sizes.
LONG = 4096
#: Documents ranked together at most, on average.
SUB_CELL = 1_000


def source_targets(hist: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """(source, source_size, docs, target): weights shared over all words, no target
    above ``cap`` times its source, what exceeds reshared by weight."""
    per = hist.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")
    )
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    # One row a source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rn", F.row_number().over(order) - 1).withColumn("w", w)
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("most") / F.col("w"), "rn").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("unit", F.col("left") / F.col("w_left"))
        .withColumn("free", F.col("unit") * F.col("w") <= F.col("most"))
        .withColumn("level", F.min_by(F.when(F.col("free"), F.col("unit")), F.when(F.col("free"), F.col("most") / F.col("w"))).over(every))
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("level") * F.col("w"))
    )
    return per.select("source", "source_size", "docs", target.alias("target"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def rate(size, mean, lam, cap: float):
    """The tilted rate of a document of this size."""
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.log(F.lit(float(cap))))))


def solve(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, mean, lam): the multipliers, by Newton steps on aggregates of ``hist``."""
    log_cap = F.log(F.lit(float(cap)))
    exact = lambda c: F.sum(c.cast("decimal(30,8)")).cast("double")
    squares = exact(F.col("n") * F.col("size").cast("double") * F.col("size"))
    least = hist.filter("size > 0").groupBy(F.col("source").alias("s0")).agg(F.min("size").alias("least"), squares.alias("squares"))
    x = targets.filter("source_size > 0").join(least, _same("source", "s0")).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), "least", F.log(F.col("target") / F.col("source_size")).alias("log_rate"),
        (F.col("squares") / F.col("source_size")).alias("typical"),
    )
    z = F.col("least") / F.col("mean")
    x = x.withColumn("lo", F.when(F.col("log_rate") < 0, F.col("log_rate") / z).otherwise(0.0)).withColumn("hi", F.when(F.col("log_rate") > 0, log_cap / z).otherwise(0.0))
    # The tilt that would do if all words stood in documents of their mean size.
    guess = F.col("log_rate") * F.col("mean") / F.col("typical")
    start = F.when((guess > F.col("lo")) & (guess < F.col("hi")), guess).otherwise((F.col("lo") + F.col("hi")) / 2)
    state = stage(x.select("source", "target", "mean", "lo", "hi", start.alias("lam"), F.lit(False).alias("done")), "mix-state")
    few = is_small(state)  # it keeps its rows
    for _ in range(NEWTON_STEPS):
        now = state.filter("not done").select(F.col("source").alias("s1"), "mean", "lam")
        now = F.broadcast(now) if few else now
        z = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate(F.col("size"), F.col("mean"), F.col("lam"), cap)
        slope = F.when(F.col("lam") * z >= log_cap, 0.0).otherwise(words * z)
        sums = hist.filter("size > 0").join(now, _same("source", "s1")).groupBy("s1").agg(exact(words).alias("g"), exact(slope).alias("d"))
        met = state.join(sums, _same("source", "s1"), "left").withColumn("gap", F.col("g") - F.col("target"))
        over = F.col("gap") >= 0
        met = met.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam"))).withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.try_divide(F.col("gap"), F.col("d"))
        moved = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        close = F.abs("gap") <= CLOSE * F.col("target")
        met = met.select("source", "target", "mean", "lo", "hi", F.when(close, F.col("lam")).otherwise(moved).alias("lam"), close.alias("done"))
        # What was done keeps its multiplier.
        state = stage(state.filter("done").unionByName(met.filter("done is not null")), "mix-state")
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "mean", "lam")


def tilts(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """One row for each (source, size) with its rate and the copies of its documents together."""
    lam = small_table(stage(solve(hist, targets, cap).withColumnRenamed("source", "s1"), "mix-lambda"))
    cells = hist.filter("size > 0").join(lam, _same("source", "s1")).select(
        "source", "size", "n", rate(F.col("size"), F.col("mean"), F.col("lam"), cap).alias("rate")
    )
    cells = stage(cells.withColumn("wish", (F.col("n") * F.col("rate")).cast("decimal(30,8)")), "mix-rates")
    # Long documents: copies along running sums, in ranges of sizes and over ranges.
    long = cells.filter(F.col("size") >= LONG).withColumn("range", F.expr(f"size div {LONG}"))
    inside = Window.partitionBy("source", "range").orderBy(F.desc("size"))
    long = long.withColumn("upto", F.sum("wish").over(inside))
    before = Window.partitionBy("s2").orderBy(F.desc("r2")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = long.groupBy(F.col("source").alias("s2"), F.col("range").alias("r2")).agg(F.sum("wish").alias("w"))
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("w").over(before), F.lit(0).cast("decimal(30,8)")))
    long = long.join(ranges, _same("source", "s2") & (F.col("range") == F.col("r2")))
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    end = F.col("ahead") + F.col("upto")
    long = stage(long.select("source", "size", "n", (whole(end) - whole(end - F.col("wish"))).alias("m"), "rate", "wish"), "mix-long")
    owed = long.groupBy(F.col("source").alias("s3")).agg(F.sum(F.col("size") * (F.col("wish") - F.col("m"))).cast("double").alias("owed"))
    # Shorter ones: fewer than LONG cells a source, one after the other.
    short = cells.filter(F.col("size") < LONG).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("cells"))

    def feed(acc, c):
        wanted = acc["owed"] + c["n"] * c["size"] * c["rate"]
        m = F.greatest(F.lit(0), F.least(c["n"] * int(cap), F.round(wanted / c["size"]).cast("long")))
        return F.struct(
            (wanted - m * c["size"]).alias("owed"),
            F.concat(acc["out"], F.array(F.struct(c["size"].alias("size"), c["n"].alias("n"), m.alias("m"), c["rate"].alias("rate")))).alias("out"),
        )

    none = F.expr("cast(array() as array<struct<size:bigint,n:bigint,m:bigint,rate:double>>)")
    start = F.struct(F.coalesce("owed", F.lit(0.0)).alias("owed"), none.alias("out"))
    fed = short.join(owed, _same("source", "s3"), "left").select("source", F.inline(F.aggregate("cells", start, feed)["out"]))
    return fed.unionByName(long.select("source", "size", "n", "m", "rate"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")),
        "mix-sized",
    )
    hist = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    targets = stage(source_targets(hist, weights, cap), "mix-targets")
    cells = stage(tilts(hist, targets, cap), "mix-cells")
    keyed = sized.join(cells.withColumnsRenamed({"source": "s2", "size": "z2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")))
    keyed = keyed.withColumn("sub", F.pmod(F.col("h"), F.expr(f"1 + n div {SUB_CELL}")))
    at = Window.partitionBy("source", "size", "sub").orderBy("h", "doc_id")
    keyed = keyed.withColumn("rn", F.row_number().over(at))
    subs = keyed.groupBy("source", "size", "sub", "n", "m", "rate").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("source", "size").orderBy("sub")
    subs = subs.withColumn("end", F.sum("k").over(upto)).select(
        F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("sub").alias("b3"), "k",
        F.expr("(m * end) div n - (m * (end - k)) div n").alias("mk"),
    )
    dealt = keyed.join(subs, F.col("source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3")) & (F.col("sub") == F.col("b3")))
    copies = F.expr("mk div k + if(rn <= mk % k, 1, 0)")
    out = dealt.select("doc_id", "source", "size", "rate", copies.cast("long").alias("copies")).unionByName(
        sized.filter("size = 0").select("doc_id", "source", "size", F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    )
    t = targets.select(F.col("source").alias("s4"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("s4"))).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


QUERIES = {"op6_mix": op6_mix}
ORACLE: dict[str, str] = {}
