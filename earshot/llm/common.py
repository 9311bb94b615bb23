"""Helpers shared by the corpus operators.

Conventions of the subpackage
-----------------------------
* A document is known by ``(rid, fp)``: its id (null becomes the smallest long,
  so it sorts first) and a 64-bit hash of its text.  Repeated rows with equal id
  and text are one document; equal ids with different texts are two.
* A null text counts as empty.
* Operators select the columns they need by name first, so extra columns never
  clash with theirs.
* Lineage is cut by tables written under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside operators.
NULL_ID = -(2**63)

#: One word: a run without ASCII whitespace.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and all
    executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "earshot-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.  A writer holds, and a
    reader decodes, up to a group of rows at once; ``group_rows`` bounds it where single rows are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of longs that are broadcast, at most: about 32 MB in a hash table.
SMALL_ROWS = 1 << 20


def small_side(staged: DataFrame) -> DataFrame:
    """A staged table of a few longs, to be broadcast if it has at most ``SMALL_ROWS`` rows;
    beyond that its join shuffles both sides."""
    return F.broadcast(staged) if staged.count() <= SMALL_ROWS else staged


#: Bytes of a staged table that are broadcast, at most.
SMALL_BYTES = 32 << 20


def is_small(staged: DataFrame) -> bool:
    """Whether the values of a staged table take at most ``SMALL_BYTES``."""
    width = sum((F.octet_length(f"`{c}`") if t in ("string", "binary") else F.lit(0) for c, t in staged.dtypes), F.lit(16 + 8 * len(staged.columns)))
    return (staged.agg(F.sum(F.coalesce(width, F.lit(64)).cast("long"))).first()[0] or 0) <= SMALL_BYTES


def small_table(df: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """``df``, made of the staged table ``staged`` (itself if none is given) without more rows, to be
    broadcast if that table ``is_small``; beyond that its join shuffles both sides."""
    return F.broadcast(df) if is_small(df if staged is None else staged) else df


def extended(fields: T.StructType, ddl: str) -> T.StructType:
    """A schema followed by the columns of ``ddl``."""
    return T.StructType([*fields.fields, *T.StructType.fromDDL(ddl).fields])


#: Bytes of an input's files for one shuffle partition, at most.
PARTITION_BYTES = 16 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions to shuffle into: the session's, or more where the files under ``df`` are large."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return n
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.getClass().getSimpleName() == "LogicalRelation")
    return max(n, min(-(-size // PARTITION_BYTES), 1 << 17))


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (null: 0) without building them.

    Where blanks and line feeds stand alone, words are blanks counted by byte
    lengths; any other spacing goes to the regular expression.
    """
    t = F.coalesce(text, F.lit(""))
    odd = F.lit(False)
    for s in ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(t, F.lit(s))
    for s in (" ", "\n"):
        odd = odd | F.startswith(t, F.lit(s)) | F.endswith(t, F.lit(s))
    gaps = (
        F.lit(2) * F.octet_length(t)
        - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
        - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    )
    return (
        F.when(F.octet_length(t) == 0, F.lit(0))
        .when(odd, F.regexp_count(t, F.lit(WORD)))
        .otherwise(gaps + 1)
        .cast("long")
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements summed one by one in ``running_sums``.
BLOCK = 256


def running_sums(xs: Column) -> Column:
    """Exclusive running sums of a non-empty array of longs.

    Sums of blocks first, then inside blocks: linear but for the number of blocks.
    """
    b = BLOCK

    def use(x):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - 1) / b).cast("int")),
            lambda k: F.aggregate(F.slice(x, k * b + 1, F.lit(b)), F.lit(0).cast("long"), lambda a, v: a + v),
        )
        starts = F.aggregate(
            blocks, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
        )
        return let(
            starts,
            lambda st: F.transform(
                x,
                lambda _, i: F.get(st, F.floor(i / b).cast("int"))
                + F.when(
                    i % b > 0,
                    F.aggregate(
                        F.slice(x, (i - i % b + 1).cast("int"), F.greatest(i % b, F.lit(1)).cast("int")),
                        F.lit(0).cast("long"),
                        lambda a, v: a + v,
                    ),
                ).otherwise(F.lit(0).cast("long")),
            ),
        )

    return let(xs, use)


SPAN = "array<struct<start:bigint,end:bigint,hit:string,before:string>>"
#: Characters kept of the text before a match.
CONTEXT = 48


def _found(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))


def _spans(x: Column) -> Column:
    def spans(p):
        return F.transform(
            F.arrays_zip(x["hits"].alias("hit"), F.slice(x["gaps"], 1, F.size(x["hits"])).alias("gap"), p.alias("at")),
            lambda z: let(
                z["at"] + F.length(z["gap"]),
                lambda s: F.struct(
                    s.cast("long").alias("start"),
                    (s + F.length(z["hit"])).cast("long").alias("end"),
                    z["hit"].alias("hit"),
                    F.substring(z["gap"], -CONTEXT, CONTEXT).alias("before"),
                ),
            ),
        )

    lengths = F.zip_with(
        F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: (F.length(g) + F.length(h)).cast("long")
    )
    return F.when(F.size(x["hits"]) > 0, let(running_sums(lengths), spans)).otherwise(F.array().cast(SPAN))


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing:
    array of (start, end, hit, before) in code points, end exclusive.

    The pieces between matches give the offsets, so the cost is two scans and the
    number of matches.
    """
    return let(_found(text, pattern), _spans)


#: Matches on either side that ``CONTEXT`` characters can reach across: none is shorter than five.
ACROSS = 10


def judge_all(text: Column, pattern: str, good, use) -> Column:
    """``use(span, near)`` of the spans of ``find_all`` for which ``good(span)`` holds; ``near`` are the ``CONTEXT``
    characters before a match, a blank, and those after it.

    The sides are put together from the ends of the pieces around a match, at most ``ACROSS`` matches away,
    so the cost of a match does not hang on its place.
    """

    def side(pieces, k):
        """Of the pieces (gap, hit, gap, ...) hit ``k`` is the one at 2k + 1."""
        first = F.greatest(2 * k + 1 - 2 * ACROSS, F.lit(0))
        before = F.slice(pieces, first + 1, 2 * k + 1 - first)
        after = F.slice(pieces, 2 * k + 3, F.lit(2 * ACROSS))
        text = lambda side, end: F.array_join(F.transform(side, lambda p: p[end]), "")
        return F.concat_ws(" ", F.substring(text(before, "last"), -CONTEXT, CONTEXT), F.substring(text(after, "first"), 1, CONTEXT))

    def judged(x):
        ends = lambda p: F.struct(F.substring(p, 1, CONTEXT).alias("first"), F.substring(p, -CONTEXT, CONTEXT).alias("last"))
        n = F.size(x["hits"])
        both = F.flatten(F.zip_with(F.slice(x["gaps"], 1, n), x["hits"], lambda g, h: F.array(ends(g), ends(h))))
        numbered = F.filter(F.transform(_spans(x), lambda s, k: F.struct(s.alias("span"), k.alias("k"))), lambda z: good(z["span"]))
        pieces = F.concat(both, F.array(ends(F.element_at(x["gaps"], -1))))
        return let(
            numbered,
            lambda zs: F.when(F.size(zs) > 0, let(pieces, lambda p: F.transform(zs, lambda z: use(z["span"], side(p, z["k"]))))),
        )

    return let(_found(text, pattern), judged)
