"""Document fingerprints by one-permutation MinHash (DataFrame only).

Every word shingle is hashed once.  The top bits of a hash choose one of ``BINS`` bins, the
least hash of a bin is its value.  An empty bin borrows the value of a bin that is not empty
(optimal densification): ``PROBES`` bins drawn by a hash of the empty bin's number are tried in
turn, and where all of them are empty the bin whose own hash with the empty one is least
lends; both choices depend only on which bins are filled, so two texts borrow alike.  Of each
value the low ``BITS`` bits are kept, sixteen bins packed in a long.  The share of equal bins,
corrected for bits that agree by chance, estimates the Jaccard similarity of the shingle sets
(standard error 0.03 at one half).

``with_next`` gives every document the one after it by descending id without sorting all texts
in one place: cells of neighbouring ids come from quantiles, each cell is sorted alone, and the
first document of every cell is also put at the end of the cell before.  Whole texts are
shuffled once.

Defined cases: a null text is empty; a text of fewer words than a shingle is one shingle; a text
without words has the fingerprint of zeros, like 1 to another such and 0 to all others; null ids
come last, ids that repeat are ordered by a hash of their text, and each of their rows stays (an id
with very many rows is spread over cells by that hash); a table of one document is its own next; an
empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, let, partitions, small_side, stage, table

SHINGLE, BINS, BITS = 5, 256, 4
PROBES = 8
#: Quantiles of the ids that bound cells, at most, and cells in all.
QUANTILES, CELLS = 4096, 1 << 18
#: Cells a partition gets on average; many, so that partitions are of about one size.
EACH = 16
_PER_LONG = 64 // BITS
#: The lowest bit of every packed bin.
_ONES = int("1" * _PER_LONG, 16)
_BLANKS = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words, repeats included; none without words."""

    def runs(h):
        n = F.size(h) - (SHINGLE - 1)
        zipped = F.arrays_zip(*[F.slice(h, k + 1, n).alias(f"w{k}") for k in range(SHINGLE)])
        return F.when(n > 0, F.transform(zipped, lambda z: F.xxhash64(z))).otherwise(F.array(F.xxhash64(h)))

    def words(t):
        return let(F.transform(F.split(t, _BLANKS), lambda w: F.xxhash64(w)), runs)

    return let(
        F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")),
        lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(words(t)),
    )


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 64 - BINS.bit_length() + 1) + BINS // 2).cast("int")


def least_of_bins(hashes: Column) -> Column:
    """The least hash of every bin that has one, by bin: signed order is the order of bins."""
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))),
    )


def densified(least: Column) -> Column:
    """``BINS`` values from the least hashes (``least_of_bins``, not empty)."""

    def spread(f):
        def at(x, i):
            gap = _bin(x) - F.when(i == 0, -1).otherwise(_bin(F.get(f, i - 1))) - 1
            return F.concat(F.array_repeat(F.lit(None).cast("bigint"), gap), F.array(x))

        rest = F.array_repeat(F.lit(None).cast("bigint"), BINS - 1 - _bin(F.element_at(f, -1)))
        return F.concat(F.flatten(F.transform(f, at)), rest)

    def borrow(f, v):
        def value(x, i):
            tried = [F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            lender = F.array_min(F.transform(f, lambda y: F.struct(F.xxhash64(_bin(y), i).alias("rank"), y.alias("value"))))
            return F.coalesce(x, *tried, lender["value"])

        return F.transform(v, value)

    return let(least, lambda f: let(spread(f), lambda v: borrow(f, v)))


def fingerprint(text: Column) -> Column:
    """array of longs with ``BITS`` low bits of every bin, all zero without words."""

    def packed(v):
        def one(k):
            return F.aggregate(
                F.slice(v, (k * _PER_LONG + 1).cast("int"), F.lit(_PER_LONG)), F.lit(0).cast("bigint"),
                lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), one)

    def of(f):
        return F.when(F.size(f) > 0, let(densified(f), packed)).otherwise(F.array_repeat(F.lit(0).cast("bigint"), BINS // _PER_LONG))

    return let(least_of_bins(shingle_hashes(text)), of)


def digits(packed: Column) -> Column:
    """A fingerprint as lower-case hex digits, one a bin."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""

    def unequal(x):
        low = x
        for k in range(1, BITS):
            low = low.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(low.bitwiseAND(F.lit(_ONES)))

    chance = 1 / (1 << BITS)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + unequal(x))
    none = lambda x: F.forall(x, lambda v: v == 0)
    share = ((1 - differ / BINS) - chance) / (1 - chance)
    return F.when(none(a) != none(b), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (packed longs) of every row (doc_id, text)."""
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


# ------------------------------------------------------------- the document after each


def _cells(ids: DataFrame, n: int) -> Column:
    """An order-preserving cell of ``_id`` (descending) and ``_h`` (ascending), from about
    ``n`` quantiles of the ids; what lies between two quantiles is cut evenly."""
    q = min(max(n, 1), QUANTILES)
    shares = F.expr("array(" + ",".join(f"{k}D/{q}" for k in range(1, q)) + ")") if q > 1 else F.array(F.lit(0.5))
    # At most QUANTILES longs reach the driver.
    cuts = ids.agg(F.percentile_approx("_id", shares, 20 * QUANTILES), F.min("_id"), F.max("_id")).first()
    if cuts[1] is None:
        return F.lit(0).cast("bigint")
    times: dict[int, int] = {}
    for x in cuts[0]:
        times[x] = times.get(x, 0) + 1
    edges = set(times) | {cuts[1]} | {x + 1 for x, k in times.items() if k > 1 and x < cuts[2]}
    low = sorted(edges)
    finer = max(1, min(n, CELLS) // q)
    # By cell from below: first id, last id, parts; a cell of one id is cut by the hash.
    high = [*[x - 1 for x in low[1:]], cuts[2]]
    parts = [finer * times.get(a, 1) if a == b else finer for a, b in zip(low, high, strict=True)]
    array = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
    steps = max(1, (len(low)).bit_length())

    def halve(at, k):
        ahead = at + F.element_at(F.array(*[F.lit(1 << (steps - 1 - j)) for j in range(steps)]), k + 1)
        return F.when(F.get(array(low), ahead - 1) <= F.col("_id"), ahead).otherwise(at)

    c = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), halve)

    def sub(at):
        a, b, k = F.get(array(low), at), F.get(array(high), at), F.get(array(parts), at)
        of_id = (b.cast("double") - F.col("_id").cast("double")) / (b.cast("double") - a.cast("double") + 1)
        of_hash = F.col("_h").cast("double") / F.lit(2.0**64) + 0.5
        share = F.when(a == b, of_hash).otherwise(of_id)
        s = F.least(k - 1, F.greatest(F.lit(0), F.floor(share * k)))
        return (F.lit(len(low) - 1) - at).cast("bigint") * F.lit(1 << 40) + s

    return let(c - 1, sub)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint of rows (doc_id, text): next is the
    document after it by descending id, after the last the first."""
    spark = docs.sparkSession
    n = partitions(spark, docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    rows = rows.withColumn("_cell", _cells(rows.select("_id"), EACH * n))
    # One row a cell from here on, at most CELLS and QUANTILES.
    order = F.struct((-1 - F.col("_id")).alias("turned"), "_h")
    heads = rows.groupBy("_cell").agg(F.min(order).alias("o"))
    line, every = Window.orderBy("_cell"), Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("_cell").over(line), F.max("_cell").over(every))
    heads = heads.select(before.alias("_cell"), (-1 - F.col("o.turned")).alias("i2"), F.col("o._h").alias("h2"))
    heads = small_side(stage(heads, "fingerprint-heads"))
    found = rows.drop("_cell").join(heads, (F.col("_id") == F.col("i2")) & (F.col("_h") == F.col("h2")))
    guests = found.groupBy("_cell").agg(F.min("text").alias("text"))
    own = rows.select("_cell", F.lit(False).alias("guest"), "_id", "_h", "doc_id", "text")
    guests = guests.select("_cell", F.lit(True).alias("guest"), F.lit(NULL_ID).alias("_id"), F.lit(0).cast("bigint").alias("_h"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    both = own.withColumn("fingerprint", fingerprint(F.col("text"))).unionByName(guests.withColumn("fingerprint", fingerprint(F.col("text"))))
    w = Window.partitionBy("_cell").orderBy("guest", F.desc("_id"), "_h")
    both = both.repartition(n, "_cell").withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)})
    return both.filter(~F.col("guest")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.expr("length(text) div 3").cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    x = x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("changed"))
    return x.select(
        "doc_id", "n_chars", "edited_sha256", digits(F.col("fingerprint")).alias("fingerprint"), digits(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("changed")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op11_fingerprints": op11_fingerprints}
ORACLE: dict[str, str] = {}
