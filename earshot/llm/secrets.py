"""Secret scans by a battery of randomness tests (DataFrame only).

Base patterns (assignments, access keys, long hex runs) report what they match.
Beyond them, every token of 20 or more characters that mixes letters and digits is
a candidate.  Its encoding is inferred (the tightest alphabet of ``ALPHABETS`` that
holds it) and three tests ask whether it is uniform noise over that alphabet:
chi-squared over eight equal bins, Wald-Wolfowitz runs about the middle, and lag-1
serial correlation.  The least of the three p-values, times three, is the token's
randomness.

False discoveries are controlled among the reported spans.  The null is that a token is
made of words.  It is fitted to the corpus: the words of every document, joined and capitalised like
an identifier, are cut into reference tokens from the first to the last letter (``reference``), scored by the
same battery from sums over neighbouring letters (``word_p``).  A candidate's p is the share of reference tokens of its length class and
family of alphabets that look at least as random, and inside each such class the
Benjamini-Hochberg rule at ``FDR`` decides which candidates are reported as ``random``.
Both are counted in histograms of randomness (bins of a twentieth of a decade, rounded
against a report); only those reach the driver, at most 6 * 2 * 401 numbers.  With few
documents the least possible p is large, and little or nothing is reported.

Defined cases: null and empty texts have no spans; repeated rows and null ids each
give their own row (and their tokens count each time); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find_all, let, stage, table
from .pii import joined

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
VALUE = r"[A-Za-z0-9+/_.=-]++"
SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""
#: name, pattern, least length of the match (assign: of the value).
BASE = (
    ("assign", f"{KEYWORD}{SEPARATOR}{VALUE}", 12),
    ("access", r"AKIA[A-Z0-9]++", 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 16),
)
GATES = {
    "assign": rf"""{KEYWORD}["']?\x20*[:=]""",
    "access": "AKIA",
    "hex": r"[0-9a-f]{16}",
}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
FDR = 0.01
#: Bins of -log10(randomness): a twentieth of a decade each, the last one open.
BINS, BIN = 400, 0.05
#: Lengths of reference tokens, one for each length class (powers of two from 16, the
#: last class open).
REFERENCE = (24, 44, 90)
FIRST_CLASS = 4

FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"
CANDIDATES = "array<struct<kind:string,start:bigint,end:bigint,encoding:string,length:int,p:double>>"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "base32": _LOWER.upper() + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _LOWER.upper(),
    "alnum": _DIGITS + _LOWER.upper() + _LOWER,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
    "base64url": _LOWER.upper() + _LOWER + _DIGITS + "-_",
    "mixed": _LOWER.upper() + _LOWER + _DIGITS + "+/-_",
}
#: Families of alphabets: letters of one case, or of both.
ONE_CASE = ("hex", "base32", "lower36", "upper36")


def tail(z: Column) -> Column:
    """Upper tail of the normal law (Abramowitz and Stegun 26.2.17)."""

    def upper(a):
        t = 1 / (1 + 0.2316419 * a)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) * 0.3989422804014327 * poly

    return let(z, lambda x: F.when(x >= 0, upper(x)).otherwise(1 - upper(-x)))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * tail(F.abs(z)))


def _share(encoding: str) -> list[float]:
    """Of each of the eight bins, the share of the alphabet's letters in it."""
    m = len(ALPHABETS[encoding])
    return [sum(1 for x in range(m) if x * 8 // m == b) / m for b in range(8)]


def of_encoding(encoding: Column, value) -> Column:
    return F.element_at(F.create_map(*[c for e in ALPHABETS for c in (F.lit(e), value(e))]), encoding)


def p_value(token: Column, encoding: Column) -> Column:
    """Least of three p-values, times three, of uniform noise over the alphabet."""
    body = F.regexp_replace(token, "=+$", "")
    chars = F.split(F.when(encoding == "hex", F.lower(body)).otherwise(body), "")

    def coded(kind):
        return F.struct(F.transform(chars, lambda c: F.call_function("position", c, kind["letters"]) - 1).alias("v"), F.length(kind["letters"]).alias("m"), kind["shares"].alias("shares"))

    def battery(x):
        v, m = x["v"], x["m"]
        n = F.size(v).cast("double")
        bins = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(v, lambda c: F.floor(c * 8 / m) == b)))
        parts = F.zip_with(bins, x["shares"], lambda k, s: (k - n * s) * (k - n * s) / (n * s))
        chi2 = F.aggregate(parts, F.lit(0.0), lambda a, y: a + y)
        chi_z = (F.pow(chi2 / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5
        high = F.transform(v, lambda c: (c * 2 >= m).cast("int"))

        def runs(h):
            n1 = F.aggregate(h, F.lit(0), lambda a, y: a + y).cast("double")
            n2 = n - n1
            r = 1 + F.size(F.filter(F.zip_with(F.slice(h, 2, F.size(h)), F.slice(h, 1, F.size(h) - 1), lambda a, b: a != b), lambda y: y))
            mean = 2 * n1 * n2 / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var > 0, two_sided((r - mean) / F.sqrt(var))).otherwise(0.0)

        def serial(y):
            mean = F.aggregate(y, F.lit(0.0), lambda a, z: a + z) / n
            d = F.transform(y, lambda z: z - mean)

            def corr(dev):
                sq = F.aggregate(dev, F.lit(0.0), lambda a, z: a + z * z)
                lag = F.aggregate(
                    F.zip_with(F.slice(dev, 2, F.size(dev)), F.slice(dev, 1, F.size(dev) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, z: a + z
                )
                return F.when(sq > 0, two_sided((lag / sq + 1 / n) * F.sqrt(n))).otherwise(0.0)

            return let(d, corr)

        least = F.least(tail(chi_z), let(high, runs), serial(F.transform(v, lambda c: c.cast("double"))))
        return F.least(F.lit(1.0), 3 * least)

    kind = F.struct(of_encoding(encoding, lambda e: F.lit(ALPHABETS[e])).alias("letters"), of_encoding(encoding, lambda e: F.array(*map(F.lit, _share(e)))).alias("shares"))
    return let(let(kind, coded), battery)


def base_spans(t: Column) -> Column:
    """Base spans by start, then kind."""

    def of(i):
        name, pattern, least = BASE[i]
        value = (lambda h: F.regexp_replace(h, f"^{KEYWORD}{SEPARATOR}", "")) if name == "assign" else (lambda h: h)
        good = F.filter(find_all(t, pattern), lambda h: F.length(value(h["hit"])) >= least)
        out = F.transform(good, lambda h: F.struct(h["start"].alias("start"), F.lit(i).alias("i"), F.lit(name).alias("kind"), h["end"].alias("end")))
        return F.when(F.rlike(t, F.lit(GATES[name])), out).otherwise(F.array().cast("array<struct<start:bigint,i:int,kind:string,end:bigint>>"))

    every = F.array_sort(F.flatten(F.array(*[of(i) for i in range(len(BASE))])))
    return F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def candidates(t: Column) -> Column:
    def encoding(h):
        return (
            F.when(F.rlike(h, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), "hex")
            .when(F.rlike(h, F.lit("^[A-Z2-7]+=*$")), "base32")
            .when(F.rlike(h, F.lit("^[a-z0-9]+=*$")), "lower36")
            .when(F.rlike(h, F.lit("^[A-Z0-9]+=*$")), "upper36")
            .when(F.rlike(h, F.lit("^[A-Za-z0-9]+=*$")), "alnum")
            .when(F.rlike(h, F.lit("^[A-Za-z0-9+/]+=*$")), "base64")
            .when(F.rlike(h, F.lit("^[A-Za-z0-9_-]+=*$")), "base64url")
            .otherwise("mixed")
        )

    def one(h):
        def scored(e):
            p = p_value(h["hit"], e)
            return F.struct(F.lit("random").alias("kind"), h["start"].alias("start"), h["end"].alias("end"), e.alias("encoding"), F.length(h["hit"]).alias("length"), p.alias("p"))

        return let(encoding(h["hit"]), scored)

    mixed = F.filter(
        find_all(t, TOKEN), lambda h: F.rlike(h["hit"], F.lit("[0-9]")) & F.rlike(h["hit"], F.lit("[A-Za-z]"))
    )
    gate = F.rlike(t, F.lit("[A-Za-z0-9+/_-]{20}")) & F.rlike(t, F.lit("[0-9]"))
    return F.when(gate, F.transform(mixed, one)).otherwise(F.array().cast(CANDIDATES))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))), F.lit(FIRST_CLASS + len(REFERENCE) - 1)).cast("int")


def family(encoding: Column) -> Column:
    return F.when(encoding.isin(*ONE_CASE), 0).otherwise(1)


def p_bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / BIN)).cast("int")


def _steps() -> tuple[list[int | None], list[tuple[int, int]], list[tuple[int, int]]]:
    """Codes of ASCII letters and digits, and what a letter adds to a token's sums, as its first (by code) and after another
    (by 64 times the other's code and its own).  A code is the place in ``lower36`` (either case), or 64 and the place in ``alnum``.

    Sums are packed: 13 bits for the sum of places, 19 for their squares, 19 for products of neighbours; and seven bits
    for each of the eight bins, seven for changes about the middle."""
    codes: list[int | None] = [None] * 256
    first, after = [(0, 0)] * 128, [(0, 0)] * 8192
    for k, letters in enumerate((ALPHABETS["lower36"], ALPHABETS["alnum"])):
        m = len(letters)
        for v, c in enumerate(letters):
            codes[128 * k + ord(c)] = 64 * k + v
            if not k:
                codes[ord(c.upper())] = v
            one = (v + (v * v << 13), 1 << 7 * (v * 8 // m))
            first[64 * k + v] = one
            for p in range(m):
                after[64 * (64 * k + p) + 64 * k + v] = (one[0] + (p * v << 32), one[1] + (((2 * v >= m) != (2 * p >= m)) << 56))
    return codes, first, after


def word_p(word: Column, one_case: Column) -> Column:
    """``p_value`` of a token of 2 to 127 letters and digits, of one case (``lower36``) or of both (``alnum``), from
    sums of what every two neighbours add, taken from tables."""
    codes, first, after = _steps()
    # One literal of the plan, folded from a string.
    values = lambda xs: F.split(F.lit(",".join("" if x is None else str(x) for x in xs)), ",").try_cast("array<bigint>")
    m = F.when(one_case, F.lit(len(ALPHABETS["lower36"]))).otherwise(F.lit(len(ALPHABETS["alnum"])))
    shares = F.when(one_case, F.array(*map(F.lit, _share("lower36")))).otherwise(F.array(*map(F.lit, _share("alnum"))))
    bits = lambda x, at, n: F.call_function("shiftright", x, F.lit(at)).bitwiseAND(F.lit((1 << n) - 1))

    def sums(v):
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda p, x: p * 64 + x)

        def packed(steps):
            def total(i):
                begin, more = values(x[i] for x in first), values(x[i] for x in after)
                return F.aggregate(steps, F.get(begin, F.get(v, F.lit(0))), lambda a, s: a + F.get(more, s))

            place = lambda k: F.element_at(v, k).bitwiseAND(F.lit(63))
            return F.struct(total(0).alias("a"), total(1).alias("b"), place(1).alias("first"), place(-1).alias("last"), F.size(v).cast("double").alias("n"))

        return let(pairs, packed)

    def battery(x):
        n, first_, last = x["n"], x["first"], x["last"]
        s, q, lags = bits(x["a"], 0, 13), bits(x["a"], 13, 19), bits(x["a"], 32, 19)
        count = lambda b: F.call_function("shiftright", x["b"], (7 * b).cast("int")).bitwiseAND(F.lit(127))
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: let(F.struct(count(b).alias("k"), (n * F.get(shares, b)).alias("e")), lambda z: (z["k"] - z["e"]) * (z["k"] - z["e"]) / z["e"]))
        chi2 = F.aggregate(parts, F.lit(0.0), lambda s, y: s + y)
        chi_z = (F.pow(chi2 / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5
        # The upper half of an alphabet is its upper four bins.
        n1 = sum((count(F.lit(b)) for b in range(5, 8)), count(F.lit(4))).cast("double")
        r = 1 + bits(x["b"], 56, 7)
        runs_mean = 2 * n1 * (n - n1) / n + 1
        var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
        runs = F.when(var > 0, two_sided((r - runs_mean) / F.sqrt(var))).otherwise(0.0)
        mean = s / n
        sq = q - mean * s
        lag = lags - mean * (2 * s - first_ - last) + (n - 1) * mean * mean
        serial = F.when(n * q > s * s, two_sided((lag / sq + 1 / n) * F.sqrt(n))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(tail(chi_z), runs, serial))

    offset = F.when(one_case, 0).otherwise(128)
    coded = let(offset, lambda k: F.transform(F.split(word, ""), lambda c: F.get(values(codes), F.ascii(c) + k)))
    return let(let(coded, sums), battery)


def _rounds() -> tuple[int, list[list[tuple[int, int, int, int]]]]:
    """Letters of a round of one token a class and family, and its orders: (start, size, class, family)."""
    kinds = [(size, FIRST_CLASS + i, fam) for fam in (0, 1) for i, size in enumerate(REFERENCE)]
    orders = []
    for k in range(len(kinds)):
        at, order = 0, []
        for size, cls, fam in kinds[k:] + kinds[:k]:
            order.append((at, size, cls, fam))
            at += size
        orders.append(order)
    return at, orders


def reference(t: Column) -> Column:
    """Class, family and bin of tokens of the text's own words: its letters and digits, cut one token after the other, in
    rounds of all classes and families that begin at a hashed one.  What is left of a text is cut into
    smaller classes, until less than the smallest remains."""
    letters, orders = _rounds()
    kind = lambda at, size, cls, fam: F.struct(at.cast("int").alias("at"), F.lit(size).alias("size"), F.lit(cls).alias("cls"), fam.cast("int").alias("family"))
    plans = F.array(*[F.array(*[kind(F.lit(at), size, cls, F.lit(fam)) for at, size, cls, fam in order]) for order in orders])
    h = F.xxhash64(t)

    def cut(z, plan):
        """The tokens of one round's letters."""

        def more(full):
            end = F.coalesce(F.try_element_at(full, F.lit(-1))["at"] + F.try_element_at(full, F.lit(-1))["size"], F.lit(0))

            def some(i, at, n, e):
                found = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda k: kind(at + k * REFERENCE[i], REFERENCE[i], FIRST_CLASS + i, F.pmod(k + e, F.lit(2))))
                return F.when(n > 0, found).otherwise(F.slice(full, 1, 0))

            def rest(e):
                left, out = F.length(z) - e, [full]
                for i in range(len(REFERENCE) - 2, -1, -1):
                    n = F.floor(left / REFERENCE[i])
                    out.append(some(i, F.length(z) - left, n, e))
                    left = left - n * REFERENCE[i]
                return F.concat(*out)

            return let(end, rest)

        def scored(k):
            p = word_p(F.substring(z, k["at"] + 1, k["size"]), k["family"] == 0)
            return F.struct(k["cls"].alias("cls"), k["family"].alias("family"), p_bin(p).alias("bin"))

        return F.transform(let(F.filter(plan, lambda k: k["at"] + k["size"] <= F.length(z)), more), scored)

    rounds = F.regexp_extract_all(F.regexp_replace(F.initcap(t), "[^A-Za-z0-9]+", ""), F.lit(".{1,%d}" % letters), F.lit(0))
    return let(F.get(plans, F.pmod(h, F.lit(len(orders))).cast("int")), lambda plan: F.flatten(F.transform(rounds, lambda z: cut(z, plan))))


def scanned(t: Column) -> Column:
    """The base spans, and the candidates that touch none (one that does is that span)."""

    def free(x):
        own = F.filter(x["found"], lambda c: ~F.exists(x["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.struct(x["base"].alias("base"), own.alias("found"))

    return let(F.struct(base_spans(t).alias("base"), candidates(t).alias("found")), free)


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by ``keep``, and _s: base spans, candidates with their class, family and bin, and the
    text's own tokens as reference.  Texts are looked at here alone."""

    def of(t):
        def brief(c):
            return F.struct(
                c["start"].alias("start"), c["end"].alias("end"), length_class(c["length"]).alias("cls"),
                family(c["encoding"]).alias("family"), p_bin(c["p"]).alias("bin"),
            )

        return let(scanned(t), lambda x: F.struct(x["base"].alias("base"), F.transform(x["found"], brief).alias("found"), reference(t).alias("own")))

    return docs.select("doc_id", *keep, let(F.coalesce("text", F.lit("")), of).alias("_s"))


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """By length class and family, the last bin that is reported; ``found``: a ``scan``."""
    place = lambda c, own: F.struct(F.lit(own).alias("reference"), c["cls"].alias("cls"), c["family"].alias("family"), c["bin"].alias("bin"))
    places = F.concat(F.transform("_s.found", lambda c: place(c, False)), F.transform("_s.own", lambda c: place(c, True)))
    # inline_outer, since a plain inline repeats its input in a filter.
    hist = found.select(F.inline_outer(places)).filter("bin is not null")
    by: dict[tuple[int, int], tuple[dict, dict]] = {}
    for x in hist.groupBy("reference", "cls", "family", "bin").count().collect():
        by.setdefault((x.cls, x.family), ({}, {}))[x.reference][x.bin] = x["count"]
    out: dict[tuple[int, int], int] = {}
    for key, (tokens, words) in by.items():
        total, refs, seen, alike = sum(tokens.values()), sum(words.values()), 0, 1
        for b in range(BINS + 1):
            seen += tokens.get(b, 0)
            alike += words.get(b, 0)
            if total and alike / (refs + 1) <= fdr * seen / total:
                out[key] = b
    return out


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named by ``keep``, and spans: (kind, start, end), sorted by
    start, base kinds first at equal starts.  Texts are scanned once, into a staged table from which
    the thresholds and then the spans are taken."""
    found = stage(scan(docs, keep), "secrets")
    limits = thresholds(found)

    def random(c):
        last = F.lit(-1)
        for (cls, fam), b in sorted(limits.items()):
            last = F.when((c["cls"] == cls) & (c["family"] == fam), F.lit(b)).otherwise(last)
        return c["bin"] <= last

    def placed(s, i):
        return F.struct(s["start"].alias("start"), i.alias("i"), s["kind"].alias("kind"), s["end"].alias("end"))

    rank = lambda s: sum((F.when(s["kind"] == name, i).otherwise(0) for i, (name, _, _) in enumerate(BASE)), F.lit(0))
    extra = F.transform(F.filter("_s.found", random), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("i"), F.lit("random").alias("kind"), c["end"].alias("end")))
    every = F.array_sort(F.concat(F.transform("_s.base", lambda s: placed(s, rank(s))), extra))
    spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *keep, F.col("_s.base").alias("base"), spans.alias("spans"))


MASK = "[SECRET]"


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every reported span replaced by ``MASK``; touching spans as one."""

    def join(acc, s):
        fresh = F.struct(
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), F.lit(MASK))).alias("out"),
            s["end"].cast("int").alias("at"),
        )
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"].cast("int")).alias("at"))
        return F.when((s["start"] > acc["at"]) | (F.size(acc["out"]) == 0), fresh).otherwise(longer)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, join, end)).otherwise(text)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(name) for name, _, _ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLE: dict[str, str] = {}
