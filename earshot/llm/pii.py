"""Personal data in texts (DataFrame only).

Regular expressions propose spans, checksums (Luhn, mod 97) or range tests confirm
them, and words near a span, within ``common.CONTEXT`` characters on either side, move its score.  Spans at or above the threshold
are reported.  Patterns are written with possessive repeats and start guards, so a
scan is linear in the text and never recurses over long runs.

Kinds: ``email``, ``ip``, ``card`` (16-19 digits, Luhn), ``phone`` (international)
are the base and are reported whenever their test holds.  The method adds ``iban``
(mod 97), ``pan`` (13-15 digits, Luhn, with a payment word near it), ``ssn`` and
``tel`` (national phone numbers), the last two only next to a context word.

Its cost grows with the text and with the number of matches, wherever they are.

Defined cases: null and empty texts have no spans; repeated rows and null ids each
give their own row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import judge_all, let, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Score of a match that passes its test, before context.
    score: float
    #: Words (English, German, French, Spanish) that raise the score by ``CONTEXT_GAIN`` near it.
    context: str
    base: bool
    #: Only texts with this (a regular expression) are scanned.
    needs: str = "[0-9]"


_CARD = r"card|visa|master|amex|credit|pay|karte|kredit|zahl|carte|crédit|tarjeta|crédito|pago"
_PHONE = r"phone|tel|call|fax|mobile|anruf|handy|appel|portable|llama|móvil|movil"

CONTEXT_GAIN = 0.4
THRESHOLD = 0.6

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|kontakt|correo|courriel", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.7, r"\bip\b|host|address|server|adress|direcci|serv", True, r"[0-9]\.[0-9]"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", 0.9, _CARD, True, r"(?:[0-9][\x20-]?){16}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, _PHONE, True, r"\+[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.9, r"iban|account|bank|konto|cuenta|compte", False, r"[A-Z]{2}[0-9]{2}"),
    Kind("pan", r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", 0.3, _CARD, False, r"(?:[0-9][\x20-]?){13}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social|security|insurance|sozial|versicherung|sécurité|seguridad", False, r"[0-9]-[0-9]"),
    Kind("tel", r"(?<![0-9+(.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", 0.3, _PHONE, False, r"[0-9]"),
)


def luhn(hit: Column, least: int, most: int) -> Column:
    def test(d):
        return F.when(F.length(d).between(least, most), F.call_function("luhn_check", d)).otherwise(False)

    return let(F.regexp_replace(hit, "[^0-9]", ""), test)


def mod97(hit: Column) -> Column:
    """ISO 7064: first four characters last, letters as 10 to 35, remainder 1."""

    def digits(s):
        def add(acc, c):
            v = F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
            return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

        turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
        return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1

    return let(F.replace(hit, F.lit(" "), F.lit("")), digits)


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(hit, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return luhn(hit, 16, 19)
    if kind == "pan":
        return luhn(hit, 13, 15)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


FOUND = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def spans_of(text: Column) -> Column:
    """All reported spans, by kind in the order of ``KINDS``, then start."""

    def of(k: Kind, t):
        def good(h):
            own = confirmed(k.name, h["hit"])
            if k.name in ("pan", "tel"):  # not the tail of an international number
                own &= ~F.rlike(h["before"], F.lit(r"\+[0-9][\x20().0-9-]*$"))
            return own

        def scored(h, near):
            gain = F.when(F.rlike(near, F.lit(f"(?iu){k.context}")), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(
                F.lit(k.name).alias("kind"), h["start"].alias("start"), h["end"].alias("end"),
                F.round(F.least(F.lit(1.0), F.lit(k.score) + gain), 2).alias("score"), F.lit(k.base).alias("base"),
            )

        kept = F.filter(judge_all(t, k.pattern, good, scored), lambda s: s["base"] | (s["score"] >= THRESHOLD))
        return F.coalesce(F.when(F.rlike(t, F.lit(k.needs)), kept), F.array().cast(FOUND))

    every = lambda t: F.flatten(F.array(*[of(k, t) for k in KINDS]))
    t = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(t, F.lit("[0-9@]")), every(t)).otherwise(F.array().cast(FOUND))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans: array of (kind, start, end, score, base)."""
    return docs.select("doc_id", "text", spans_of(F.col("text")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    one = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[n(k.name) for k in KINDS if k.base],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
