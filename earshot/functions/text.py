"""Text normalisation and tokens, as Column functions.

Spoken-text comparison needs one spelling on both sides: case folded, titles and
numbers spelled out, punctuation gone.  Everything is a built-in expression but the
NFKC step, to which only texts with non-ASCII characters are sent.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The wording of results depends on them.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
TITLES = (("mr", "mister"), ("mrs", "missus"), ("dr", "doctor"))
CHARACTER_LANGUAGES = ("ja", "zh")


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; of texts of ASCII alone the Python worker gets a null."""
    other = F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    return F.coalesce(_nfkc(F.when(other, text)), text)


def fold_case(text: Column) -> Column:
    """Lower case with straight apostrophes; null becomes empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘", "''")


def strip_punctuation(text: Column) -> Column:
    """Punctuation and symbols but the apostrophe become blanks."""
    return F.regexp_replace(text, r"[\p{P}\p{S}&&[^']]", " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    ten = F.get(tens, F.floor(n / 10).cast("int"))
    return F.when(n < 20, F.get(ones, n)).when(n % 10 == 0, ten).otherwise(F.concat(ten, F.lit(" "), F.get(ones, n % 10)))


def _below_thousand(n: Column) -> Column:
    ones = F.array(*map(F.lit, ONES))
    hundred = F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, _below_hundred(n)).when(n % 100 == 0, hundred).otherwise(F.concat(hundred, F.lit(" "), _below_hundred(n % 100)))


def number_words(digits: Column) -> Column:
    """A run of digits in English words; a million and above keeps its digits, without
    leading zeros."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(plain) <= 6, plain).otherwise("0").cast("int")
    thousand = F.concat(_below_thousand(F.floor(n / 1000).cast("int")), F.lit(" thousand"))
    words = F.when(n < 1000, _below_thousand(n)).when(n % 1000 == 0, thousand).otherwise(F.concat(thousand, F.lit(" "), _below_thousand(n % 1000)))
    return F.when(F.length(plain) > 6, plain).otherwise(words)


def spell_numbers(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    spelled = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), number_words(p)).otherwise(p)), "")
    return F.when(F.rlike(text, F.lit("[0-9]")), spelled).otherwise(text)


def expand_titles(text: Column) -> Column:
    for short, full in TITLES:
        text = F.regexp_replace(text, rf"\b{short}\.?\b", full)
    return text


def percent_words(text: Column) -> Column:
    return F.regexp_replace(text, "([0-9]+)%", "$1 percent")


def keep_english(text: Column) -> Column:
    """Only a-z, digits, apostrophes inside words and blanks."""
    text = F.regexp_replace(text, "[^a-z0-9' ]+", " ")
    return F.regexp_replace(text, "(?<![a-z])'|'(?![a-z])", " ")


def normalize_english(text: Column) -> Column:
    return collapse(keep_english(spell_numbers(percent_words(expand_titles(fold_case(text))))))


def normalize_other(text: Column) -> Column:
    return collapse(F.translate(strip_punctuation(fold_case(text)), "'", " "))


def katakana_to_hiragana(text: Column) -> Column:
    """Katakana as hiragana.  Readings of kanji need a dictionary and stay as they are."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(text, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def normalize(text: Column, lang: Column, kana=katakana_to_hiragana) -> Column:
    """The normal form of ``text`` by language; null or empty language is English.  ``kana`` turns Japanese
    into hiragana (``readings.to_kana`` with a table of readings)."""
    other = normalize_other(text)
    dense = F.regexp_replace(other, r"(?U)\s+", "")
    return (
        F.when(lang.isNull() | lang.isin("", "en"), normalize_english(text))
        .when(lang == "ja", kana(dense))
        .when(lang.isin(*CHARACTER_LANGUAGES), dense)
        .otherwise(other)
    )


def tokens(text: Column, lang: Column | None = None) -> Column:
    """Words; characters in languages without blanks."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    if lang is None:
        return words
    return F.when(lang.isin(*CHARACTER_LANGUAGES), F.filter(F.split(text, ""), lambda t: t != "")).otherwise(words)


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]+$", 0))


def after_first_blank(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, " ", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def html_escape(text: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def number_text(x: Column, digits: int = 2) -> Column:
    """A fixed number of digits, rounded from the binary value (exact halves to even), a dash for what is missing."""
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit("")))


def slug(name: Column, default: str = "upload", suffix: Column | None = None) -> Column:
    """A name for a folder: trimmed, blanks as underscores; ``suffix`` (``random_suffix`` for one that
    is new each time) keeps equal names apart."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", "_")
    s = F.when(s == "", F.lit(default)).otherwise(s)
    return s if suffix is None else F.concat(s, F.lit("_"), suffix)


def random_suffix(n: int = 6) -> Column:
    """``n`` random hex digits, new in each row and run."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, n)


def pieces(text: Column) -> Column:
    """What stands between blanks."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def points(text: Column) -> Column:
    """Single code points."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def unit_label(lang: Column) -> Column:
    return F.when(lang.isin(*CHARACTER_LANGUAGES), "char").otherwise("word")
