"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import spread, table

ONES_SQL = "[" + ", ".join(f"'{w}'" for w in X.ONES) + "]"
TENS_SQL = "[" + ", ".join(f"'{w}'" for w in X.TENS) + "]"


def _hundred_sql(n: str) -> str:
    return f"(CASE WHEN {n} < 20 THEN {ONES_SQL}[{n} + 1] WHEN {n} % 10 = 0 THEN {TENS_SQL}[{n} // 10 + 1] ELSE {TENS_SQL}[{n} // 10 + 1] || ' ' || {ONES_SQL}[{n} % 10 + 1] END)"


def _thousand_sql(n: str) -> str:
    return f"(CASE WHEN {n} < 100 THEN {_hundred_sql(n)} WHEN {n} % 100 = 0 THEN {ONES_SQL}[{n} // 100 + 1] || ' hundred' ELSE {ONES_SQL}[{n} // 100 + 1] || ' hundred ' || {_hundred_sql(f'({n} % 100)')} END)"


def number_sql(p: str) -> str:
    plain = f"regexp_replace({p}, '^0+([0-9])', '\\1')"
    n = f"(CASE WHEN length({plain}) <= 6 THEN {plain}::INTEGER END)"
    big = f"(CASE WHEN {n} < 1000 THEN {_thousand_sql(n)} WHEN {n} % 1000 = 0 THEN {_thousand_sql(f'({n} // 1000)')} || ' thousand' ELSE {_thousand_sql(f'({n} // 1000)')} || ' thousand ' || {_thousand_sql(f'({n} % 1000)')} END)"
    return f"(CASE WHEN length({plain}) > 6 THEN {plain} ELSE {big} END)"


def spell_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN {number_sql('p')} ELSE p END), '')"


def fold_sql(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '’‘', '''''')"


def titles_sql(x: str) -> str:
    for a, b in X.TITLES:
        x = rf"regexp_replace({x}, '\b{a}\.?\b', '{b}', 'g')"
    return x


def percent_sql(x: str) -> str:
    return rf"regexp_replace({x}, '([0-9]+)%', '\1 percent', 'g')"


def keep_sql(x: str) -> str:
    """RE2 has no lookbehind: an apostrophe counts between letters only."""
    x = f"regexp_replace({x}, '[^a-z0-9'' ]+', ' ', 'g')"
    x = f"regexp_replace(' ' || {x} || ' ', '([^a-z])''', '\\1 ', 'g')"
    return f"regexp_replace({x}, '''([^a-z])', ' \\1', 'g')"


def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def english_sql(x: str) -> str:
    return collapse_sql(keep_sql(spell_sql(percent_sql(titles_sql(fold_sql(x))))))


def other_sql(x: str) -> str:
    return collapse_sql(rf"regexp_replace({fold_sql(x)}, '[\p{{P}}\p{{S}}]', ' ', 'g')")


def _digest(key: str, tab: str, of):
    def q(spark, d):
        return spread(table(spark, d, tab)).select(key, F.md5(of(F.col("text"))).alias("digest"), F.length(of(F.col("text"))).cast("long").alias("chars"))

    return q


def _digest_sql(key: str, tab: str, of) -> str:
    return f"SELECT {key}, md5(x) AS digest, length(x)::BIGINT AS chars FROM (SELECT {key}, {of('text')} AS x FROM {tab})"


def t13(spark, d):
    """Normal form of every document by its language (every fifth has none: English)."""
    lang = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    x = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", X.normalize(X.nfkc(F.col("text")), lang).alias("x"))
    return x.select("doc_id", F.md5("x").alias("digest"), F.size(X.tokens(F.col("x"))).cast("long").alias("n_tokens"))


T13 = f"""SELECT doc_id, md5(x) AS digest, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END::BIGINT AS n_tokens FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR lang IS NULL OR lang IN ('', 'en') THEN {english_sql('text')} ELSE {other_sql('text')} END AS x FROM documents)"""


def t15(spark, d):
    a, b = X.after_first_blank(F.col("text"))
    return table(spark, d, "documents").filter(F.instr("text", " ") > 0).select("doc_id", F.md5(a).alias("head"), F.md5(b).alias("rest"))


T15 = "SELECT doc_id, md5(left(text, instr(text, ' ') - 1)) AS head, md5(substr(text, instr(text, ' ') + 1)) AS rest FROM documents WHERE instr(text, ' ') > 0"


def t16(spark, d):
    return table(spark, d, "pages").select("page_id", X.stem(F.col("url")).alias("stem"), X.suffix(F.col("url")).alias("suffix"), F.regexp_extract("url", "[^/]*$", 0).alias("name"))


T16 = r"""SELECT page_id, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS suffix, name
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages)"""


def t18(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


T18 = """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages"""


def t19(spark, d):
    return table(spark, d, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).select(X.percent_text(F.col("l_discount"), 0).alias("label"), "n")


T19 = "SELECT coalesce(printf('%.0f', l_discount * 100) || '%', '—') AS label, count(*) AS n FROM lineitem GROUP BY l_discount"


def t19_numbers(spark, d):
    """Numbers with two digits, every fifth missing or not a number."""
    k = F.col("p_partkey")
    x = F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 5 != 0, F.col("p_retailprice") / 8)
    return table(spark, d, "part").select("p_partkey", X.number_text(x).alias("label"))


T19_NUMBERS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '—' ELSE printf('%.2f', p_retailprice / 8) END AS label FROM part"


def t20_suffix(spark, d):
    """Names that a suffix keeps apart."""
    x = table(spark, d, "supplier")
    return x.select("s_suppkey", X.slug(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")), "upload", F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 6)).alias("slug"))


T20_SUFFIX = r"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR trim(s_name) = '' THEN 'upload' ELSE regexp_replace(trim(s_name), '\s+', '_', 'g') END || '_' || substr(md5(s_suppkey::VARCHAR), 1, 6) AS slug
FROM supplier"""


def t20(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat(F.lit("  "), F.col("p_name"), F.lit("  "))).alias("slug"))


T20 = r"SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'upload' ELSE regexp_replace(trim(p_name), '\s+', '_', 'g') END AS slug FROM part"


def t21(spark, d):
    return table(spark, d, "events").select("event_id", F.substring_index(F.concat(F.lit("node:"), F.col("user_id").cast("string")), ":", -1).alias("pid"))


T21 = "SELECT event_id, split_part('node:' || user_id, ':', 2) AS pid FROM events"


def t22(spark, d):
    """Noise seeds: CRC32 of the id."""
    return table(spark, d, "events").select("event_id", F.crc32(F.col("event_id").cast("string")).alias("seed"))


# CRC-32 from its definition: each byte goes in and eight bits are shifted out.
T22 = """SELECT event_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(event_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS seed FROM events"""


def t23(spark, d):
    """Interface tokens: pieces between blanks, and code points."""
    return table(spark, d, "documents").select("doc_id", F.size(X.pieces(F.col("text"))).cast("long").alias("pieces"), F.length("text").cast("long").alias("points"))


T23 = "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda t: t <> ''))::BIGINT AS pieces, length(text)::BIGINT AS points FROM documents"


def t23_digests(spark, d):
    """The tokens themselves: pieces of all texts, code points of the benchmark's, joined and hashed."""
    docs = table(spark, d, "documents").select(F.lit("pieces").alias("kind"), F.col("doc_id").alias("id"), F.md5(F.array_join(X.pieces(F.col("text")), "|")).alias("digest"))
    marks = table(spark, d, "benchmark").select(F.lit("points").alias("kind"), F.col("item_id").alias("id"), F.md5(F.array_join(X.points(F.col("text")), "|")).alias("digest"))
    return docs.unionByName(marks)


T23_DIGESTS = """SELECT 'pieces' AS kind, doc_id AS id, md5(array_to_string(list_filter(string_split(text, ' '), lambda t: t <> ''), '|')) AS digest FROM documents
UNION ALL SELECT 'points', item_id, md5(array_to_string(string_split(text, ''), '|')) FROM benchmark"""


def a19(spark, d):
    """Words and non-blank characters of every text."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(X.tokens(F.col("text"))).cast("long").alias("words"), F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("characters"))


A19 = r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))::BIGINT AS words, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS characters FROM conversations"


def p10(spark, d):
    """Suffix predicate over page addresses."""
    return table(spark, d, "pages").filter(X.suffix(F.col("url")).isin(".html", ".htm", ".wav", ".flac")).select("page_id", "url")


P10 = r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1)) IN ('.html', '.htm', '.wav', '.flac')"

QUERIES = {
    "t01_fold": _digest("doc_id", "documents", lambda c: X.fold_case(X.nfkc(c))),
    "t04_other_languages": _digest("doc_id", "documents", X.normalize_other),
    "t05_no_blanks": _digest("doc_id", "documents", lambda c: F.regexp_replace(X.normalize_other(c), r"(?U)\s+", "")),
    "t07_titles": _digest("doc_id", "documents", lambda c: X.expand_titles(X.fold_case(c))),
    "t08_percent": _digest("doc_id", "documents", X.percent_words),
    "t09_number_words": _digest("doc_id", "documents", X.spell_numbers),
    "t12_collapse": _digest("doc_id", "documents", X.collapse),
    "t13_normalize": t13, "t15_first_blank": t15, "t16_path_parts": t16, "t17_lower": _digest("item_id", "benchmark", F.lower),
    "t18_html_escape": t18, "t19_percent_label": t19, "t19_number_label": t19_numbers, "t20_slug": t20, "t20_slug_suffix": t20_suffix, "t23_digests": t23_digests, "t21_worker_pid": t21, "t22_seed": t22, "t23_pieces": t23,
    "a19_text_lengths": a19, "p10_suffix_filter": p10,
}
ORACLE = {
    "t01_fold": _digest_sql("doc_id", "documents", fold_sql),
    "t04_other_languages": _digest_sql("doc_id", "documents", other_sql),
    "t05_no_blanks": _digest_sql("doc_id", "documents", lambda x: f"replace({other_sql(x)}, ' ', '')"),
    "t07_titles": _digest_sql("doc_id", "documents", lambda x: titles_sql(fold_sql(x))),
    "t08_percent": _digest_sql("doc_id", "documents", percent_sql),
    "t09_number_words": _digest_sql("doc_id", "documents", spell_sql),
    "t12_collapse": _digest_sql("doc_id", "documents", collapse_sql),
    "t13_normalize": T13, "t15_first_blank": T15, "t16_path_parts": T16, "t17_lower": _digest_sql("item_id", "benchmark", lambda x: f"lower({x})"),
    "t18_html_escape": T18, "t19_percent_label": T19, "t19_number_label": T19_NUMBERS, "t20_slug": T20, "t20_slug_suffix": T20_SUFFIX, "t23_digests": T23_DIGESTS, "t21_worker_pid": T21, "t22_seed": T22, "t23_pieces": T23,
    "a19_text_lengths": A19, "p10_suffix_filter": P10,
}
