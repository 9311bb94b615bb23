"""Registry lookups as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import models as M
from .tables import table


_REGISTRY = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', '{p}', '{','.join(x)}', {str(m).lower()})" for n, f, p, x, m in M.REGISTRY) + ") t(name, family, parameters, languages, multilingual)"


def _spoken(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def s15(spark, d):
    """Every model with the documents in its languages."""
    r = M.registry(spark)
    docs = _spoken(spark, d).groupBy("lang").agg(F.sum("n").alias("n"))
    per = docs.join(F.broadcast(r.select("name", F.explode("languages").alias("l"))), F.col("lang") == F.col("l")).groupBy("name").agg(F.sum("n").alias("documents"))
    return r.join(per, "name", "left").select("name", "family", "parameters", F.array_join("languages", ",").alias("languages"), "multilingual", F.coalesce("documents", F.lit(0)).alias("documents"))


S15 = f"""SELECT name, family, parameters, languages, multilingual, (SELECT count(*) FROM documents WHERE list_contains(string_split(languages, ','), lang)) AS documents FROM ({_REGISTRY})"""


def p06(spark, d):
    """How many documents of each language every model can take."""
    docs = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    r = M.registry(spark)
    # The registry has seven rows, the languages one row each.
    return docs.join(F.broadcast(r), M.can_run(docs["lang"], F.lit("transcribe"), r["languages"], r["multilingual"])).select("name", "lang", "n")


P06 = f"SELECT name, lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) JOIN ({_REGISTRY}) ON list_contains(string_split(languages, ','), lang)"


def p12(spark, d):
    """Of every source the documents that some multilingual model of a family can take."""
    r = F.broadcast(M.registry(spark).filter("multilingual").select("family", "languages", "multilingual"))
    docs = _spoken(spark, d)
    fit = docs.join(r, M.can_run(docs["lang"], F.lit("translate"), r["languages"], r["multilingual"])).select("source", "lang", "n", "family").distinct()
    return fit.groupBy("source", "family").agg(F.sum("n").alias("documents"))


P12 = f"""SELECT source, family, sum(n)::BIGINT AS documents FROM (SELECT DISTINCT source, lang, n, family FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
JOIN ({_REGISTRY}) ON multilingual AND (lang IS NULL OR lang = '' OR list_contains(string_split(languages, ','), lang))) GROUP BY ALL"""


def a10(spark, d):
    """Available models: users as models, those without an error in their events are available."""
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg((F.count_if(F.col("event_type") == "error") == 0).alias("available"))
    return M.available_count(users)


A10 = "SELECT count(*) FILTER (WHERE bad = 0) AS available FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)"

QUERIES = {"s15_registry": s15, "p06_guard": p06, "p12_families": p12, "a10_available": a10}
ORACLE = {"s15_registry": S15, "p06_guard": P06, "p12_families": P12, "a10_available": A10}
