"""Scoring: edit counts, error rates and their corpus totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editdistance as E
from ..functions import text as X
from ..plans.tables import RESULT_SQL, result_rows, spread, table
from .text_queries import english_sql


def score_language(ref_language: Column, requested: Column, detected: Column, task: Column) -> Column:
    """Language to score in: English for translations, else the first that is known."""
    known = lambda c: F.nullif(c, F.lit(""))
    return F.when(task == "translate", "en").otherwise(F.coalesce(known(ref_language), known(requested), known(detected), F.lit("en")))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Adds words (edit counts), char_errors, char_n, wer and cer to rows with
    reference, hypothesis and language; texts are normalised and counted once."""
    lang = F.col("language")
    x = pairs.withColumn("_r", X.normalize(X.nfkc(F.col("reference")), lang)).withColumn("_h", X.normalize(X.nfkc(F.coalesce("hypothesis", F.lit(""))), lang))
    x = x.withColumn("words", E.edit_ops(X.tokens(F.col("_r"), lang), X.tokens(F.col("_h"), lang)))
    x = x.withColumn("char_errors", E.char_errors(F.col("_r"), F.col("_h")).cast("long")).withColumn("char_n", F.char_length("_r").cast("long"))
    return x.withColumn("wer", E.rate(F.col("words.errors"), F.col("words.N"))).withColumn("cer", E.rate(F.col("char_errors"), F.col("char_n"))).drop("_r", "_h")


def scorable() -> Column:
    return X.strip(F.coalesce("reference", F.lit(""))) != ""


def corpus_totals() -> list[Column]:
    """Aggregates over scored rows: errors by reference tokens, null without tokens."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return [
        F.try_divide(F.sum("words.errors"), F.sum("words.N")).alias("wer"), F.try_divide(F.sum("char_errors"), F.sum("char_n")).alias("cer"),
        total("words.S", "substitutions"), total("words.D", "deletions"), total("words.I", "insertions"), total("words.N", "ref_words"), total("char_n", "ref_chars"),
    ]


def corpus_scores(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(*corpus_totals())


def corrupted(words: Column) -> Column:
    """A hypothesis from reference words: some dropped, some replaced, some doubled."""
    def change(t, i):
        return F.when(i % 7 == 3, F.array().cast("array<string>")).when(i % 11 == 5, F.array(F.lit("zzz"))).when(i % 13 == 6, F.array(t, t)).otherwise(F.array(t))

    return F.flatten(F.transform(words, change))


#: Turns and documents of one task: comparing texts costs the square of their length, reading them next to nothing.
TURNS_A_TASK, DOCUMENTS_A_TASK = 20_000, 4_000


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a reference with a corrupted hypothesis; language by conversation."""
    c = spread(table(spark, sf_dir, "conversations"), TURNS_A_TASK)
    words = X.tokens(F.col("text"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("reference"), F.array_join(corrupted(words), " ").alias("hypothesis"), F.lit("en").alias("language"))


def benchmark_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over benchmark items, by length."""
    b = spread(table(spark, sf_dir, "benchmark"))
    words = X.tokens(F.col("text"))
    group = F.when(F.length("text") > 250, "long").otherwise("short")
    return b.select("item_id", group.alias("class"), F.col("text").alias("reference"), F.array_join(corrupted(words), " ").alias("hypothesis"), F.lit("en").alias("language"))


UTTERANCES_SQL = r"""utterances AS (
  SELECT conv_id, turn, role, text AS reference, array_to_string(flatten(list_transform(w, lambda t, i:
    CASE WHEN (i - 1) % 7 = 3 THEN [] WHEN (i - 1) % 11 = 5 THEN ['zzz'] WHEN (i - 1) % 13 = 6 THEN [t, t] ELSE [t] END)), ' ') AS hypothesis
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM conversations))"""

CELL = "struct_pack(c := {c}, s := {s}, d := {d}, i := {i})"


def edit_sql(source: str, keys: str) -> str:
    """Edit counts by a recursive table: one step a reference token, each folding the
    row of the table over the hypothesis. ``source``: keys, r, h (token lists)."""
    same = "acc || [row[x]]"
    pick = """acc || [CASE WHEN row[x].c <= row[x + 1].c AND row[x].c <= acc[-1].c THEN struct_pack(c := row[x].c + 1, s := row[x].s + 1, d := row[x].d, i := row[x].i)
        WHEN row[x + 1].c <= acc[-1].c THEN struct_pack(c := row[x + 1].c + 1, s := row[x + 1].s, d := row[x + 1].d + 1, i := row[x + 1].i)
        ELSE struct_pack(c := acc[-1].c + 1, s := acc[-1].s, d := acc[-1].d, i := acc[-1].i + 1) END]"""
    fold = f"""list_reduce(list_transform(range(1, len(h) + 1), lambda x: [struct_pack(c := x, s := 0::BIGINT, d := 0::BIGINT, i := 0::BIGINT)]),
      lambda acc, y: list_transform([y[1].c], lambda x: CASE WHEN r[n + 1] = h[x] THEN {same} ELSE {pick} END)[1],
      [struct_pack(c := n + 1, s := 0::BIGINT, d := n + 1, i := 0::BIGINT)])"""
    return f"""tabled AS (
  SELECT {keys}, r, h, 0::BIGINT AS n, list_transform(range(0, len(h) + 1), lambda j: struct_pack(c := j, s := 0::BIGINT, d := 0::BIGINT, i := j)) AS row FROM {source}
  UNION ALL SELECT {keys}, r, h, n + 1, {fold} FROM tabled WHERE n < len(r)),
edits AS (SELECT {keys}, row[-1].c AS errors, row[-1].s AS "S", row[-1].d AS "D", row[-1].i AS "I", len(r)::BIGINT AS "N" FROM tabled WHERE n = len(r))"""


ITEMS_SQL = UTTERANCES_SQL.replace("conv_id, turn, role,", "item_id, CASE WHEN length(text) > 250 THEN 'long' ELSE 'short' END AS class,").replace("conversations", "benchmark")

PAIRS_SQL = f"""WITH RECURSIVE {ITEMS_SQL},
normal AS (SELECT item_id, class, reference, {english_sql('reference')} AS rn, {english_sql('hypothesis')} AS hn FROM utterances),
pairs AS (SELECT item_id, list_filter(string_split(rn, ' '), lambda t: t <> '') AS r, list_filter(string_split(hn, ' '), lambda t: t <> '') AS h FROM normal),
{edit_sql('pairs', 'item_id')}"""


def e01(spark, d):
    x = scored_pairs(benchmark_utterances(spark, d))
    return x.select("item_id", *[F.col(f"words.{k}").alias(k) for k in ("errors", "S", "D", "I", "N", "H")], F.bround("wer", 4).alias("wer"))


E01 = f"""{PAIRS_SQL} SELECT item_id, errors, "S", "D", "I", "N", "N" - "S" - "D" AS "H",
  CASE WHEN "N" > 0 THEN round_even(errors / "N", 4) ELSE (errors > 0)::INT::DOUBLE END AS wer FROM edits"""


def e04(spark, d):
    return scored_pairs(utterances(spark, d)).select("conv_id", "turn", "char_errors", "char_n", F.bround("cer", 4).alias("cer"))


E04 = f"""WITH {UTTERANCES_SQL}, normal AS (SELECT conv_id, turn, {english_sql('reference')} AS rn, {english_sql('hypothesis')} AS hn FROM utterances)
SELECT conv_id, turn, levenshtein(rn, hn)::BIGINT AS char_errors, length(rn)::BIGINT AS char_n,
  CASE WHEN length(rn) > 0 THEN round_even(levenshtein(rn, hn) / length(rn), 4) ELSE (length(hn) > 0)::INT::DOUBLE END AS cer FROM normal"""


def a02(spark, d):
    """Corpus rates of benchmark items by length: the flagship query."""
    return corpus_scores(scored_pairs(benchmark_utterances(spark, d).filter(scorable())), "class")


def a02_conversations(spark, d):
    """Corpus rates of conversations by role (SQL takes minutes on these; tested by brute force)."""
    return corpus_scores(scored_pairs(utterances(spark, d).filter(scorable())), "role")


A02 = f"""{PAIRS_SQL} SELECT class, sum(errors) / sum("N") AS wer, sum(levenshtein(rn, hn)) / sum(length(rn)) AS cer, sum("S")::BIGINT AS substitutions,
  sum("D")::BIGINT AS deletions, sum("I")::BIGINT AS insertions, sum("N")::BIGINT AS ref_words, sum(length(rn))::BIGINT AS ref_chars
FROM edits JOIN normal USING (item_id) WHERE trim(reference) <> '' GROUP BY class"""


def a02_documents(spark, d):
    """Word error rate of whole documents by language (SQL can't hold tables of this
    size; tested by brute force)."""
    x = spread(table(spark, d, "documents").select("lang", "text"), DOCUMENTS_A_TASK)
    words = X.tokens(X.normalize(X.nfkc(F.col("text")), F.col("lang")), F.col("lang"))
    x = x.select("lang", words.alias("r")).select("lang", E.token_errors(F.col("r"), corrupted(F.col("r"))).alias("errors"), F.greatest(F.size("r"), F.lit(0)).cast("long").alias("n"))
    return x.groupBy("lang").agg(F.try_divide(F.sum("errors"), F.sum("n")).alias("wer"), F.sum("n").alias("ref_words"))


def e06(spark, d):
    """Operations of all alignments, counted."""
    u = utterances(spark, d)
    r, h = (X.tokens(X.normalize(F.col(c), F.lit("en"))) for c in ("reference", "hypothesis"))
    return u.select("role", F.inline(E.alignment(r, h))).groupBy("role", "op").agg(F.count(F.lit(1)).alias("n"))


def p05(spark, d):
    """Scoring language of every document, with holes in each of its sources, and the unit."""
    x = table(spark, d, "documents")
    i = F.col("doc_id")
    lang = score_language(F.when(i % 5 != 0, F.col("lang")), F.when(i % 3 == 0, "ja"), F.when(i % 2 == 0, "zh"), F.when(i % 11 == 0, "translate").otherwise("transcribe"))
    return x.select("doc_id", lang.alias("score_language"), X.unit_label(lang).alias("unit"))


P05 = """SELECT *, CASE WHEN score_language IN ('ja', 'zh') THEN 'char' ELSE 'word' END AS unit FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'en' ELSE coalesce(CASE WHEN doc_id % 5 <> 0 THEN nullif(lang, '') END,
  CASE WHEN doc_id % 3 = 0 THEN 'ja' END, CASE WHEN doc_id % 2 = 0 THEN 'zh' END, 'en') END AS score_language FROM documents)"""


def a01(spark, d):
    """Run summary: times over rows without errors, counts over all rows."""
    return run_summary(result_rows(spark, d), 60.0).withColumn("detected_languages", F.to_json("detected_languages"))


def run_totals(wall_s: float) -> list[Column]:
    """Aggregates over result rows (id, duration_s, preprocess_s, infer_s, model_load_s, worker, error)."""
    good = F.col("error").isNull()
    seconds = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0.0))
    n, wall = F.count(F.lit(1)), F.lit(float(wall_s))
    return [
        n.alias("files"), F.count_if(~good).alias("failed"), F.bround(seconds("duration_s"), 2).alias("audio_s"), F.bround(F.try_divide(n, wall), 3).alias("files_per_s"),
        F.bround(F.try_divide(seconds("duration_s"), wall), 3).alias("rtfx"), F.bround(seconds("preprocess_s"), 3).alias("preprocess_s_total"), F.bround(seconds("infer_s"), 3).alias("infer_s_total"),
        F.bround(F.coalesce(F.sum("model_load_s"), F.lit(0.0)), 3).alias("model_load_s_total"), F.countDistinct("worker").alias("distinct_workers"),
    ]


def detected_languages(rows: DataFrame, *keys: str) -> DataFrame:
    """Files without error by detected language, as one map, by keys if any."""
    each = rows.filter("error is null and language is not null").groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("detected_languages"))


def run_summary(rows: DataFrame, wall_s: float, *keys: str, more: list[Column] | None = None) -> DataFrame:
    """Totals of a run and its detected languages, by keys if any; one row without keys."""
    further = more or []
    totals, found = rows.groupBy(*keys).agg(*run_totals(wall_s), *further), detected_languages(rows, *keys)
    named = found.toDF(*[f"_{k}" for k in keys], "detected_languages")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    # Without keys both sides are one row.
    out = totals.join(named, same, "left") if keys else totals.crossJoin(named)
    nothing = F.expr("cast(map() as map<string, bigint>)")
    return out.select(*totals.columns, F.coalesce("detected_languages", nothing).alias("detected_languages"))


A01 = f"""WITH r AS ({RESULT_SQL})
SELECT count(*) AS files, count(*) FILTER (WHERE error IS NOT NULL) AS failed, round_even(sum(duration_s) FILTER (WHERE error IS NULL), 2) AS audio_s,
  round_even(count(*) / 60.0, 3) AS files_per_s, round_even(sum(duration_s) FILTER (WHERE error IS NULL) / 60.0, 3) AS rtfx,
  round_even(sum(preprocess_s) FILTER (WHERE error IS NULL), 3) AS preprocess_s_total, round_even(sum(infer_s) FILTER (WHERE error IS NULL), 3) AS infer_s_total,
  round_even(sum(model_load_s), 3) AS model_load_s_total, count(DISTINCT worker) AS distinct_workers,
  (SELECT '{{' || string_agg('"' || language || '":' || n, ',' ORDER BY language) || '}}' FROM (SELECT language, count(*) AS n FROM r WHERE error IS NULL AND language IS NOT NULL GROUP BY 1)) AS detected_languages FROM r"""


def e08(spark, d):
    """Half-even rounding to four places."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 32, 4).alias("rate"))


E08 = "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 32, 4) AS rate FROM lineitem"


def e09(spark, d):
    """Audio seconds by processing second of every worker; null where it took no time."""
    r = result_rows(spark, d)
    return r.groupBy("worker").agg(F.bround(F.try_divide(F.sum("duration_s"), F.sum("infer_s")), 3).alias("rtfx"), F.count(F.lit(1)).alias("files"))


E09 = f"SELECT worker, round_even(sum(duration_s) / nullif(sum(infer_s), 0), 3) AS rtfx, count(*) AS files FROM ({RESULT_SQL}) GROUP BY worker"

QUERIES = {
    "e01_edit_ops": e01, "e04_cer": e04, "a02_corpus_scores": a02, "a02_conversations": a02_conversations, "a02_documents": a02_documents, "e06_alignment_ops": e06, "p05_score_language": p05,
    "a01_run_summary": a01, "e08_half_even": e08, "e09_rtfx": e09,
}
ORACLE = {"e01_edit_ops": E01, "e04_cer": E04, "a02_corpus_scores": A02, "p05_score_language": P05, "a01_run_summary": A01, "e08_half_even": E08, "e09_rtfx": E09}
