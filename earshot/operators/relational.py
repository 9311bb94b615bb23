"""Filters, joins, aggregates, windows, orderings and set operations of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import RESULT_SQL, result_rows, table
from ..schemas import RESULT, RESULT_COLUMNS, TEXT_COLUMNS

# ------------------------------------------------------------------ operators


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal key the last by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_last")).select(key, "_last.*")


def attach_references(audio: DataFrame, transcripts: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Left joins by id: the transcript, else (missing or empty) the sidecar, else blank.

    ``audio``: id, ...; ``transcripts``: id, reference, ordinal (the last one wins);
    ``sidecars``: id, side.  No side is broadcast by hint; Spark decides by size."""
    found = audio.join(latest_by(transcripts, "id", "ordinal").select("id", "reference"), "id", "left")
    if sidecars is not None:
        found = found.join(sidecars, "id", "left").withColumn("reference", F.coalesce(F.nullif("reference", F.lit("")), "side")).drop("side")
    return found.withColumn("reference", F.coalesce("reference", F.lit("")))


def progress(stages: DataFrame) -> DataFrame:
    """Completed tasks over all tasks of the active stages (active, completed, tasks)."""
    x = stages.filter("active").agg(F.sum("completed").alias("completed"), F.sum("tasks").alias("tasks"))
    return x.select("completed", "tasks", F.round(F.try_divide("completed", "tasks"), 6).alias("share"))


def numbered(df: DataFrame, key: str, order: str, width: int = 1 << 16) -> DataFrame:
    """Adds rn, the place of a row among those of its key by a whole-number column.

    Ranges of ``width`` values are sorted apart and their sizes added up, so no task sorts
    a whole key, however hot."""
    x = df.withColumn("_range", F.expr(f"`{order}` div {width}"))
    x = x.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    sizes = x.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_k", "_r", before.alias("_before"))
    met = x.join(sizes, F.col(key).eqNullSafe(F.col("_k")) & F.col("_range").eqNullSafe(F.col("_r")))
    return met.select(*df.columns, (F.col("_at") + F.col("_before")).alias("rn"))


def with_nan_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    kinds = dict(df.dtypes)
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def number(c: Column) -> Column:
    return c.try_cast("double")


def run_label(engine: Column, threads: Column, workers: Column) -> Column:
    return F.when(engine == "spark", F.format_string("Spark ×%d", workers)).when(threads > 1, F.format_string("Single-node (%d threads)", threads)).otherwise("Single-node")


def snr_label(snr: Column) -> Column:
    return F.when(snr.isNull(), "clean").otherwise(F.concat(F.regexp_replace(snr.cast("string"), r"\.0$", ""), F.lit(" dB")))


def relative_runs(runs: DataFrame) -> DataFrame:
    """Speed-up against the first run and against Spark with one worker, and efficiency.

    ``runs``: run_no, engine, workers, wall_s - one row a configuration."""
    every = Window.partitionBy(F.lit(0)).orderBy("run_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.when(F.col("engine") != "spark", F.col("wall_s")), ignorenulls=True).over(every)
    one = F.first(F.when((F.col("engine") == "spark") & (F.col("workers") == 1), F.col("wall_s")), ignorenulls=True).over(every)
    x = runs.withColumn("_b", base).withColumn("_o", one)
    return x.select(
        *runs.columns, F.bround(F.try_divide("_b", "wall_s"), 3).alias("speedup_vs_single"), F.bround(F.try_divide("_o", "wall_s"), 3).alias("speedup_vs_spark1"),
        F.when(F.col("engine") == "spark", F.bround(F.try_divide("_o", "wall_s") / F.col("workers"), 3)).alias("efficiency"),
        F.when(F.col("engine") == "spark", F.bround(F.try_divide("_b", "_o") * F.col("workers"), 3)).alias("ideal"),
    )


def worker_counts(n: Column) -> Column:
    """1, 2, 4, ... up to n, and n."""
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.array_union(powers, F.array(n.cast("int")))


def queue_position(jobs: DataFrame, lane: str, order: str) -> DataFrame:
    """How many open jobs of the lane stand before each; one sort per lane."""
    before = Window.partitionBy(lane).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return jobs.withColumn("ahead", F.coalesce(F.sum(F.col("open").cast("int")).over(before), F.lit(0)).cast("long"))


def mode_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, ties to the least; two-step so that no key is hot."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


# -------------------------------------------------------------------- queries


def p01(spark, d):
    """Manifest projection: four string columns without nulls."""
    t = table(spark, d, "documents")
    return t.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("doc_id", "id"), ("source", "path"), ("lang", "language"))], F.md5(F.coalesce("text", F.lit(""))).alias("reference"))


P01 = "SELECT coalesce(doc_id::VARCHAR, '') AS id, coalesce(source, '') AS path, coalesce(lang, '') AS language, md5(coalesce(text, '')) AS reference FROM documents"


def p02(spark, d):
    """The twenty result columns: what the manifest gives, an empty hypothesis, else nulls."""
    t = table(spark, d, "conversations")
    given = {"id": F.concat_ws("-", "conv_id", "turn"), "path": F.lit("x.wav"), "reference": F.md5(F.coalesce("text", F.lit(""))), "hypothesis": F.lit("")}
    return t.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT.fields])


_EMPTY = ", ".join(f"NULL::{'VARCHAR' if c in TEXT_COLUMNS else 'DOUBLE'} AS {c}" for c in RESULT_COLUMNS[4:])
P02 = f"SELECT conv_id || '-' || turn AS id, 'x.wav' AS path, md5(coalesce(text, '')) AS reference, '' AS hypothesis, {_EMPTY} FROM conversations"


def p03(spark, d):
    return result_rows(spark, d).filter(F.col("error").isNull())


P03 = f"SELECT * FROM ({RESULT_SQL}) WHERE error IS NULL"


def p04(spark, d):
    return table(spark, d, "conversations").filter(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


P04 = "SELECT role, count(*) AS n FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY role"


def p09(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.when(F.col("lang").isin("en", "es", "ja"), F.col("lang")).alias("language"))


P09 = "SELECT doc_id, CASE WHEN lang IN ('en', 'es', 'ja') THEN lang END AS language FROM documents"


def p14(spark, d):
    t = table(spark, d, "lineitem")
    kind = F.when(F.col("l_discount") > 0.05, "bad").when(F.col("l_discount") == 0, "good").otherwise("fair")
    return t.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


P14 = "SELECT CASE WHEN l_discount > 0.05 THEN 'bad' WHEN l_discount = 0 THEN 'good' ELSE 'fair' END AS class, count(*) AS n FROM lineitem GROUP BY 1"


def p15(spark, d):
    return table(spark, d, "orders").agg(F.coalesce(F.bool_or(F.col("o_orderstatus").isin("O", "P")), F.lit(False)).alias("busy"))


P15 = "SELECT coalesce(bool_or(o_orderstatus IN ('O', 'P')), false) AS busy FROM orders"


def p17(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.04, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))
    return with_nan_null(t)


P17 = "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= 0.04 THEN l_tax END AS tax FROM lineitem"


def p18(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", number(F.substring("source", 4, 9)).alias("from_source"), number(F.col("lang")).alias("from_lang"))


P18 = "SELECT doc_id, try_cast(substr(source, 4, 9) AS DOUBLE) AS from_source, try_cast(lang AS DOUBLE) AS from_lang FROM documents"


def p19(spark, d):
    t = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return t.select("s_suppkey", run_label(F.when(k % 3 == 0, "spark").otherwise("local"), (k % 2 + 1).cast("int"), (k % 8 + 1).cast("int")).alias("label"))


P19 = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Spark ×' || (s_suppkey % 8 + 1) WHEN s_suppkey % 2 + 1 > 1 THEN 'Single-node (' || (s_suppkey % 2 + 1) || ' threads)' ELSE 'Single-node' END AS label FROM supplier"""


def p20(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", snr_label(F.when(F.col("p_size") > 5, F.col("p_size").cast("double"))).alias("label"))


P20 = "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size || ' dB' ELSE 'clean' END AS label FROM part"


def j01(spark, d):
    """Transcript join: the last label of a document wins; blanks where there is none."""
    audio = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("reference"), F.struct("quality", "toxic").alias("ordinal"))
    return attach_references(audio, refs)


J01 = """SELECT doc_id AS id, lang, coalesce(reference, '') AS reference FROM documents LEFT JOIN
  (SELECT doc_id, arg_max(quality::VARCHAR, quality * 10 + toxic) AS reference FROM labels GROUP BY doc_id) USING (doc_id)"""


def j02(spark, d):
    """Transcript, else sidecar (also when the transcript is empty), else blank."""
    audio = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("").alias("reference"), F.col("quality").alias("ordinal"))
    side = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("role").alias("side"))
    return attach_references(audio, refs, side)


J02 = """SELECT d.doc_id AS id, coalesce(nullif(r.reference, ''), s.side, '') AS reference FROM documents d
  LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'good' ELSE '' END AS reference FROM labels GROUP BY doc_id) r ON r.doc_id = d.doc_id
  LEFT JOIN (SELECT conv_id, max(role) AS side FROM conversations GROUP BY conv_id) s ON s.conv_id = d.doc_id"""


def j04(spark, d):
    """Documents that have a label (semi) and how many have none (anti)."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    yes = docs.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("with_label"))
    no = docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("without_label"))
    return yes.join(no, "lang", "full")


J04 = """SELECT lang, nullif(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)), 0) AS with_label,
  nullif(count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 0) AS without_label FROM documents GROUP BY lang"""


def j06(spark, d):
    """Positional zip of two arrays."""
    e = table(spark, d, "embeddings")
    z = F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    return e.select("vec_id", F.bround(F.aggregate(z, F.lit(0.0), lambda acc, p: acc + p["a"].cast("double") * p["b"].cast("double")), 6).alias("folded"))


J06 = "SELECT vec_id, round_even(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS folded FROM embeddings"


def j07(spark, d):
    """Scatter turns to chunks and gather them back in order, skipping blanks."""
    c = table(spark, d, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"])
    joined = c.groupBy("conv_id").agg(F.array_join(F.filter(ordered, lambda t: t != ""), " ").alias("x"))
    return joined.select("conv_id", F.md5("x").alias("digest"))


J07 = "SELECT conv_id, md5(coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> ''), '')) AS digest FROM conversations GROUP BY conv_id"


def j09(spark, d):
    """Dimension lookup: customers with nation and region."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return x.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


J09 = "SELECT r_name, n_name, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


def j10(spark, d):
    """Every turn at every noise level, in one plan: the levels are an array of five."""
    c = table(spark, d, "conversations")
    levels = F.array(*[F.lit(x).cast("double") for x in (None, 20, 10, 5, 0)])
    x = c.select("role", F.length("text").alias("n"), F.explode(levels).alias("snr_db"))
    return x.groupBy(snr_label(F.col("snr_db")).alias("label")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chars"))


J10 = """SELECT CASE WHEN snr IS NULL THEN 'clean' ELSE snr || ' dB' END AS label, count(*) AS files, sum(length(text))::BIGINT AS chars
FROM conversations, (VALUES (NULL), (20), (10), (5), (0)) t(snr) GROUP BY 1"""


def j12(spark, d):
    """Open orders of the same customer placed before each order."""
    o = table(spark, d, "orders").withColumn("open", F.col("o_orderstatus") == "O").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return queue_position(o, "o_custkey", "at").select("o_orderkey", "ahead")


J12 = """SELECT o_orderkey, coalesce(sum((o_orderstatus = 'O')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM orders"""


def a03(spark, d):
    """Rows by language, nulls dropped, as one map."""
    n = result_rows(spark, d).filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n"))))).alias("detected"))


A03 = f"SELECT '{{' || string_agg('\"' || language || '\":' || n, ',' ORDER BY language) || '}}' AS detected FROM (SELECT language, count(*) AS n FROM ({RESULT_SQL}) WHERE language IS NOT NULL GROUP BY 1)"


def a05(spark, d):
    n = result_rows(spark, d).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    return n.select("worker", "n", F.bround(F.col("n") / n.agg(F.max("n")).scalar(), 6).alias("share"))


A05 = f"SELECT worker, n, round_even(n / max(n) OVER (), 6) AS share FROM (SELECT worker, count(*) AS n FROM ({RESULT_SQL}) GROUP BY 1)"


def a06(spark, d):
    return mode_share(table(spark, d, "documents"), "source", "lang")


A06 = """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE k = 1"""


def a08(spark, d):
    """Dataset catalog: count and sorted languages of every source."""
    t = table(spark, d, "documents")
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("en"))
    return t.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_set(lang)), ",").alias("languages"))


A08 = "SELECT source AS name, count(*) AS count, string_agg(DISTINCT coalesce(nullif(lang, ''), 'en'), ',' ORDER BY coalesce(nullif(lang, ''), 'en')) AS languages FROM documents GROUP BY 1"


def a09(spark, d):
    return a08(spark, d).agg(F.sum("count").alias("files"), F.count_if(F.contains("languages", F.lit("fr"))).alias("with_french"))


A09 = f"SELECT sum(count)::BIGINT AS files, count(*) FILTER (WHERE contains(languages, 'fr')) AS with_french FROM ({A08})"


def a15(spark, d):
    """Mean time of each batch of eight, on every row of it."""
    r = result_rows(spark, d).withColumn("batch", F.floor(F.col("id") / 8))
    return r.select("id", F.bround(F.avg("infer_s").over(Window.partitionBy("batch")), 9).alias("batch_mean"))


A15 = f"SELECT id, round_even(avg(infer_s) OVER (PARTITION BY id // 8), 9) AS batch_mean FROM ({RESULT_SQL})"


def a18(spark, d):
    r = result_rows(spark, d)
    return r.agg(F.max("duration_s").alias("most_audio"), F.max(F.greatest("duration_s", "infer_s")).alias("most_any"))


A18 = f"SELECT max(duration_s) AS most_audio, max(greatest(duration_s, infer_s)) AS most_any FROM ({RESULT_SQL})"


def w04(spark, d):
    """Benchmark derivations over runs: one for each nation's suppliers."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("b"))
    k = F.col("s_nationkey")
    runs = s.select(k.alias("run_no"), F.when(k == 0, "local").otherwise("spark").alias("engine"), F.greatest(k, F.lit(1)).alias("workers"), (F.abs("b") + 1).alias("wall_s"))
    return relative_runs(runs)


W04 = """WITH runs AS (SELECT s_nationkey AS run_no, CASE WHEN s_nationkey = 0 THEN 'local' ELSE 'spark' END AS engine, greatest(s_nationkey, 1) AS workers, abs(sum(s_acctbal)) + 1 AS wall_s FROM supplier GROUP BY 1, 2, 3),
b AS (SELECT arg_min(wall_s, run_no) FILTER (WHERE engine <> 'spark') AS base, arg_min(wall_s, run_no) FILTER (WHERE engine = 'spark' AND workers = 1) AS one FROM runs)
SELECT run_no, engine, workers, wall_s, round_even(base / wall_s, 3) AS speedup_vs_single, round_even(one / wall_s, 3) AS speedup_vs_spark1,
  CASE WHEN engine = 'spark' THEN round_even(one / wall_s / workers, 3) END AS efficiency, CASE WHEN engine = 'spark' THEN round_even(base / one * workers, 3) END AS ideal FROM runs, b"""


def w06(spark, d):
    """Batches of eight in each source, by id."""
    x = numbered(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")
    return x.select("doc_id", F.expr("(rn - 1) div 8").alias("batch"))


W06 = "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents"


def o01(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(25).select("doc_id", "source")


O01 = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25"


def o03(spark, d):
    """Newest result of every kind."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


O03 = "SELECT event_type AS kind, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1"


def o05(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_totalprice")


O05 = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5"


def o09(spark, d):
    """Worker counts to test for every machine size."""
    return table(spark, d, "part").select("p_partkey", F.array_join(worker_counts(F.col("p_size")), ",").alias("counts"))


O09 = """SELECT p_partkey, array_to_string(CASE WHEN list_contains(c, p_size) THEN c ELSE c || [p_size] END, ',') AS counts FROM (
  SELECT p_partkey, p_size, list_transform(range(0, floor(log2(p_size))::BIGINT + 1), lambda k: (2 ** k)::INT) AS c FROM part)"""


def u01(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return a.unionByName(b).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"))


U01 = "SELECT kind, nation, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1, 2"


def u02(spark, d):
    """Distinct roles of a conversation in order of first use."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


U02 = "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1"


def u03(spark, d):
    """Union of two key-value sources, the second winning."""
    a = table(spark, d, "documents").select("doc_id", F.col("lang").alias("v"), F.lit(0).alias("o"))
    b = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("v"), F.lit(1).alias("o"))
    return latest_by(a.unionByName(b), "doc_id", "o").select("doc_id", "v")


U03 = "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE lang END AS v FROM documents"


def u04(spark, d):
    """Whether every label has its document."""
    missing = table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    return missing.agg((F.count(F.lit(1)) == 0).alias("complete"))


U04 = "SELECT count(*) = 0 AS complete FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"


def u05(spark, d):
    """Partition each conversation by role and put the turns back in order."""
    group = F.struct("turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    parts = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(group)).alias("part"))
    # What a group yields carries its place, by which the groups interleave again.
    done = parts.select("conv_id", F.transform("part", lambda t, i: F.struct(t["turn"].alias("turn"), F.concat_ws(":", t["role"], i.cast("string"), t["digest"]).alias("out"))).alias("part"))
    back = done.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("turns"))
    return back.select("conv_id", F.md5(F.array_join(F.transform("turns", lambda t: t["out"]), ",")).alias("outputs"))


U05 = """SELECT conv_id, md5(string_agg(role || ':' || place || ':' || md5(coalesce(text, '')), ',' ORDER BY turn)) AS outputs
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place FROM conversations) GROUP BY 1"""

_NAMES = {
    "p01_manifest_projection": "p01", "p02_row_template": "p02", "p03_successful": "p03", "p04_scorable": "p04", "p09_language_whitelist": "p09", "p14_classes": "p14", "p15_busy": "p15",
    "p17_nan_null": "p17", "p18_numbers": "p18", "p19_run_label": "p19", "p20_snr_label": "p20", "j01_transcripts": "j01", "j02_sidecars": "j02", "j04_semi_anti": "j04", "j06_zip": "j06",
    "j07_gather": "j07", "j09_lookup": "j09", "j10_levels": "j10", "j12_queue": "j12", "a03_language_map": "a03", "a05_worker_share": "a05", "a06_mode": "a06", "a08_catalog": "a08",
    "a09_totals": "a09", "a15_batch_mean": "a15", "a18_scales": "a18", "w04_speedups": "w04", "w06_batches": "w06", "o01_first": "o01", "o03_newest": "o03", "o05_latest": "o05",
    "o09_worker_counts": "o09", "u01_union": "u01", "u02_distinct_order": "u02", "u03_last_wins": "u03", "u04_complete": "u04", "u05_interleave": "u05",
}
QUERIES = {k: globals()[v] for k, v in _NAMES.items()}
ORACLE = {k: globals()[v.upper()] for k, v in _NAMES.items()}
