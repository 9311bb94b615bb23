"""Sources, sinks, signal stages and batch plans as queries over the input tables."""

from __future__ import annotations

from collections.abc import Iterator
from glob import glob

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import editdistance as E
from ..functions import readings as R
from ..functions import signal as G
from ..functions import text as X
from ..plans import transcribe
from ..plans.tables import RESULT_SQL, result_rows, scratch, spread, table
from ..sources import archives, fixtures, readers, sinks, splits, writers
from ..sources.decode import decode
from .relational import W04, progress, relative_runs, snr_label
from .scoring import corpus_totals
from .signal_queries import BANK, Y, _waves

# ------------------------------------------------------------------ sources and sinks


def s01(spark, d):
    """A manifest of documents: ids missing, paths relative and absolute, blanks around."""
    x = table(spark, d, "documents")
    i = F.col("doc_id")
    raw = x.select(
        F.when(i % 3 != 0, i.cast("string")).alias("id"), F.concat(F.when(i % 2 == 0, "/data/").otherwise("deep/"), F.concat(i.cast("string"), F.lit(".wav"))).alias("path"),
        F.concat(F.lit("  "), F.col("source"), F.lit(" ")).alias("reference"), F.when(i % 5 != 0, F.col("lang")).alias("language"), F.lit("file:///root/set/manifest.csv").alias("_at"),
    )
    return readers.manifest_rows(raw)


S01 = """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN '/data/' ELSE '/root/set/deep/' END || doc_id || '.wav' AS path,
  coalesce(trim(source), '') AS reference, CASE WHEN doc_id % 5 <> 0 THEN coalesce(lang, '') ELSE '' END AS language FROM documents"""


def s03(spark, d):
    """Lines of all documents as transcript lines: those with a blank, split at the first."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    found = readers.transcript_lines(lines)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("id")).alias("keys"), F.sum(F.length("reference")).alias("texts"))


S03 = """SELECT doc_id, count(*) AS n, sum(instr(v, ' ') - 1)::BIGINT AS keys, sum(length(v) - instr(v, ' '))::BIGINT AS texts
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents) WHERE instr(v, ' ') > 0 GROUP BY 1"""


def s04(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip(F.concat(F.lit(" \n\t"), "url", F.lit("\r\n ")))).alias("side"))


S04 = "SELECT page_id, md5(trim(url)) AS side FROM pages"


def s05(spark, d):
    """Nested audio columns."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.struct(F.encode("text", "utf-8").alias("bytes"), F.col("source").alias("path")).alias("audio"))
    return readers.nested_audio(x).select("id", "path", F.md5("content").alias("content"), F.length("reference").cast("long").alias("characters"))


S05 = "SELECT doc_id::VARCHAR AS id, source AS path, md5(text) AS content, length(text)::BIGINT AS characters FROM documents"


def s07(spark, d):
    """Tab-separated lines, some too short."""
    i = F.col("p_partkey")
    line = F.when(i % 4 == 0, F.concat_ws("\t", i, "p_name")).otherwise(F.concat_ws("\t", i, "p_name", "p_brand", "p_type"))
    return readers.tsv_rows(table(spark, d, "part").select(line.alias("value")))


S07 = "SELECT p_name AS name, p_brand AS reference FROM part WHERE p_partkey % 4 <> 0"


def s08(spark, d):
    """Vectors written as WAV bytes and decoded again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [decode(writers.wav_bytes(np.array(y))) for y in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(y) for y, _ in back]), pa.array([r for _, r in back]), pa.array([round(float(y.sum() * 32768)) for y, _ in back])], ["vec_id", "n", "rate", "total"])

    return _waves(spark, d).mapInArrow(work, "vec_id long, n long, rate long, total long")


S08 = f"SELECT vec_id, len(y)::BIGINT AS n, 16000::BIGINT AS rate, list_sum(list_transform(y, lambda v: trunc(greatest(-1, least(1, v)) * 32767)::BIGINT))::BIGINT AS total FROM ({Y})"


#: Documents of one archive: an archive is written, and read, by one task.
DOCUMENTS_AN_ARCHIVE = 10_000


def _speech_tars(spark, d):
    """Documents as archives in the order of their ids, ten audio members and then their transcripts; every
    seventh has none.  Returns the archives' paths."""
    n = max(4, -(-table(spark, d, "documents").count() // DOCUMENTS_AN_ARCHIVE))
    x = table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"), "source")
    i, block = F.col("doc_id"), F.expr("doc_id div 10")
    audio = x.select(i.alias("at"), F.lit(0).alias("kind"), F.concat(F.lit("set/"), i.cast("string"), F.lit(".flac")).alias("member"), "content")
    lines = F.array_join(F.array_sort(F.collect_list(F.when(i % 7 != 0, F.concat_ws(" ", i.cast("string"), "source")))), "\n")
    texts = x.groupBy(block.alias("b")).agg(lines.alias("t"))
    texts = texts.select((F.col("b") * 10 + 9).alias("at"), F.lit(1).alias("kind"), F.concat(F.lit("set/"), F.col("b").cast("string"), F.lit(".trans.txt")).alias("member"), F.encode("t", "utf-8").alias("content"))
    out = scratch(spark, "speech-tars")
    sinks.write_archives(audio.unionByName(texts).repartitionByRange(n, (F.col("at") / 10).cast("long")).sortWithinPartitions("at", "kind"), out)
    return out, ",".join(sorted(glob(f"{out}/part-*.tar")))


def s06(spark, d):
    """The first 25 audio members of archives with their transcripts: scans end behind them."""
    _, paths = _speech_tars(spark, d)
    return readers.read_speech_archive(spark, paths, 25).select("id", F.col("reference"), F.md5("content").alias("content"))


S06 = """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 <> 0 THEN coalesce(source, '') ELSE '' END AS reference, md5(text) AS content
FROM documents ORDER BY doc_id LIMIT 25"""


def s07_archive(spark, d):
    """Audio of archives that a table of references names, found by a Bloom filter and the join."""
    _, paths = _speech_tars(spark, d)
    refs = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".flac")).alias("name"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reference"))
    found = archives.referenced_archive(spark, refs.filter("name not like '%3.flac'"), paths, (".flac",))
    return found.select("id", "path", "reference", F.md5("content").alias("content"))


S07_ARCHIVE = """SELECT doc_id::VARCHAR AS id, doc_id || '.flac' AS path, 'quality ' || max(quality) AS reference, any_value(md5(text)) AS content
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 <> 3 GROUP BY doc_id"""


def s05_splits(spark, d):
    """A published set of three splits read by two of them: files and rows are chosen inside the scan."""
    x = table(spark, d, "documents")
    audio = F.struct(F.encode("text", "utf-8").alias("bytes"), F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".wav").otherwise(".flac")).alias("path"))
    split = F.element_at(F.array(F.lit("clean"), F.lit("noisy"), F.lit("far")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = x.select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("text"), audio.alias("audio"), split.alias("part"))
    root = scratch(spark, "speech-set")
    for part in ("clean", "noisy", "far"):
        rows.filter(F.col("part") == part).drop("part").write.parquet(f"{root}/{part}")
    found = splits.read_splits(spark, root).filter(F.col("split").isin("clean", "far") & F.endswith("path", F.lit(".wav")) | (F.col("split") == "nowhere"))
    kept = splits.read_splits(spark, root).filter(F.col("split").isin("clean", "far")).filter(F.col("path").startswith("clips/1"))
    return kept.select("split", "id", "path", "reference", F.md5("content").alias("content"), F.lit("starts").alias("how")).unionByName(
        found.select("split", "id", "path", "reference", F.md5("content").alias("content"), F.lit("ends").alias("how")))


S05_SPLITS = """WITH x AS (SELECT ['clean', 'noisy', 'far'][doc_id % 3 + 1] AS split, doc_id::VARCHAR AS id, 'clips/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.wav' ELSE '.flac' END AS path,
  source AS reference, md5(text) AS content FROM documents)
SELECT *, 'starts' AS how FROM x WHERE split IN ('clean', 'far') AND starts_with(path, 'clips/1') UNION ALL SELECT *, 'ends' FROM x WHERE split IN ('clean', 'far') AND path LIKE '%.wav'"""


def _uploaded(spark, d):
    """Suppliers as uploaded files: audio, every third with a text beside it; the folder."""
    x = table(spark, d, "supplier")
    audio = x.select(F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".wav").otherwise(".FLAC")).alias("name"), F.encode("s_name", "utf-8").alias("content"))
    texts = x.filter("s_suppkey % 3 = 0").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit(" supplied, by "), "s_name", F.lit("\n")), "utf-8").alias("content"))
    out = scratch(spark, "uploads")
    sinks.save_upload(audio.unionByName(texts), out)
    return out


def s01_file(spark, d):
    """The manifest of an upload read back: ids, paths beside it, references."""
    rows = readers.read_manifest(spark, _uploaded(spark, d) + "/manifest.csv")
    return rows.select("id", F.substring_index("path", "/", -1).alias("file"), F.startswith("path", F.lit("/")).alias("absolute"), "reference", "language")


S01_FILE = """SELECT s_suppkey::VARCHAR AS id, s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.FLAC' END AS file, true AS absolute,
  CASE WHEN s_suppkey % 3 = 0 THEN 'supplied, by ' || s_name ELSE '' END AS reference, '' AS language FROM supplier"""


def s02(spark, d):
    """A folder scan over the uploaded files: what has an audio suffix, with its length; the manifest is none."""
    rows = readers.scan_folder(spark, _uploaded(spark, d))
    return rows.select("id", F.substring_index("path", "/", -1).alias("file"), F.col("length").cast("long").alias("length"), "reference")


S02 = """SELECT s_suppkey::VARCHAR AS id, s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '.FLAC' END AS file, strlen(s_name)::BIGINT AS length, '' AS reference FROM supplier"""


def k03_files(spark, d):
    """Experiments saved one by a nation's region under their times, twice, and read again."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("label"), (F.col("n_nationkey") / 100).alias("wer")))).alias("points"))
    created = F.concat(F.lit("2024-01-0"), (F.col("n_regionkey") + 1).cast("string"), F.lit("T10:00:00"))
    payload = n.select(F.lit("noise").alias("kind"), created.alias("created"), F.size("points").alias("files"), "points")
    out = scratch(spark, "experiments")
    sinks.save_experiment(payload, out)
    sinks.save_experiment(payload, out)
    return readers.result_history(spark, out, "noise").select("file", "files", F.size("points").cast("long").alias("points"))


K03_FILES = """SELECT 'noise_2024010' || (n_regionkey + 1) || '_100000.json' AS file, count(*) AS files, count(*) AS points FROM nation GROUP BY n_regionkey"""


def s13(spark, d):
    """Result files of events, some unreadable, newest first, one kind."""
    e = table(spark, d, "events")
    value = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("files"))))
    read = F.from_json(value, "kind string, files long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    x = e.select(F.format_string("%09d.json", "event_id").alias("file"), read.alias("r")).select("file", "r.*")
    return readers.newest_first(x, "click")


S13 = "SELECT printf('%09d.json', event_id) AS file, event_type AS kind, event_id::BIGINT AS files FROM events WHERE event_id % 7 <> 0 AND event_type = 'click'"


def s16(spark, d):
    """A tone for every supplier, as WAV bytes' worth of samples: their number and absolute sum."""
    t = fixtures.tones_of(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 0.05, 2000)
    return t.select("id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"))


S16 = """SELECT s_suppkey AS id, 2500::BIGINT AS n, round(list_sum(list_transform(range(0, 100), lambda i: abs(sin(i * ((s_suppkey % 24) * 20 + 220) * (2 * pi() / 2000)) * 0.5))), 6) AS total FROM supplier"""


def k01(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("path"), F.col("lang").alias("language"), "n_chars")
    return writers.manifest_columns(rows)


K01 = "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE '' END AS path, '' AS reference, coalesce(lang, '') AS language FROM documents"


def k02(spark, d):
    """Uploads: sidecar texts join their audio by name; texts and tables are no rows."""
    x = table(spark, d, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".wav", ".txt", ".CSV", ".flac"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    side = x.filter("p_size < 25").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit(" "), "p_name").alias("value"))
    return writers.upload_manifest(x.select(name.alias("name")), side)


K02 = """SELECT p_partkey::VARCHAR AS id, p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.wav' ELSE '.flac' END AS path, CASE WHEN p_size < 25 THEN trim(p_name) ELSE '' END AS reference, '' AS language
FROM part WHERE p_partkey % 4 IN (0, 3)"""


def k03(spark, d):
    """Experiment payloads, one a region, and their points as rows."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("label"), F.col("n_name").alias("engine")))).alias("points"))
    return writers.points(n.withColumnRenamed("n_regionkey", "created"), "points").select("label", "engine")


K03 = "SELECT n_nationkey AS label, n_name AS engine FROM nation"


def k07(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return r.select(writers.as_json(r).alias("json"))


K07 = "SELECT to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS json FROM region"


def k08(spark, d):
    """The console table of a benchmark."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("b"))
    k = F.col("s_nationkey")
    runs = s.select(k.alias("run_no"), F.when(k == 0, "local").otherwise("spark").alias("engine"), F.greatest(k, F.lit(1)).alias("workers"), (F.abs("b") + 1).alias("wall_s"))
    return writers.benchmark_table(relative_runs(runs).withColumn("rtfx", F.bround(F.lit(1000.0) / F.col("wall_s"), 3)).withColumn("wer", F.lit(None).cast("double")))


K08 = f"SELECT engine, workers, wall_s, round_even(1000.0 / wall_s, 3) AS rtfx, speedup_vs_single, efficiency, NULL::DOUBLE AS wer FROM ({W04})"

# ------------------------------------------------------------------ predicates, orders, aggregates


def p13(spark, d):
    e = table(spark, d, "events")
    x = e.select(F.col("event_type").alias("kind"), F.format_string("%09d", "event_id").alias("file"), F.lit(None).cast("string").alias("_bad"))
    return readers.newest_first(x, "purchase")


P13 = "SELECT event_type AS kind, printf('%09d', event_id) AS file FROM events WHERE event_type = 'purchase'"


def p16(spark, d):
    return transcribe.listing(table(spark, d, "documents"), ("text",))


P16 = "SELECT * EXCLUDE (text) FROM documents"


def a16(spark, d):
    """A noise sweep: lower levels lose more words; error rates by level."""
    x = spread(table(spark, d, "benchmark")).select("item_id", X.tokens(F.lower("text")).alias("r"))
    levels = F.array(*[F.lit(v).cast("double") for v in (None, 20.0, 10.0, 5.0, 0.0)])
    x = x.select("r", F.posexplode(levels).alias("k", "snr"))
    heard = F.when(F.col("k") == 0, F.col("r")).otherwise(F.filter("r", lambda t, i: i % (12 - 2 * F.col("k")) != 0))
    x = x.select(snr_label(F.col("snr")).alias("label"), E.edit_ops(F.col("r"), heard).alias("words"), F.lit(0).alias("char_errors"), F.lit(0).alias("char_n"))
    return x.groupBy("label").agg(*corpus_totals()).select("label", F.round("wer", 9).alias("wer"), "deletions", "ref_words")


A16 = r"""WITH b AS (SELECT len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS n FROM benchmark),
l AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest(['clean', '20 dB', '10 dB', '5 dB', '0 dB']) AS label),
x AS (SELECT label, n, CASE WHEN k = 0 THEN 0 ELSE (n + 11 - 2 * k) // (12 - 2 * k) END AS gone FROM b, l)
SELECT label, round(sum(gone) / sum(n), 9) AS wer, sum(gone)::BIGINT AS deletions, sum(n)::BIGINT AS ref_words FROM x GROUP BY 1"""


def a17(spark, d):
    """Completed share of active stages: order lines as tasks of one stage an order."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))
    return progress(l.withColumn("active", F.col("completed") < F.col("tasks")))


A17 = """SELECT sum(completed)::BIGINT AS completed, sum(tasks)::BIGINT AS tasks, round(sum(completed) / sum(tasks), 6) AS share FROM (
  SELECT count(*) AS tasks, count(*) FILTER (WHERE l_linestatus = 'F') AS completed FROM lineitem GROUP BY l_orderkey) WHERE completed < tasks"""


def o02(spark, d):
    return table(spark, d, "pages").select("url", "page_id").orderBy("url", "page_id")


O02 = "SELECT url, page_id FROM pages ORDER BY url, page_id"


def o06(spark, d):
    x = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("files"))
    return x.orderBy("name").limit(3)


O06 = "SELECT source AS name, count(*) AS files FROM documents GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 3"


def o07(spark, d):
    """The first match: the latest purchase."""
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return e.agg(F.max_by(F.struct("event_id", "user_id"), F.struct("ts", "event_id")).alias("x")).select("x.*")


O07 = "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1"


def o08(spark, d):
    """A scan that stops once it has enough files with references."""
    refs = table(spark, d, "labels").select("doc_id", "quality")
    found = table(spark, d, "documents").select("doc_id", "source").join(refs, "doc_id").select("doc_id", "source", "quality")
    return found.orderBy("doc_id").limit(20)


O08 = "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 20"

# ------------------------------------------------------------------ texts and alignments


def t06(spark, d):
    return table(spark, d, "part").select("p_partkey", X.katakana_to_hiragana(F.concat(F.lit("カタカナ・ハナシ"), F.col("p_name"), F.lit("ン"))).alias("reading"))


T06 = "SELECT p_partkey, 'かたかな・はなし' || p_name || 'ん' AS reading FROM part"


def t06_readings(spark, d):
    """Kanji readings from a table made of the nations: numbers written in kanji, read by the longest cheap words."""
    digits = "〇一二三四五六七八九"
    n = table(spark, d, "nation")
    kanji = lambda c: F.translate(c.cast("string"), "0123456789", digits)
    words = n.select(kanji(F.col("n_nationkey")).alias("surface"), F.concat(F.lit("<"), F.lower("n_name"), F.lit(">")).alias("reading"))
    x = table(spark, d, "part").select("p_partkey", F.concat(kanji(F.col("p_size")), F.lit("ノ"), kanji(F.col("p_partkey"))).alias("t"))
    return x.select("p_partkey", R.to_kana(F.col("t"), x, R.load_readings(words)).alias("reading"))


# Two digits are one word where the table has it; the cut with the fewest words, of equal ones that with the longest last word.
T06_READINGS = """WITH RECURSIVE p AS (SELECT p_partkey, p_size || 'の' || p_partkey AS t FROM part), w AS (SELECT n_nationkey::VARCHAR AS s, '<' || lower(n_name) || '>' AS r FROM nation),
go AS (SELECT p_partkey, t, 0::BIGINT AS pos, 0::BIGINT AS cost, '' AS reading, '' AS way FROM p UNION ALL
  SELECT p_partkey, t, pos + n, cost + CASE WHEN w.r IS NULL THEN 100 ELSE 1 END, reading || coalesce(w.r, translate(substr(t, (pos + 1)::INT, n), '0123456789', '〇一二三四五六七八九')), n::VARCHAR || way
  FROM go JOIN (VALUES (1), (2)) k(n) ON pos + n <= length(t) LEFT JOIN w ON w.s = substr(t, (pos + 1)::INT, n) WHERE n = 1 OR w.r IS NOT NULL)
SELECT p_partkey, reading FROM go WHERE pos = length(t) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY cost, way DESC) = 1"""


def _mixed(r):
    """Words with some lost, changed and added, by their place."""
    return F.flatten(F.transform(r, lambda t, i: F.when(i % 11 == 3, F.array().cast("array<string>")).when(i % 11 == 6, F.array(F.lit("zq#"))).when(i % 11 == 9, F.array(t, F.lit("zq+"))).otherwise(F.array(t))))


def e05_mixed(spark, d):
    """Alignments with words lost, changed and added: counts of every operation and the words they leave."""
    x = spread(table(spark, d, "benchmark")).select("item_id", X.tokens(F.lower("text")).alias("r"))
    x = x.select("item_id", "r", _mixed(F.col("r")).alias("h"))
    x = x.select("item_id", "r", "h", E.alignment(F.col("r"), F.col("h")).alias("a"))
    count = lambda op: F.size(F.filter("a", lambda z: z["op"] == op)).cast("long")
    side = lambda c: F.transform(F.filter("a", lambda z: z[c].isNotNull()), lambda z: z[c])
    return x.select(
        "item_id", count("H").alias("hits"), count("S").alias("substitutions"), count("D").alias("deletions"), count("I").alias("insertions"),
        ((side("ref") == F.col("r")) & (side("hyp") == F.col("h"))).alias("whole"),
    )


def e06_rendered(spark, d):
    """Every step of the same alignments in order, by operation: what was heard and what was meant."""
    x = spread(table(spark, d, "benchmark")).select("item_id", X.tokens(F.lower("text")).alias("r"))
    x = x.select("item_id", F.transform("r", lambda t, i: F.concat(t, F.lit("~"), i.cast("string"))).alias("r"))  # no two alike
    x = x.select("item_id", F.col("r"), E.alignment(F.col("r"), _mixed(F.col("r"))).alias("a"))
    step = lambda z: F.concat_ws(":", z["op"], F.coalesce(z["hyp"], F.lit("-")), F.coalesce(z["ref"], F.lit("-")))
    return x.select("item_id", F.md5(F.array_join(F.transform("a", step), " ")).alias("steps"))


E06_RENDERED = r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS r FROM benchmark),
s AS (SELECT item_id, list_transform(r, lambda t, i: CASE (i - 1) % 11 WHEN 3 THEN 'D:-:' || t || '~' || (i - 1) WHEN 6 THEN 'S:zq#:' || t || '~' || (i - 1)
  WHEN 9 THEN 'H:' || t || '~' || (i - 1) || ':' || t || '~' || (i - 1) || ' I:zq+:-' ELSE 'H:' || t || '~' || (i - 1) || ':' || t || '~' || (i - 1) END) AS a FROM w)
SELECT item_id, md5(array_to_string(a, ' ')) AS steps FROM s"""


E05_MIXED = r"""SELECT item_id, (n - (n + 7) // 11 - (n + 4) // 11)::BIGINT AS hits, ((n + 4) // 11)::BIGINT AS substitutions, ((n + 7) // 11)::BIGINT AS deletions, ((n + 1) // 11)::BIGINT AS insertions, true AS whole
FROM (SELECT item_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS n FROM benchmark)"""


def e05(spark, d):
    """Alignments with every seventh word dropped: only hits and deletions, all in place."""
    x = spread(table(spark, d, "benchmark")).select("item_id", X.tokens(F.lower("text")).alias("r"))
    x = x.select("item_id", F.col("r"), E.alignment(F.col("r"), F.filter("r", lambda t, i: i % 7 != 3)).alias("a"))
    count = lambda op: F.size(F.filter("a", lambda z: z["op"] == op)).cast("long")
    same = F.transform(F.filter("a", lambda z: z["ref"].isNotNull()), lambda z: z["ref"]) == F.col("r")
    return x.select("item_id", count("H").alias("hits"), count("S").alias("substitutions"), count("D").alias("deletions"), count("I").alias("insertions"), same.alias("whole"))


E05 = r"""SELECT item_id, n - (n + 3) // 7 AS hits, 0::BIGINT AS substitutions, (n + 3) // 7 AS deletions, 0::BIGINT AS insertions, true AS whole
FROM (SELECT item_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))::BIGINT AS n FROM benchmark)"""

# ------------------------------------------------------------------ signal stages


def d02(spark, d):
    """Lengths after resampling from several rates."""
    rates = (8000, 22050, 44100, 48000, 16000)

    @F.pandas_udf("long")
    def length(y: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([len(G.resample(np.asarray(v), int(r))) for v, r in zip(y, rate, strict=True)])

    x = _waves(spark, d).withColumn("rate", F.element_at(F.array(*map(F.lit, rates)), (F.col("vec_id") % 5 + 1).cast("int")))
    return x.select("vec_id", "rate", length("y", "rate").alias("n"))


D02 = f"SELECT vec_id, rate, ceil(len(y) * 16000 / rate)::BIGINT AS n FROM (SELECT *, [8000, 22050, 44100, 48000, 16000][vec_id % 5 + 1] AS rate FROM ({Y}))"


@F.pandas_udf(ArrayType(DoubleType()))
def _mel(y: pd.Series) -> pd.Series:
    return pd.Series([G.log_mel(np.asarray(v))[:, 0] for v in y])


def d09(spark, d):
    """Log-mel bands of the vectors, each one padded frame."""
    x = _waves(spark, d).filter("vec_id % 10 = 0").select("vec_id", F.posexplode(_mel("y")).alias("band", "value"))
    return x.select("vec_id", "band", F.round("value", 6).alias("value"))


_HANN = "(0.5 - 0.5 * cos(2 * pi() * (i - 1) / 399))"
D09 = f"""WITH bank AS ({BANK}),
v AS (SELECT vec_id, y FROM ({Y}) WHERE vec_id % 10 = 0),
p AS (SELECT vec_id, b.k AS bin, pow(list_sum(list_transform(y, lambda x, i: x * {_HANN} * cos(2 * pi() * b.k * (i - 1) / 400))), 2)
  + pow(list_sum(list_transform(y, lambda x, i: x * {_HANN} * sin(2 * pi() * b.k * (i - 1) / 400))), 2) AS power FROM v, range(0, 201) b(k))
SELECT vec_id, band::INT AS band, round(log10(greatest(sum(weight * power), 1e-10)), 6) AS value FROM p JOIN bank USING (bin) GROUP BY 1, 2"""


def d10(spark, d):
    """Feature records of the vectors."""

    @F.pandas_udf("rms_db double, mel_mean double, mel_std double, speech_ratio double")
    def features(y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([G.describe(np.asarray(v)) for v in y])

    x = _waves(spark, d).filter("vec_id % 10 = 0").select("vec_id", features("y").alias("f"))
    return x.select("vec_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("rms_db", "mel_mean", "mel_std", "speech_ratio")])


D10 = f"""SELECT vec_id, round(20 * log10(sqrt(any_value(ms)) + 1e-12), 6) AS rms_db, round(avg(value), 6) AS mel_mean, round(stddev_pop(value), 6) AS mel_std, 1.0::DOUBLE AS speech_ratio
FROM (SELECT vec_id, log10(greatest(sum(weight * power), 1e-10)) AS value FROM p JOIN bank USING (bin) GROUP BY vec_id, band)
JOIN (SELECT vec_id, list_sum(list_transform(y, lambda x: x * x)) / len(y) AS ms FROM v) USING (vec_id) GROUP BY 1"""
D10 = D09[: D09.rindex("SELECT vec_id, band")] + D10


def d11(spark, d):
    """Resample, trim, scale and describe in order."""

    @F.pandas_udf("duration_s double, processed_s double, orig_sr double, rms_db double")
    def stages(y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([G.preprocess(np.asarray(v), G.RATE)[1] for v in y])[["duration_s", "processed_s", "orig_sr", "rms_db"]]

    x = _waves(spark, d).select("vec_id", stages("y").alias("f"))
    return x.select("vec_id", "f.duration_s", "f.processed_s", "f.orig_sr", F.round("f.rms_db", 6).alias("rms_db"))


D11 = f"""SELECT vec_id, round(len(y) / 16000, 3) AS duration_s, round(len(y) / 16000, 3) AS processed_s, 16000::DOUBLE AS orig_sr,
  round(20 * log10(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)) / list_max(list_transform(y, lambda v: abs(v))) * 0.95 + 1e-12), 6) AS rms_db FROM ({Y})"""

# ------------------------------------------------------------------ batch plan


def x01(spark, d):
    """The batch stage over WAV bytes, every fifth file unreadable: facts and errors."""

    @F.pandas_udf("binary")
    def wav(y: pd.Series) -> pd.Series:
        return pd.Series([writers.wav_bytes(np.asarray(v)) for v in y])

    x = _waves(spark, d).select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.encode(F.lit("no audio"), "utf-8")).otherwise(wav("y")).alias("content"))
    heard = transcribe.hear(x, "stand-in")
    return heard.select("id", F.split("error", ":")[0].alias("stage"), "orig_sr", "duration_s", (F.col("hypothesis") != "").alias("heard"), "language")


X01 = f"""SELECT vec_id::VARCHAR AS id, CASE WHEN bad THEN 'preprocess' END AS stage, CASE WHEN NOT bad THEN 16000::DOUBLE END AS orig_sr, CASE WHEN NOT bad THEN round(len(y) / 16000, 3) END AS duration_s,
  NOT bad AS heard, CASE WHEN NOT bad THEN 'en' END AS language FROM (SELECT *, vec_id % 5 = 0 AS bad FROM ({Y}))"""


def x05(spark, d):
    """Long audio: chunks recognised apart, joined in order, in the language most have."""
    x = _waves(spark, d).select("vec_id", F.posexplode(G.chunks(F.col("y"), 10)).alias("pos", "chunk"))
    up = F.size(F.filter("chunk", lambda v: v > 0))
    heard = x.select("vec_id", "pos", F.when(up % 4 == 0, " ").otherwise(F.concat(F.lit(" w"), up)).alias("text"), F.when(up > 4, "en").otherwise("fr").alias("language"))
    return transcribe.rejoined(heard, "vec_id")


X05 = f"""WITH c AS (SELECT vec_id, k, len(list_filter(y[k * 10 + 1:k * 10 + 10], lambda v: v > 0)) AS up FROM ({Y}), range(0, 7) t(k) WHERE k * 10 < len(y)),
h AS (SELECT vec_id, k, CASE WHEN up % 4 = 0 THEN '' ELSE 'w' || up END AS text, CASE WHEN up > 4 THEN 'en' ELSE 'fr' END AS language FROM c)
SELECT vec_id, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (WHERE text <> ''), '') AS text, CASE WHEN count(*) FILTER (WHERE language = 'en') >= count(*) FILTER (WHERE language = 'fr') THEN 'en' ELSE 'fr' END AS language FROM h GROUP BY 1"""


def b15(spark, d):
    """Status in one row: datasets, files, languages, whether a job runs."""
    x = table(spark, d, "documents").agg(F.countDistinct("source").alias("datasets"), F.count(F.lit(1)).alias("files"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))
    busy = result_rows(spark, d).agg(F.coalesce(F.bool_or(F.col("error").isNull() & (F.col("infer_s") > 0)), F.lit(False)).alias("busy"))
    return x.crossJoin(busy)


B15 = f"""SELECT count(DISTINCT source) AS datasets, count(*) AS files, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS languages,
  (SELECT bool_or(error IS NULL AND infer_s > 0) FROM ({RESULT_SQL})) AS busy FROM documents"""

_NAMES = {
    "s01_manifest_rows": "s01", "s03_transcript_lines": "s03", "s04_sidecars": "s04", "s05_nested_audio": "s05", "s05_splits": "s05_splits", "s01_manifest_file": "s01_file", "s02_folder_scan": "s02", "e06_rendered": "e06_rendered", "s06_archive_limit": "s06", "s07_archive_names": "s07_archive", "k03_experiment_files": "k03_files", "s07_tsv": "s07", "s08_wav_round_trip": "s08", "s13_history": "s13", "s16_tones": "s16",
    "k01_manifest": "k01", "k02_upload": "k02", "k03_points": "k03", "k07_json": "k07", "k08_benchmark_table": "k08", "p13_kind": "p13", "p16_listing": "p16", "a16_noise_sweep": "a16",
    "a17_progress": "a17", "o02_sorted_paths": "o02", "o06_top_names": "o06", "o07_first_match": "o07", "o08_early_stop": "o08", "t06_kana": "t06", "e05_alignment": "e05", "e05_alignment_mixed": "e05_mixed", "t06_readings": "t06_readings", "d02_resample": "d02",
    "d09_log_mel": "d09", "d10_features": "d10", "d11_stages": "d11", "x01_batch_stage": "x01", "x05_long_audio": "x05", "b15_status": "b15",
}
QUERIES = {k: globals()[v] for k, v in _NAMES.items()}
ORACLE = {k: globals()[v.upper()] for k, v in _NAMES.items()}
