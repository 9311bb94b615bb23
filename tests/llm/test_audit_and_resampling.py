"""Divergence audit and resampling against plain loops and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from earshot.llm import common, divergence, resampling
from earshot.llm.common import small_table, stage
from tests.oracle import connect

SCHEMA = "doc_id long, text string, lang string, source string"


def tuples(df):
    cols = sorted(df.columns)
    return sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect())


def sql(con, text):
    rel = con.sql(text)
    return sorted(tuple(map(str, r)) for r in rel.project(", ".join(sorted(rel.columns))).fetchall())


def made(seed, n, sources=6, langs=2):
    r = random.Random(seed)
    vocab = [("é" if k % 7 == 0 else "") + "abcdefgh"[k % 8] * (1 + k // 8 % 5) + "xyz"[k % 3] for k in range(90)]
    out = []
    for i in range(n):
        s = r.randrange(sources)
        words = [vocab[min(89, int(r.expovariate(0.05 + s * 0.02)) + s)] for _ in range(r.randrange(0, 60))]
        out.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words), f"l{r.randrange(langs)}", f"s{s}"))
    return out + [(None, None, None, None), (n, "", "l0", "empty"), (n + 1, "1 2 3 !", None, "s1"), (n + 2, "only once ÜÉ ü", "alone", "s"), out[0], out[0]]


def brute_audit(rows, k):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(term(text)))
        counts[lang, source].update(term(text))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in own if o != s]
            terms = [(-((ps[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:k])):
                out += [(item, lang, part, i, s, -v) for i, (v, item) in enumerate(found, 1)]
    return sorted(tuple(map(str, r)) for r in out)


@pytest.mark.parametrize("k,first,block", [(200, 200, 1 << 20), (3, 1, 20)])
def test_audit(spark, monkeypatch, k, first, block):
    """Small first rounds need several; small blocks take wide terms apart."""
    monkeypatch.setattr(divergence, "FIRST", first)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = made(3, 300)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("term", "g", "n", "item", "value", "rank", "p")})
    assert tuples(divergence.audit(docs, k)) == brute_audit(rows, k)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = [(1, "a b", "x", "s"), (2, "a", "x", "t")]
    assert tuples(divergence.audit(spark.createDataFrame(lone, SCHEMA))) == brute_audit(lone, 200)


def test_bounds_hold(spark):
    """No term of a bucket diverges more than its bound, and few are evaluated."""
    r = np.random.default_rng(1)
    rows = [(1, f"t{i}", int(min(n, 40)), int(1 + n * 1000), int(1 + 900 * n * f)) for i, (n, f) in enumerate(zip(r.zipf(1.3, 4000).clip(1, 9999), r.uniform(0.2, 2, 4000), strict=True))]
    rated = stage(spark.createDataFrame(rows, "g long, term string, bucket long, p long, q long"), "test-rated")
    want = sorted((-((p - q) ** 2 // q), t) for _, t, _, p, q in rows if p > q)[:200]
    got = sorted((-x.value, x.term) for x in divergence.top_terms(rated).collect())
    assert got == want


def test_shares_beyond_long(spark):
    big = 4 * 10**12
    got = spark.createDataFrame([(big, 9 * 10**12, 1000)], "n long, a long, v long").select(divergence.share(F.col("n"), F.col("a"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (big + 1) // (9 * 10**12 + 1000)


def test_audit_query(spark, sf):
    assert tuples(divergence.op12_divergence(spark, sf)) == sql(connect(sf), divergence.ORACLE["op12_divergence"])


def test_small_table_knows_strings(spark):
    wide = stage(spark.createDataFrame([("x" * 4096,)] * 10, "a string").selectExpr("a", "1 as b").crossJoin(spark.range(900)), "test-wide")
    assert "broadcast" not in small_table(wide)._jdf.queryExecution().logical().toString().lower()
    few = wide.limit(3)
    assert "broadcast" in small_table(few)._jdf.queryExecution().logical().toString().lower()


def brute_resample(rows, target, most, least=20, percent=10):
    def features(t):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())
        return len(words), [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    at = lambda f: zlib.crc32(f) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(at, features(text)[1]))
    for text in target:
        t.update(map(at, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10_000)) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, text in rows:
        n, fs = features(text)
        w = sum(gain(at(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], -(2**63) if x[0] is None else x[0]))
    for k, x in enumerate(fit[: len(fit) * percent // 100], 1):
        x[4] = k
    return sorted(tuple(map(str, (x[0], x[1], x[4], x[3], x[2]))) for x in out)


@pytest.mark.parametrize("most,entries", [(1, 1 << 18), (2, 40)])
def test_resample(spark, monkeypatch, most, entries):
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(resampling, "KNOWN", 30)
    rows = [(i, t) for i, t, *_ in made(5, 400)[:-2]] + [(9000 + i, "same words here again and again " * 9) for i in range(30)] + [(9100, "X1 x1 é9É " * 3000)]
    target = [t for _, t in rows[:20]] + [None, "", "Other words 42"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("score", "rank", "weight", "n_words", "ids", "fit")})
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), most)
    assert tuples(got) == brute_resample(rows, target, most)


def test_resample_repeats_and_nothing(spark):
    text = "a few words " * 10
    docs = spark.createDataFrame([(5, text)] * 40 + [(None, text)] * 20, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, none).collect()
    assert len(got) == 60 and sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5, 6]
    assert len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(docs.limit(0), none).count() == 0


def test_matrix_is_kept_in_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = resampling.count_blocks(docs).collect()
    assert sum(len(b.ids) for b in blocks) == docs.count()
    for b in blocks:
        assert b.starts[0] == 0 and b.starts[-1] == len(b.buckets) == len(b.counts) and len(b.starts) == len(b.ids) + 1 == len(b.words) + 1


def test_matrix_is_written_in_small_groups(spark, monkeypatch, tmp_path):
    """A task holds one group of rows of the matrix, so their size may not follow the input's."""
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("w"), (i * 31 + F.col("id") * 7).cast("string"))), " ")
    docs = spark.range(600).select(F.col("id").alias("doc_id"), words.alias("text")).coalesce(1)
    resampling.resample(docs, docs.limit(1)).count()
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("resampling-blocks-*/*.parquet")]
    entries = [m.row_group(k).column(3).num_values for m in files for k in range(m.num_row_groups)]
    assert sum(entries) > 1_000_000 and max(entries) <= 16 * ((1 << 15) + resampling.BUCKETS)


def test_resample_query(spark, sf):
    assert tuples(resampling.op13_resampling(spark, sf)) == sql(connect(sf), resampling.ORACLE["op13_resampling"])
