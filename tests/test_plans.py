import itertools
import os
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import ctc, readings
from earshot.functions import text as X
from earshot.operators.relational import progress
from earshot.plans import session
from earshot.plans.progress import Watch

# ------------------------------------------------------------------ progress


def slow(seconds):
    def work(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return work


def test_progress_of_a_running_plan(spark):
    seen = []
    df = spark.range(0, 24, 1, 24).mapInArrow(slow(0.25), "id long")
    with Watch(spark, lambda done, tasks: seen.append((done, tasks)), every=0.2) as w:
        assert df.groupBy((F.col("id") % 3).alias("k")).count().count() == 3
    assert len(seen) >= 3 and any(0 < done < tasks for done, tasks in seen)
    assert [d for d, _ in seen] == sorted(d for d, _ in seen)
    assert seen[-1][0] == seen[-1][1] >= 24  # it ends at the total
    frame = w.frame(spark)
    middle = next(i for i, s in enumerate(w.snapshots) if any(x[3] for x in s))
    p = progress(frame.filter(F.col("poll") == middle)).first()
    assert p.tasks == sum(s[1] for s in w.snapshots[middle] if s[3]) and 0 <= p.share < 1
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_watches_keep_apart_and_failures_end(spark):
    with Watch(spark, every=0.05) as idle:
        pass
    assert idle.snapshots[-1] == [] and idle.frame(spark).count() == 0
    with pytest.raises(Exception), Watch(spark, every=0.05):
        spark.range(4).select(F.raise_error(F.lit("stop"))).collect()
    with Watch(spark, every=0.05) as w:
        spark.range(3).count()
    assert sum(s[2] for s in w.snapshots[-1]) < 20


# ------------------------------------------------------------------ executors


def test_executor_settings():
    s = session.executor_settings(3)
    assert s["spark.task.cpus"] == "3" and all(s[f"spark.executorEnv.{v}"] == "3" for v in session.THREAD_VARIABLES)
    with pytest.raises(ValueError):
        session.executor_settings(0)


def test_package_is_shipped_off_local_masters(spark, tmp_path):
    assert [session.needs_shipping(m) for m in ("local", "local[8]", "local[2,3]", "local-cluster[2,1,1024]", "spark://h:7077", "yarn", "k8s://x")] == [False] * 3 + [True] * 4
    assert session.ship(spark) is None
    names = zipfile.ZipFile(session.package_zip(str(tmp_path))).namelist()
    assert "earshot/plans/transcribe.py" in names and not any("__pycache__" in n for n in names)


def test_cluster_runs_the_shipped_package(tmp_path):
    """Executors of their own, in another folder, import the package from the zip and have the threads asked for."""
    import subprocess
    import sys

    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
from earshot.plans import session
os.chdir(sys.argv[2])
spark = session.open_session("local-cluster[1,2,1024]", threads=2)
def work(batches):
    import earshot.functions.ctc as m
    for b in batches:
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([m.__file__]), pa.array([os.environ["OMP_NUM_THREADS"]])], ["file", "threads"])
r = spark.range(1).mapInArrow(work, "file string, threads string").first()
print("GOT", r.file, r.threads, spark.conf.get("spark.task.cpus"))
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", *session.THREAD_VARIABLES)}
    out = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], capture_output=True, text=True, env=env, timeout=240)
    line = next((x for x in out.stdout.splitlines() if x.startswith("GOT")), out.stderr[-2000:])
    assert "earshot.zip" in line and line.endswith("2 2"), line


# ------------------------------------------------------------------ texts from scores


def every_path(p):
    """Probabilities of all texts by adding up all paths."""
    out = {}
    for path in itertools.product(range(p.shape[1]), repeat=len(p)):
        text = tuple(s for s, _ in itertools.groupby(path) if s)
        out[text] = out.get(text, 0.0) + np.prod([p[i, s] for i, s in enumerate(path)])
    return out


def test_beam_finds_the_likeliest_text(spark):
    r = np.random.default_rng(4)
    rows = [r.normal(0, 1.5, (n, k)) for n, k in ((1, 2), (2, 3), (4, 3), (5, 4), (6, 3), (6, 2)) for _ in range(6)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(99, None), (98, [])], "i long, s array<array<double>>")
    got = {x.i: x for x in df.select("i", ctc.beam_search(F.col("s"), 1000).alias("b"), ctc.greedy(F.col("s")).alias("g")).collect()}
    better = 0
    for i, x in enumerate(rows):
        p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        texts = every_path(p)
        best = max(texts, key=texts.get)
        assert tuple(got[i].b.symbols) == best and got[i].b.log_p == pytest.approx(np.log(texts[best]))
        path = p.argmax(axis=1)
        assert tuple(got[i].g) == tuple(s for s, _ in itertools.groupby(path.tolist()) if s)
        better += texts[best] > texts[tuple(got[i].g)]
    assert better  # the best path is not always the likeliest text
    assert got[99].b.symbols is None and got[98].b.symbols == [] and got[98].g == []
    narrow = df.select(ctc.beam_search(F.col("s"), 1).alias("b")).collect()
    assert len(narrow) == len(rows) + 2


# ------------------------------------------------------------------ readings

# Ten words and their readings.
WORDS = [("私", "わたし"), ("学生", "がくせい"), ("学", "がく"), ("生", "なま"), ("日本", "にほん"), ("日", "ひ"), ("本", "ほん"), ("日本語", "にほんご"), ("話", "はな"), ("東京", "とうきょう")]


def test_readings(spark):
    table = spark.createDataFrame(WORDS, "surface string, reading string")
    words = readings.load_readings(table)
    texts = ["私は学生です", "日本語を話す", "日本の本", "トウキョウ東京", "", None, "abc 😀", "学生学生生"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(readings.to_kana(F.col("t"), df, words)).collect()]
    assert got == ["わたしはがくせいです", "にほんごをはなす", "にほんのほん", "とうきょうとうきょう", "", None, "abc 😀", "がくせいがくせいなま"]
    norm = df.select(X.normalize(F.col("t"), F.lit("ja"), lambda c: readings.to_kana(c, df, words))).first()[0]
    assert norm == "わたしはがくせいです"
    plain = [r[0] for r in df.select(readings.to_kana(F.col("t"), df)).collect()]
    assert plain[0] == texts[0] and plain[3] == "とうきょう東京"  # without a table only katakana change


def test_cheapest_cut_by_brute_force():
    r = np.random.default_rng(2)
    letters = "abc"
    for _ in range(60):
        words = [("".join(r.choice(list(letters), r.integers(1, 4))), f"<{k}>", float(r.integers(1, 9))) for k in range(6)]
        text = "".join(r.choice(list(letters), r.integers(0, 9)))
        trie = readings.Trie(words)

        def least(rest):
            if not rest:
                return 0.0
            ways = [readings.UNKNOWN + least(rest[1:])] + [c + least(rest[len(w) :]) for w, _, c in words if rest.startswith(w)]
            return min(ways)

        pieces = trie.cut(text)
        assert "".join(p for p, _ in pieces) == text
        cost = sum(readings.UNKNOWN if x is None else min(c for w, _, c in words if w == p) for p, x in pieces)
        assert cost == least(text)


def test_large_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(readings, "MOST_CHARACTERS", 10)
    with pytest.raises(ValueError):
        readings.load_readings(spark.createDataFrame(WORDS, "surface string, reading string"))
    assert readings.load_readings(spark.createDataFrame([("a", "b", 2.0), (None, "x", 1.0), ("", "y", 1.0)], "surface string, reading string, cost double")) == (("a", "b", 2.0),)
