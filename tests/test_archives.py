import io
import os
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from earshot.operators import pipeline_queries
from earshot.sources import archives, readers, sinks, splits
from tests.oracle import connect, rows

FLAC = (".flac",)


def pack(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def chapters(n, each, start=0):
    """Chapters whose transcripts follow their audio."""
    out = []
    for c in range(start, start + n):
        out += [(f"ch{c}/{c}-{k}.flac", bytes([c % 250, k]) * 500) for k in range(each)]
        out.append((f"ch{c}/{c}.trans.txt", "".join(f"{c}-{k} WORDS OF {c} {k}\n" for k in range(each)).encode()))
    return out


def filters(df):
    """Filters that a plan has above its scan."""
    return re.findall(r"\bFilter\b", df._jdf.queryExecution().executedPlan().toString())


def all_rows(df):
    return [(r.id, r.path, r.reference, bytes(r.content)) for r in df.collect()]


def test_scan_stops_early(spark, tmp_path):
    paths = ",".join(pack(tmp_path / f"{i}.tar.gz", chapters(20, 5, 20 * i), "w:gz") for i in range(3))
    full = all_rows(readers.read_speech_archive(spark, paths))
    assert len(full) == 300 and all(r[2] == "WORDS OF " + r[0].replace("-", " ") for r in full)
    for n in (1, 5, 7, 101, 999):
        assert all_rows(readers.read_speech_archive(spark, paths, n)) == sorted(full, key=lambda r: (int(r[0].split("-")[0]), r[0]))[:n]
    report = {os.path.basename(r.archive): r for r in archives.scan_archives(spark, paths, FLAC, True, limit=7).collect()}
    assert all((r.members, r.taken, r.skipped, r.stopped) == (12, 7, 3, True) for r in report.values())
    whole = archives.scan_archives(spark, paths, FLAC, True).collect()
    assert all((r.members, r.taken, r.stopped) == (120, 100, False) for r in whole)


def test_nothing_behind_the_stop_is_read(spark, tmp_path):
    """An archive cut off behind the chapter that is needed."""
    noise = random.Random(1)
    path = pack(tmp_path / "a.tgz", [(n, d if n.endswith(".txt") else noise.randbytes(4000)) for n, d in chapters(30, 4)], "w:gz")
    data = (tmp_path / "a.tgz").read_bytes()
    (tmp_path / "a.tgz").write_bytes(data[: len(data) // 3])
    assert len(all_rows(readers.read_speech_archive(spark, path, 6))) == 6
    with pytest.raises(Exception):
        readers.read_speech_archive(spark, path).count()


def test_byte_budget(spark, tmp_path):
    path = pack(tmp_path / "a.tar", chapters(10, 4))
    r = archives.scan_archives(spark, path, FLAC, True, max_bytes=5500).first()
    assert (r.taken, r["size"], r.stopped) == (6, 6000, True)
    assert len(all_rows(archives.speech_archive(spark, path, FLAC, max_bytes=5500))) == 6


@pytest.mark.parametrize("hold", [1 << 20, 2500])
def test_late_and_missing_transcripts(spark, tmp_path, hold):
    """All transcripts at the end, some audio without, one key twice, one transcript before its audio."""
    audio = [(f"x/k{i}.flac", bytes([i]) * 1000) for i in range(9)]
    texts = b"".join(f"k{i} text {i}\n".encode() for i in range(8)) + b"noblank\n"
    path = pack(tmp_path / "a.tar", [("x/0.trans.txt", b"k3 early\n"), *audio, ("y/readme.md", b"?"), ("x/1.trans.txt", texts)])
    rows = {r[0]: r for r in all_rows(archives.scan_archives(spark, path, FLAC, hold=hold))}
    assert {k: r[2] for k, r in rows.items()} == {**{f"k{i}": f"text {i}" for i in range(8)}, "k3": "early", "k8": ""}
    assert all(rows[f"k{i}"][3] == bytes([i]) * 1000 for i in range(9))
    assert archives.scan_archives(spark, path, FLAC, True, hold=hold).first().passes == (1 if hold > 9000 else 2)


def test_filters_reach_the_reader(spark, tmp_path):
    a, b = (pack(tmp_path / f"{i}.tar", chapters(2, 3, 2 * i)) for i in range(2))
    x = archives.scan_archives(spark, f"{a},{b}", FLAC).filter((F.col("archive") == a) & F.col("id").isin("0-1", "1-2", "3-0"))
    assert sorted(r.id for r in x.collect()) == ["0-1", "1-2"]
    assert not filters(x)
    assert x.rdd.getNumPartitions() == 1


def test_wanted_names_skip_members(spark, tmp_path):
    names = [f"clip{i}.wav" for i in range(400)]
    path = pack(tmp_path / "a.tar", [(f"test/{n}", n.encode() * 20) for n in names])
    refs = spark.createDataFrame([(n, f"text of {n}") for n in names[::10]] + [("absent.wav", "none"), (names[0], "a text")], "name string, reference string")
    got = {r[1]: r for r in all_rows(archives.referenced_archive(spark, refs, path, (".wav",)))}
    joined = readers.tsv_rows(spark.createDataFrame([], "value string")).union(refs).groupBy("name").agg(F.max("reference").alias("r")).collect()
    assert {k: v[2] for k, v in got.items()} == {r.name: r.r for r in joined if r.name in names}
    wanted = archives.wanted_names(refs.select("name"))
    assert all(n in wanted for n in names[::10]) and sum(n in wanted for n in names) < 48
    report = archives.scan_archives(spark, path, (".wav",), True, wanted=wanted).first()
    assert report.members == 400 and report.skipped == 400 - report.taken > 350
    first = all_rows(archives.referenced_archive(spark, refs, path, (".wav",), 3))
    assert [r[1] for r in first] == names[0:30:10]
    assert all_rows(archives.referenced_archive(spark, refs.limit(0), path, (".wav",))) == []
    assert archives.wanted_names(spark.createDataFrame([(None,)], "name string")) is not None


def test_too_many_names_leave_the_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "MOST_NAMES", 1)
    refs = spark.createDataFrame([("a.wav", "x"), ("b.wav", "y")], "name string, reference string")
    path = pack(tmp_path / "a.tar", [("a.wav", b"1"), ("c.wav", b"2")])
    assert [r[1:3] for r in all_rows(archives.referenced_archive(spark, refs, path, (".wav",)))] == [("a.wav", "x")]


# ------------------------------------------------------------------ splits


def parquet_set(spark, root, files):
    for k, (file, n) in enumerate(files):
        rows = [(None if i == 0 else f"{k}-{i}", f"text {i}", (bytearray(b"a%d" % i), f"clips/{k}_{i}.flac")) for i in range(n)]
        own = root.parent / f"{root.name}-{len(list(root.parent.iterdir()))}"
        spark.createDataFrame(rows, "id string, text string, audio struct<bytes:binary,path:string>").coalesce(1).write.parquet(str(own))
        (root / file).parent.mkdir(parents=True, exist_ok=True)
        next(own.glob("part-*")).rename(root / file)


def test_splits(spark, tmp_path):
    tmp_path = tmp_path / "set"
    parquet_set(spark, tmp_path, [("clean/0.parquet", 4), ("clean/1.parquet", 3), ("other/0.parquet", 5)])
    every = splits.read_splits(spark, str(tmp_path))
    assert every.count() == 7  # the preferred split
    other = every.filter("split = 'other'")
    assert {r.id for r in other.collect()} == {"2_0", "2-1", "2-2", "2-3", "2-4"}
    both = every.filter(F.col("split").isin("clean", "other"))
    assert both.count() == 12
    one = every.filter("split = 'clean' and path = 'clips/1_2.flac'")
    assert [(r.id, r.file, bytes(r.content)) for r in one.collect()] == [("1-2", "clean/1.parquet", b"a2")]
    for df, parts in ((other, 1), (both, 3), (one, 2), (every.filter("file = 'clean/1.parquet' and path like 'clips/1%'"), 1)):
        assert not filters(df)
        assert df.rdd.getNumPartitions() == parts
    kept = every.filter("split = 'clean' and length(reference) > 100")
    assert kept.count() == 0 and filters(kept)


def test_missing_ids_of_many_rows(spark, tmp_path):
    """Several batches of one file: an id that is missing or empty is the stem of its own path."""
    rows = [(None if i % 3 == 0 else "" if i % 3 == 1 else f"id{i}", f"t{i}", (bytearray(b"x" * (i % 900)), f"clips/stem{i}.flac")) for i in range(2000)]
    spark.createDataFrame(rows, "id string, text string, audio struct<bytes:binary,path:string>").coalesce(1).write.parquet(str(tmp_path / "all"))
    got = splits.read_splits(spark, str(tmp_path)).filter("path like 'clips/stem1%'").collect()
    assert {(r.id, r.path, r.reference, len(r.content)) for r in got} == {
        (k or f"stem{i}", a[1], t, len(a[0])) for i, (k, t, a) in enumerate(rows) if str(i).startswith("1")
    }


def test_fallback_revision(spark, tmp_path):
    tmp_path = tmp_path / "set"
    parquet_set(spark, tmp_path, [("refs/convert/parquet/test-00000-of-00001.parquet", 2)])
    x = splits.read_splits(spark, str(tmp_path))
    assert {(r.split, r.id) for r in x.collect()} == {("test", "0_0"), ("test", "0-1")}  # no preferred split: all
    parquet_set(spark, tmp_path, [("data/clean-00000-of-00001.parquet", 1)])
    assert splits.list_files(str(tmp_path)) == ["data/clean-00000-of-00001.parquet"]


# ------------------------------------------------------------------ sinks


def members(spark, n, parts):
    x = spark.range(n).repartitionByRange(parts, "id").sortWithinPartitions("id")
    return x.select(F.concat(F.lit("d/"), "id", F.lit(".flac")).alias("member"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))


def test_archive_sink(spark, tmp_path):
    out = tmp_path / "tars"
    sinks.write_archives(members(spark, 40, 4), str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"part-{k:05d}.tar" for k in range(4)]
    rows = archives.scan_archives(spark, ",".join(sorted(map(str, out.iterdir()))), FLAC).orderBy("place", "position").collect()
    assert [r.id for r in rows] == [str(i) for i in range(40)]
    sinks.write_archives(members(spark, 6, 2), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["part-00000.tar", "part-00001.tar"]


def test_failing_task_leaves_no_file(spark, tmp_path):
    bad = members(spark, 40, 4).withColumn("member", F.when(F.col("member") == "d/33.flac", F.raise_error(F.lit("stop"))).otherwise(F.col("member")))
    with pytest.raises(Exception):
        sinks.write_archives(bad, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists()
    sinks.write_archives(members(spark, 3, 1), str(tmp_path / "old"))
    with pytest.raises(Exception):
        sinks.write_archives(bad, str(tmp_path / "old"))
    assert [p.name for p in (tmp_path / "old").iterdir()] == ["part-00000.tar"]


def test_experiment_sink(spark, tmp_path):
    payload = spark.sql("select 'noise' as kind, '2024-05-06T07:08:09' as created, array(named_struct('label', 'clean', 'wer', 0.5D), named_struct('label', '5 dB', 'wer', null)) as points, array() as runs")
    for _ in range(2):  # a rerun replaces
        sinks.save_experiment(payload, str(tmp_path / "r"))
        assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["noise_20240506_070809.csv", "noise_20240506_070809.json"]
    assert (tmp_path / "r" / "noise_20240506_070809.csv").read_text() == "label,wer\nclean,0.5\n5 dB,\n"
    assert [r.file for r in readers.result_history(spark, str(tmp_path / "r")).collect()] == ["noise_20240506_070809.json"]


def test_upload_sink(spark, tmp_path):
    files = [("b/one.wav", b"1"), ("two.FLAC", b"22"), ("one.txt", " first text \n".encode()), ("list.csv", b"x"), ("three.ogg", b"")]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in files], "name string, content binary").repartition(3)
    for _ in range(2):
        sinks.save_upload(df, str(tmp_path / "up"))
        assert sorted(p.name for p in (tmp_path / "up").iterdir()) == ["manifest.csv", "one.wav", "three.ogg", "two.FLAC"]
    assert (tmp_path / "up/two.FLAC").read_bytes() == b"22"
    rows = {r.id: r for r in readers.read_manifest(spark, str(tmp_path / "up/manifest.csv")).collect()}
    assert rows["one"].reference == "first text" and rows["one"].path == str(tmp_path / "up/one.wav") and rows["two"].reference == ""
    for bad in (df.filter("name like '%.csv' or name like '%.txt'"), df.unionByName(df)):
        with pytest.raises(ValueError):
            sinks.save_upload(bad, str(tmp_path / "none"))
    with pytest.raises(Exception):
        sinks.save_upload(df.withColumn("content", F.when(F.col("name") == "two.FLAC", F.raise_error(F.lit("stop"))).otherwise(F.col("content"))), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_archives_of_documents_stay_small(spark, sf, monkeypatch):
    """An archive is one task's, so their number follows the documents; the queries over them stay the same."""
    monkeypatch.setattr(pipeline_queries, "DOCUMENTS_AN_ARCHIVE", 20, raising=False)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    _, paths = pipeline_queries._speech_tars(spark, sf)
    sizes = []
    for p in paths.split(","):
        with tarfile.open(p) as t:
            sizes.append(sum(m.name.endswith(".flac") for m in t))
    assert sum(sizes) == n and max(sizes) <= 60
    con = connect(sf)
    for query, sql in ((pipeline_queries.s06, pipeline_queries.S06), (pipeline_queries.s07_archive, pipeline_queries.S07_ARCHIVE)):
        assert rows(query(spark, sf).toPandas()) == rows(con.sql(sql).df())
