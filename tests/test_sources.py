import io
import json
import sys
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot import cli
from earshot.plans import models, transcribe
from earshot.sources import readers, writers
from earshot.sources.decode import decode
from earshot.streaming import ingest


def tone(seconds, rate=16000, channels=1):
    y = np.concatenate([np.zeros(int(0.6 * rate)), 0.4 * np.sin(2 * np.pi * 440 * np.arange(int(seconds * rate)) / rate), np.zeros(int(0.6 * rate))])
    return writers.wav_bytes(y if channels == 1 else np.stack([y] * channels, axis=1), rate)


@pytest.fixture()
def folder(tmp_path):
    a = tmp_path / "set"
    (a / "deep").mkdir(parents=True)
    (a / "one.wav").write_bytes(tone(1))
    (a / "deep" / "two.WAV").write_bytes(tone(2, 8000, 2))
    (a / "bad.wav").write_bytes(b"not audio")
    (a / "x.trans.txt").write_text("one alpha bravo\nnoblank\nbad lost words\n")
    (a / "deep" / "two.txt").write_text(" side text \n")
    (a / "manifest.csv").write_text('id,path,reference,language\n,one.wav," alpha, bravo ",en\ntwo,deep/two.WAV,carol,\nbad,bad.wav,lost words,\n')
    return a


def test_manifest(spark, folder):
    rows = readers.read_manifest(spark, str(folder / "manifest.csv")).orderBy("path").collect()
    by = {r.id: r for r in rows}
    assert set(by) == {"one", "two", "bad"}
    assert by["one"].reference == "alpha, bravo" and by["two"].language == ""
    assert by["two"].path == str(folder / "deep/two.WAV")
    assert readers.read_manifest(spark, str(folder / "manifest.csv"), 2).count() == 2


def test_scan(spark, folder):
    rows = {r.id: r for r in readers.scan_folder(spark, str(folder)).collect()}
    assert {k: v.reference for k, v in rows.items()} == {"one": "alpha bravo", "two": "side text", "bad": "lost words"}


def test_decode():
    y, rate = decode(tone(1, 22050, 2))
    assert rate == 22050 and abs(len(y) / rate - 2.2) < 0.01 and abs(np.abs(y).max() - 0.4) < 0.01
    with pytest.raises(Exception):
        decode(b"not audio")


def test_external_decoder(tmp_path, monkeypatch):
    """What no library reads goes through a program's pipes; its failure is an error."""
    tool = tmp_path / "ffmpeg"
    tool.write_text(f"""#!{sys.executable}
import struct, sys
data = sys.stdin.buffer.read()
assert sys.argv[sys.argv.index("-ar") + 1] == "16000" and sys.argv[-1] == "pipe:1"
if not data.startswith(b"good"):
    sys.exit(3)
sys.stdout.buffer.write(struct.pack("<4f", 0.0, 0.5, -0.5, 1.0))
""")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", str(tmp_path))
    y, rate = decode(b"good bytes")
    assert rate == 16_000 and y.tolist() == [0.0, 0.5, -0.5, 1.0]
    with pytest.raises(Exception):
        decode(b"bad bytes")
    monkeypatch.setenv("PATH", "")
    with pytest.raises(RuntimeError):
        decode(b"good bytes")


def test_batch_plan(spark, folder):
    manifest = readers.read_manifest(spark, str(folder / "manifest.csv"))
    audio = readers.scan_folder(spark, str(folder)).join(readers.read_audio(spark, str(folder)), "path").select("id", "content")
    scored = transcribe.score(manifest, transcribe.hear(audio, "stand-in"))
    rows = {r.id: r for r in transcribe.results(scored).collect()}
    assert rows["bad"].error.startswith("preprocess: ") and rows["bad"].wer is None
    assert rows["two"].orig_sr == 8000 and rows["two"].processed_s < rows["two"].duration_s and rows["two"].wer is not None
    s = transcribe.summary(scored, 2.0).first()
    assert (s.files, s.failed) == (3, 1) and s.ref_words == 3
    again = transcribe.score(manifest, transcribe.hear(audio.repartition(7), "stand-in"))
    assert {(r.id, r.hypothesis) for r in again.collect()} == {(r.id, r.hypothesis) for r in rows.values()}
    sweep = {r.label: r for r in transcribe.noise_sweep(manifest, audio, "stand-in").collect()}
    assert set(sweep) == {"clean", "20 dB", "10 dB", "5 dB", "0 dB"}


def test_guards():
    models.check_language("whisper-tiny", "ja", "translate")
    for bad in (("wav2vec2-base", "ja", "transcribe"), ("wav2vec2-base", None, "translate"), ("nothing", None, "transcribe")):
        with pytest.raises(ValueError):
            models.check_language(*bad)
    with pytest.raises(RuntimeError):
        models.backend("pocketsphinx")


def test_catalog_and_history(spark, folder, tmp_path):
    c = readers.dataset_catalog(spark, str(folder)).first()
    assert (c["name"], c["count"], c["languages"]) == ("set", 3, ["en"])
    h = tmp_path / "results"
    h.mkdir()
    (h / "noise_1.json").write_text('{"kind": "noise",\n "files": 3}')
    (h / "benchmark_2.json").write_text('{"kind": "benchmark", "runs": [{"engine": "spark"}]}')
    (h / "zz.json").write_text("{broken")
    assert [r.file for r in readers.result_history(spark, str(h)).collect()] == ["noise_1.json", "benchmark_2.json"]
    assert readers.result_history(spark, str(h), "noise").count() == 1


def test_archives_and_tables(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as t:
        for name, data in (("d/k1.flac", b"x"), ("d/k.trans.txt", b"k1 some words\nk2 others"), ("d/k3.flac", b"y"), ("d/n.md", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    rows = {r.id: r.reference for r in readers.read_speech_archive(spark, str(path)).collect()}
    assert rows == {"k1": "some words", "k3": ""}
    (tmp_path / "t.tsv").write_text("1\tf.wav\thello there\n2\tshort\n")
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("f.wav", "hello there")]
    spark.createDataFrame([("1", "words", (bytearray(b"ab"), "f.wav"))], "id string, text string, audio struct<bytes:binary,path:string>").write.parquet(str(tmp_path / "p"))
    assert readers.read_audio_parquet(spark, str(tmp_path / "p")).first().content == b"ab"
    assert readers.audio_bytes(spark, [("a", b"1")]).count() == 1


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", "p, q", None)], "id string, path string, reference string")
    writers.write_manifest(m, str(tmp_path / "m"))
    r = readers.read_manifest(spark, str(tmp_path / "m")).first()
    assert (r.id, r.reference, r.language) == ("a", "", "")
    e = spark.range(1).select(F.lit("noise").alias("kind"), F.array(F.struct(F.lit("clean").alias("label"), F.lit(0.5).alias("wer"))).alias("points"))
    writers.write_experiment(e, str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e/csv"), header=True).first().label == "clean"
    files = spark.createDataFrame([("a.wav",), ("a.txt",), ("t.csv",)], "name string")
    side = spark.createDataFrame([("a.txt", " hello ")], "name string, value string")
    assert [tuple(x) for x in writers.upload_manifest(files, side).collect()] == [("a", "a.wav", "hello", "")]


def test_stream(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest.drain(ingest.new_audio(spark, str(folder)), out, mark)
    assert spark.read.parquet(out).count() == 3
    (folder / "late.wav").write_bytes(tone(0.2))
    ingest.drain(ingest.new_audio(spark, str(folder)), out, mark)
    assert spark.read.parquet(out).count() == 4


def test_cli(spark, folder, tmp_path, capsys):
    files, out = ["--manifest", str(folder / "manifest.csv")], str(tmp_path / "out")
    cli.main(["batch", *files])
    assert '"failed":1' in capsys.readouterr().out
    for _ in range(2):  # nothing is replaced
        cli.main(["batch", *files, "--out", out])
    shown = capsys.readouterr()
    assert '"detected_languages":{"en":2}' in shown.out and "tasks" in shown.err
    runs = sorted((tmp_path / "out").glob("batch-*/csv"))
    assert len(runs) == 2 and spark.read.csv(str(runs[0]), header=True).count() == 3


def test_cli_transcribe(spark, folder, capsys):
    cli.main(["transcribe", str(folder / "one.wav"), "--reference", "alpha bravo"])
    found = json.loads(capsys.readouterr().out)
    assert found["hypothesis"] and found["wer"] >= 0 and found["orig_sr"] == 16000
    with pytest.raises(SystemExit):
        cli.main(["transcribe", str(folder / "bad.wav")])
    assert "preprocess: " in json.loads(capsys.readouterr().out)["error"]


def test_cli_experiments(spark, folder, tmp_path, capsys):
    files, out = ["--manifest", str(folder / "manifest.csv")], str(tmp_path / "out")
    cli.main(["benchmark", *files, "--out", out, "--workers", "1,2"])
    assert "efficiency" in capsys.readouterr().out
    cli.main(["noise", *files, "--out", out])
    assert "10 dB" in capsys.readouterr().out
    kinds = {r.kind: r for r in readers.result_history(spark, out).collect()}
    assert len(kinds["benchmark"].runs) == 3 and len(kinds["noise"].points) == 5
    cli.main(["prefetch"])
    assert "seconds" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["batch"])


def test_cli_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(SystemExit):
        cli._place(far, None, "batch")
    assert cli._place(far, "/shared", "batch").startswith("/shared/batch-")


def test_plans_stay_in_catalyst(spark, sf):
    from earshot import catalog

    plan = catalog.queries()["p03_successful"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "Python" not in plan


def test_experiments(spark, tmp_path):
    from earshot.functions import signal as G
    from earshot.plans import experiments
    from earshot.sources import fixtures

    t = fixtures.tones(spark, 2, 0.1, 1000).select(F.size("y").alias("n"), F.size(G.trim(F.col("y"), 35.0, 25, 10)).alias("m")).collect()
    assert all(r.n == 1300 and r.m < 200 for r in t)
    runs = experiments.scaling(spark, lambda n: None, [1, 2], lambda: None)
    assert [r.engine for r in runs.orderBy("run_no").collect()] == ["local", "spark", "spark"]
    assert [experiments.worker_counts(n) for n in (0, 1, 2, 6, 8)] == [[1], [1], [1, 2], [1, 2, 4, 6], [1, 2, 4, 8]]
    payload = experiments.benchmark_payload(runs, "stand-in", 3)
    writers.write_experiment(payload, str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x/csv"), header=True).count() == 3
