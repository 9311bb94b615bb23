"""Batches of chunks over files, against one file at a time."""

from collections import Counter

import numpy as np
import pytest

from earshot.functions import signal as G
from earshot.plans import transcribe
from earshot.sources import writers
from earshot.sources.decode import decode
from tests.loud_backend import POISON, Loud

PLUGIN, SECONDS = ("tests.loud_backend",), 0.5


@pytest.fixture(scope="module")
def wavs():
    rng = np.random.default_rng(3)
    lengths = [100, 8000, 8001, 16_000, POISON, 30_000, 25_003, 0, 20_001, 8000 + POISON, 9_999, 40_000, 12_345]
    return {f"f{i}": writers.wav_bytes(rng.uniform(-0.5, 0.5, n)) for i, n in enumerate(lengths)} | {"broken": b"no audio", "null": None}


def one_by_one(data, language=None, snr=None, key=""):
    """A file alone by the definition."""
    import zlib

    y, rate = decode(data)
    x, facts = G.preprocess(y, rate, False, snr, zlib.crc32(key.encode()))
    step = int(SECONDS * G.RATE)
    parts = [x[i : i + step] for i in range(0, len(x), step)] or [np.zeros(1600)]
    heard = [Loud().transcribe([p], language, "transcribe")[0] for p in parts]
    tongues = Counter(t or language for _, t in heard if t or language)
    tongue = min(tongues, key=lambda t: (-tongues[t], t)) if tongues else None
    return ("" if tongue == "ja" else " ").join(t.strip() for t, _ in heard if t.strip()), tongue, facts


@pytest.mark.parametrize("batch", [1, 3, 8])
def test_batches_do_not_change_results(spark, wavs, batch):
    audio = spark.createDataFrame([(k, v and bytearray(v)) for k, v in wavs.items()], "id string, content binary").repartition(2)
    got = {r.id: r for r in transcribe.hear(audio, "wav2vec2-base", "en", trimmed=False, batch=batch, seconds=SECONDS, plugins=PLUGIN).collect()}
    assert set(got) == set(wavs)
    failed = {k for k, r in got.items() if r.error}
    assert failed == {"f4", "f9", "broken", "null"}  # each spoils only itself
    for k in failed:
        assert got[k].hypothesis == "" and got[k].language is None
        assert got[k].error.startswith("inference: ValueError: poison" if k.startswith("f") else "preprocess: ")
    for k in set(wavs) - failed:
        text, tongue, facts = one_by_one(wavs[k], "en")
        assert (got[k].hypothesis, got[k].language) == (text, tongue), k
        assert (got[k].duration_s, got[k].processed_s) == (facts["duration_s"], facts["processed_s"]) and got[k].infer_s >= 0


def test_levels_and_repeated_files(spark, wavs):
    audio = spark.createDataFrame([(k, bytearray(wavs[k])) for k in ("f5", "f6", "f5")], "id string, content binary").coalesce(1)
    got = transcribe.hear(audio, "wav2vec2-base", "en", snrs=(None, 0.0), trimmed=False, seconds=SECONDS, plugins=PLUGIN).collect()
    assert len(got) == 6
    for r in got:
        assert r.hypothesis == one_by_one(wavs[r.id], "en", r.snr_db, r.id)[0]


def test_no_files(spark):
    assert transcribe.hear(spark.createDataFrame([], "id string, content binary"), "stand-in").count() == 0


def test_batch_is_asked_together():
    """Full batches but the last, one call each, and one more a chunk where a batch fails."""
    calls = []

    class Counts(Loud):
        def transcribe(self, waves, language, task):
            calls.append(len(waves))
            return super().transcribe(waves, language, task)

    held = transcribe.backend
    try:
        transcribe.backend = lambda name: (Counts(), 0.0)
        good = [({}, np.zeros(10)) for _ in range(8)]
        assert len(transcribe.heard_batch("wav2vec2-base", good, None, "transcribe")) == 8 and calls == [8]
        calls.clear()
        rows = transcribe.heard_batch("wav2vec2-base", [*good[:2], ({}, np.zeros(POISON))], None, "transcribe")
        assert calls == [3, 1, 1, 1] and ["error" in r for r in rows] == [False, False, True]
    finally:
        transcribe.backend = held


def test_summary_has_languages_and_totals(spark):
    rows = [("a", 2.0, 0.5, 1.0, 3.0, "w1", None, "en"), ("b", 1.0, 0.25, 1.0, None, "w1", None, "es"), ("c", 4.0, 1.0, 1.0, 2.0, "w2", "inference: x", "en"), ("d", 1.0, None, 1.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, duration_s double, preprocess_s double, infer_s double, model_load_s double, worker string, error string, language string")
    from earshot.operators.scoring import run_summary

    s = run_summary(df, 2.0).first()
    assert (s.files, s.failed, s.audio_s, s.files_per_s, s.rtfx) == (4, 1, 4.0, 2.0, 2.0)
    assert (s.preprocess_s_total, s.infer_s_total, s.model_load_s_total, s.distinct_workers) == (0.75, 3.0, 5.0, 2)
    assert s.detected_languages == {"en": 1, "es": 1}
    by = {r.worker: r for r in run_summary(df, 2.0, "worker").collect()}
    assert by["w1"].detected_languages == {"en": 1, "es": 1} and by["w2"].detected_languages == {} and by[None].files == 1
    assert run_summary(df.limit(0), 2.0).first().detected_languages == {}
