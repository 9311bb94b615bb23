import random
import tracemalloc
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earshot.functions import editdistance as E
from earshot.functions import signal as G
from earshot.functions import text as X
from earshot.operators import scoring


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        ("Ask Dr. Ruiz; Mrs Ode's at 4518?", "en", "ask doctor ruiz missus ode's at four thousand five hundred eighteen"),
        ("1,000", "en", "one zero"), ("5th", "en", "fiveth"), ("$5", "en", "five"), ("café", "en", "caf"), ("50%", None, "fifty percent"),
        ("007 and 1000000", "en", "seven and 1000000"), ("0042000000", "", "42000000"), ("999999", "en", "nine hundred ninety nine thousand nine hundred ninety nine"),
        ("'tis rock 'n' roll’s", "en", "tis rock n roll's"), ("¡Mañana  lloverá, niña!", "es", "mañana lloverá niña"),
        ("わたしは、がくせい です。", "zh", "わたしはがくせいです"), ("カタカナ", "ja", "かたかな"), ("Ｈｅｌｌｏ", "en", "hello"), (None, "en", ""), ("", "es", ""),
    ],
)
def test_normalize(spark, text, lang, want):
    df = spark.createDataFrame([(text, lang)], "t string, l string")
    assert df.select(X.normalize(X.nfkc(F.col("t")), F.col("l"))).first()[0] == want


def test_numbers(spark):
    def words(n):
        if n < 100:
            return X.ONES[n] if n < 20 else X.TENS[n // 10] + (f" {X.ONES[n % 10]}" if n % 10 else "")
        k, name = (1000, "thousand") if n >= 1000 else (100, "hundred")
        return f"{words(n // k)} {name}" + (f" {words(n % k)}" if n % k else "")

    df = spark.range(0, 1_000_000, 997)
    for r in df.select("id", X.number_words(F.col("id").cast("string")).alias("w")).collect():
        assert r.w == words(r.id)


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.c/clip.tar.GZ",), ("x",), ("/a/.hidden",)], "p string")
    assert [tuple(r) for r in df.select(X.stem(F.col("p")), X.suffix(F.col("p"))).collect()] == [("clip.tar", ".gz"), ("x", ""), (".hidden", "")]


def test_seed_is_zlibs(spark):
    assert spark.range(50).filter(F.crc32(F.col("id").cast("string")) != 0).count() == 50
    for r in spark.range(20).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect():
        assert r.c == zlib.crc32(str(r.id).encode())


def cheapest(r, h):
    """Counts (S, D, I) from the definition: equal last tokens pair for nothing; else the
    cheapest of pairing them, dropping the reference's, adding the hypothesis's, in this
    order where costs tie."""

    @cache
    def of(i, j):
        if not i or not j:
            return np.array([0, i, j])
        if r[i - 1] == h[j - 1]:
            return of(i - 1, j - 1)
        options = [of(i - 1, j - 1) + [1, 0, 0], of(i - 1, j) + [0, 1, 0], of(i, j - 1) + [0, 0, 1]]
        return min(options, key=sum)

    return of(len(r), len(h)).tolist()


def test_edit_counts():
    rnd = random.Random(5)
    pairs = [tuple([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in range(2)) for _ in range(400)] + [([], []), (["a"], []), ([], ["a"])]
    got = E.edit_counts([r for r, _ in pairs], [h for _, h in pairs])
    for (r, h), c in zip(pairs, got.tolist(), strict=True):
        assert c == cheapest(r, h)
        found = E.align(r, h)
        ops = [o for o, _, _ in found]
        assert [ops.count(o) for o in "SDI"] == c
        assert [x for _, _, x in found if x is not None] == r and [y for _, y, _ in found if y is not None] == h
        assert all((o == "H") == (y == x) for o, y, x in found)


def test_alignment_order():
    """Ties go to pairs before deletions before insertions, from the end."""
    ops = lambda r, h: "".join(o for o, _, _ in E.align(list(r), list(h)))
    assert (ops("ab", "ba"), ops("xa", "a"), ops("aa", "a"), ops("a", "aa"), ops("abc", "xbz"), ops("", "q"), ops("q", "")) == ("SS", "DH", "DH", "IH", "SHS", "I", "D")


def test_distance():
    rnd = random.Random(6)
    pairs = [tuple([rnd.choice("abcd") for _ in range(rnd.randrange(90))] for _ in range(2)) for _ in range(150)] + [([], []), (["a"], []), ([], ["a"])]
    assert [E.distance(r, h) for r, h in pairs] == E.edit_counts([r for r, _ in pairs], [h for _, h in pairs]).sum(axis=1).tolist()
    long = [str(rnd.randrange(3000)) for _ in range(20_000)]
    heard = [w for i, w in enumerate(long) if i % 7 != 3]
    assert E.distance(long, heard) == len(long) - len(heard)  # seconds, where a whole table takes minutes


def test_token_errors(spark):
    rows = [(["a", "b"], ["b"]), (None, ["x"]), (["x"], None), ([], [])] + [(list("abc" * k), list("acb" * k)) for k in range(40)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>").select(E.token_errors("r", "h").alias("n"), E.edit_ops(F.col("r"), F.col("h"))["errors"].alias("e"))
    assert [r.n for r in df.collect()] == [r.e for r in df.collect()]


def test_alignment_in_blocks(monkeypatch):
    """Long texts are aligned with the moves of some rows at a time: the same alignment, in bounded memory."""
    rnd = random.Random(7)
    pairs = [tuple([rnd.choice("abc") for _ in range(rnd.randrange(25))] for _ in range(2)) for _ in range(200)]
    want = [E.align(r, h) for r, h in pairs]
    long = [rnd.choice("abcdef") for _ in range(6000)]
    tracemalloc.start()
    found = E.align(long, long[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 6000 and peak < 25 << 20  # all moves at once are 36 MB
    for size in (1, 60):
        monkeypatch.setattr(E, "_MOVES", size)
        assert [E.align(r, h) for r, h in pairs] == want


def test_alignment_by_slices(spark):
    rows = [(list("abc" * (k % 7)), list("acb" * (k % 5))) for k in range(300)] + [(None, ["x"]), (["x"], None), (["w"] * 40_000, ["w"] * 40_000), (["v"] * 30_000, ["v"] * 30_000), ([], [])]
    refs, hyps = (pa.array([r[k] for r in rows]) for k in range(2))
    some = list(E._slices(refs, hyps))
    assert len(some) > 1 and [p for r, h in some for p in zip(r, h, strict=True)] == [(r or [], h or []) for r, h in rows]
    short = [r for r in rows if len(r[0] or ()) < 100]
    got = spark.createDataFrame(short, "r array<string>, h array<string>").coalesce(1).select(E.alignment("r", "h").alias("a")).collect()
    assert [[(x.op, x.hyp, x.ref) for x in g.a] for g in got] == [E.align(r or [], h or []) for r, h in short]


@pytest.mark.parametrize(
    ("ref", "hyp", "want"),
    [("p q r s t", "p r s u t", (2, 0, 1, 1, 5)), ("left right", "", (2, 0, 2, 0, 2)), ("go up the hill", "go up a steep hill", (2, 1, 0, 1, 4)), ("m n", "n m", (2, 2, 0, 0, 2))],
)
def test_edit_ops(spark, ref, hyp, want):
    df = spark.createDataFrame([(ref, hyp)], "r string, h string").select(E.edit_ops(X.tokens(F.col("r")), X.tokens(F.col("h"))).alias("e"))
    e = df.first().e
    assert (e.errors, e.S, e.D, e.I, e.N) == want
    assert e.H == e.N - e.S - e.D


def test_comparisons_are_dealt_by_rows(spark, sf, monkeypatch):
    """One task may not compare whole row groups of texts: the files say nothing about that work."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").count()
    monkeypatch.setattr(scoring, "TURNS_A_TASK", 3, raising=False)
    assert scoring.utterances(spark, sf).rdd.getNumPartitions() >= turns / 3 > 8


def test_half_even(spark):
    assert spark.range(1).select(F.bround(F.lit(1 / 32), 4)).first()[0] == 0.0312


def test_empty_reference_rate(spark):
    df = spark.createDataFrame([(2, 0), (0, 0), (1, 4)], "e long, n long").select(E.rate(F.col("e"), F.col("n")))
    assert [r[0] for r in df.collect()] == [1.0, 0.0, 0.25]


def test_resample():
    for rate in (8000, 22050, 44100, 48000):
        y = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
        z = G.resample(y, rate)
        assert len(z) == 16000
        assert np.abs(z - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000))[300:-300].max() < 5e-3
    high = np.sin(2 * np.pi * 15000 * np.arange(44100) / 44100)
    assert np.abs(G.resample(high, 44100))[300:-300].max() < 0.01
    assert len(G.resample(np.zeros(0), 8000)) == 0


def test_trim_and_scale(spark):
    burst = np.where(np.arange(4800) % 2, 0.3, -0.3)
    y = np.concatenate([np.zeros(3200), burst, np.zeros(8000)])
    t = G.trim_array(y)
    # Frames that touch the burst: from the first that ends in it to the last that begins in it.
    first, last = -(-(3200 - G.FRAME + 1) // G.HOP), (8000 - 1) // G.HOP
    assert np.array_equal(t, y[first * G.HOP : last * G.HOP + G.FRAME])
    assert np.abs(G.scale_array(t)).max() == pytest.approx(G.PEAK) and not G.scale_array(np.zeros(7)).any()
    df = spark.createDataFrame([(y.tolist(),), ([],), ([0.0] * 30,)], "y array<double>")
    got = [r[0] for r in df.select(F.size(G.trim(F.col("y")))).collect()]
    assert got == [len(t), 0, 30]


def test_noise_level():
    y = np.where(np.arange(50_000) % 3, 0.2, -0.4)
    for snr in (0, 7):
        n = G.add_noise(y, snr, 21) - y
        assert n.std() == pytest.approx(np.sqrt((y**2).mean() / 10 ** (snr / 10)), rel=0.02) and abs(n.mean()) < 0.01
    assert np.array_equal(G.add_noise(y, 7, 21), y + n) and not np.array_equal(G.add_noise(y, 7, 22), y + n)


def test_log_mel():
    y = np.random.default_rng(3).normal(size=G.FRAME + 5 * G.HOP + 1)
    got = G.log_mel(y)
    assert got.shape == (G.MELS, 6)
    k = np.arange(G.FRAME)
    frame = y[2 * G.HOP : 2 * G.HOP + G.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * k / (G.FRAME - 1)))
    power = [abs((frame * np.exp(-2j * np.pi * b * k / G.FRAME)).sum()) ** 2 for b in range(G.FRAME // 2 + 1)]
    assert np.allclose(got[:, 2], np.log10(G.mel_weights() @ power), atol=1e-9)
    assert G.describe(np.zeros(0)) == {"rms_db": -120.0, "mel_mean": 0.0, "mel_std": 0.0, "speech_ratio": 0.0}


def test_nfkc_sends_other_texts_only(spark):
    t = "ﬁne ① ½"
    df = spark.createDataFrame([(t,), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(X.nfkc(F.col("t"))).collect()] == [unicodedata.normalize("NFKC", t), "plain", None]
    plan = df.select(X.nfkc(F.col("t")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "_nfkc(pythonUDF" not in plan and "_nfkc(CASE WHEN" in plan or "CASE WHEN RLIKE" in plan.split("ArrowEvalPython")[1]


def test_noise_is_a_function_of_seed_and_place(spark):
    """The same samples natively and in numpy, on 1 and 8 partitions; level and spread as asked."""
    from earshot.functions import signal as G

    n = 20_000
    tone = 0.4 * np.sin(2 * np.pi * 440 * np.arange(n) / 16_000)
    rows = [(int(s), tone[: n - 100 * s].tolist()) for s in range(4)]
    df = spark.createDataFrame(rows, "seed long, y array<double>")
    got = {}
    for parts in (1, 8):
        x = df.repartition(parts).select("seed", "y", G.noisy(F.col("y"), F.lit(10.0), F.col("seed")).alias("z")).collect()
        got[parts] = {r.seed: np.array(r.z) for r in x}
    for s in range(4):
        assert np.array_equal(got[1][s], got[8][s])
        clean = tone[: n - 100 * s]
        assert np.allclose(got[1][s], G.add_noise(clean, 10.0, s), atol=1e-9)
        noise = got[1][s] - clean
        assert abs(10 * np.log10(np.mean(clean**2) / np.mean(noise**2)) - 10.0) < 0.3
        z = noise / noise.std()
        assert abs(z.mean()) < 0.03 and abs((z**4).mean() - 3) < 0.2 and abs(np.corrcoef(z[:-1], z[1:])[0, 1]) < 0.03
    assert np.abs(np.corrcoef([got[1][s][: n - 300] - tone[: n - 300] for s in range(4)]) - np.eye(4)).max() < 0.03
    empty = spark.createDataFrame([(5, [])], "seed long, y array<double>").select(G.noisy(F.col("y"), F.lit(0.0), F.col("seed"))).first()[0]
    assert empty == [] and len(G.add_noise(np.zeros(0), 0.0, 5)) == 0


def test_bank_at_bins_is_the_matrix(spark):
    got = spark.range(201).select(G.mel_bank(F.col("id") * 40.0).alias("w")).collect()
    assert np.allclose(np.array([r.w for r in got]).T, G.mel_weights(), atol=1e-12)
