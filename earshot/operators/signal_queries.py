"""Signal functions over vectors as short waveforms (frames of 16 samples, hop 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import ctc as C
from ..functions import signal as G
from ..plans.tables import spread, table
from .relational import snr_label

SIZE, HOP = 16, 4


def _waves(spark, d):
    e = spread(table(spark, d, "embeddings"))
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("y"))


Y = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS y FROM embeddings"
FRAMES = f"list_transform(range(0, (len(y) - {SIZE}) // {HOP} + 1), lambda k: y[k * {HOP} + 1:k * {HOP} + {SIZE}])"
RMS = f"list_transform({FRAMES}, lambda f: sqrt(list_sum(list_transform(f, lambda v: v * v)) / {SIZE} + 1e-12))"
DB = f"(SELECT vec_id, y, list_transform(r, lambda v: 20 * log10(v / (list_max(r) + 1e-12) + 1e-12)) AS db FROM (SELECT vec_id, y, {RMS} AS r FROM ({Y})))"
#: Quiet frames are rare in noise, so the threshold here is 2 dB.
TOP = 2.0


def w01(spark, d):
    f = G.frames(F.col("y"), SIZE, HOP)
    return _waves(spark, d).select("vec_id", F.size(f).cast("long").alias("n"), F.bround(F.element_at(f, -1)[0], 9).alias("last_first"))


W01 = f"SELECT vec_id, len(f)::BIGINT AS n, round_even(f[-1][1], 9) AS last_first FROM (SELECT vec_id, {FRAMES} AS f FROM ({Y}))"


def d03(spark, d):
    x = _waves(spark, d).select("vec_id", F.posexplode(G.frame_db(F.col("y"), SIZE, HOP)).alias("frame", "db"))
    return x.select("vec_id", "frame", (F.round("db", 7) + 0.0).alias("db"))


D03 = f"SELECT vec_id, unnest(range(0, len(db)))::INT AS frame, round(unnest(db), 7) + 0.0 AS db FROM {DB}"


def d04(spark, d):
    """Samples left by trimming, and the voiced frames' share."""
    db = G.frame_db(F.col("y"), SIZE, HOP)
    t = G.trim(F.col("y"), TOP, SIZE, HOP)
    return _waves(spark, d).select("vec_id", F.size(t).cast("long").alias("n"), F.round(t[0], 9).alias("first"), F.round(G.speech_ratio(db, TOP), 9).alias("speech_ratio"))


D04 = f"""SELECT vec_id, (least(len(y), hi * {HOP} + {SIZE}) - lo * {HOP})::BIGINT AS n, round(y[lo * {HOP} + 1], 9) AS first, round(len(v) / len(db), 9) AS speech_ratio
FROM (SELECT *, list_min(v) AS lo, list_max(v) AS hi FROM (SELECT *, list_filter(range(0, len(db)), lambda k: db[k + 1] > -{TOP}) AS v FROM {DB}))"""


def d05(spark, d):
    n = G.peak_normalize(F.col("y"))
    return _waves(spark, d).select("vec_id", F.round(G.peak(n), 9).alias("peak"), F.round(n[0], 9).alias("first"))


D05 = f"SELECT vec_id, round(list_max(list_transform(y, lambda v: abs(v))) / m * 0.95, 9) AS peak, round(y[1] / m * 0.95, 9) AS first FROM (SELECT *, list_max(list_transform(y, lambda v: abs(v))) AS m FROM ({Y}))"


def d06(spark, d):
    """Noise level for 10 dB."""
    return _waves(spark, d).select("vec_id", F.round(G.noise_sigma(F.col("y"), F.lit(10.0)), 9).alias("sigma"), F.round(G.rms_db(F.col("y")), 7).alias("rms_db"))


D06 = f"SELECT vec_id, round(sqrt((p + 1e-12) / 10), 9) AS sigma, round(20 * log10(sqrt(p) + 1e-12), 7) AS rms_db FROM (SELECT vec_id, list_sum(list_transform(y, lambda v: v * v)) / len(y) AS p FROM ({Y}))"


def d06_samples(spark, d):
    """The vectors with seeded noise at 10 dB: a sum of every sample times its place, and the first sample."""
    x = _waves(spark, d).select("vec_id", "y", G.noisy(F.col("y"), F.lit(10.0), F.col("vec_id")).alias("z"))
    weighed = F.transform(F.zip_with("z", "y", lambda a, b: a - b), lambda v, i: v * (i + 1))
    return x.select("vec_id", F.round(F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v), 6).alias("digest"), F.round(F.element_at("z", 1), 9).alias("first"))


# The generator with fifth powers written as (a**2 % p)**2 % p * a % p.
_POW = lambda x: f"((({x}) * ({x}) % {G.PRIME}) * (({x}) * ({x}) % {G.PRIME}) % {G.PRIME} * ({x}) % {G.PRIME})"
#: (vec_id, i, n): the standard normal sample of every place of a vector.
NOISE = f"""(WITH v AS (SELECT vec_id::BIGINT AS vec_id, unnest(range(0, 2 * len(embedding)))::BIGINT AS c FROM embeddings),
a AS (SELECT *, (vec_id % {G.PRIME} + 12345) % {G.PRIME} AS a, (vec_id % {G.PRIME} * 48271 + 97) % {G.PRIME} AS b FROM v),
b AS (SELECT vec_id, c, ({_POW("a")} + c) % {G.PRIME} AS x, {_POW("b")} AS two FROM a),
e AS (SELECT vec_id, c, ({_POW("x")} + two) % {G.PRIME} AS w FROM b), u AS (SELECT vec_id, c, ({_POW("w")} + 0.5::DOUBLE) / {G.PRIME} AS u FROM e)
SELECT a.vec_id, a.c // 2 AS i, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS n FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.c = a.c + 1 WHERE a.c % 2 = 0)"""
_POWER = "list_sum(list_transform(y, lambda v: v * v)) / len(y) + 1e-12"
D06_SAMPLES = f"""WITH s AS (SELECT vec_id, y, i, n, sqrt(({_POWER}) / 10) AS sigma FROM ({Y}) JOIN {NOISE} USING (vec_id))
SELECT vec_id, round(sum(sigma * n * (i + 1)), 6) AS digest, round(any_value(y[1]) + max(CASE WHEN i = 0 THEN sigma * n END), 9) AS first FROM s GROUP BY vec_id"""


def _heard_symbols(y):
    return F.array_join(C.collapse(F.transform(y, lambda v: F.when(v > 0.1, 2).when(v < -0.1, 1).otherwise(0))), "")


def a16_noise(spark, d):
    """A noise sweep over samples: the symbols heard through noise at every level against those heard without,
    with error rates by level."""
    x = spread(table(spark, d, "embeddings")).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("y"))
    levels = F.array(*[F.lit(v).cast("double") for v in (None, 20.0, 10.0, 5.0, 0.0)])
    x = x.select("vec_id", "y", F.explode(levels).alias("snr"))
    z = F.when(F.col("snr").isNull(), F.col("y")).otherwise(G.noisy(F.col("y"), F.col("snr"), F.col("vec_id")))
    x = x.select("snr", _heard_symbols(F.col("y")).alias("r"), _heard_symbols(z).alias("h"))
    x = x.select(snr_label(F.col("snr")).alias("label"), F.levenshtein("r", "h").cast("long").alias("errors"), F.length("r").cast("long").alias("n"))
    return x.groupBy("label").agg(F.sum("errors").alias("errors"), F.sum("n").alias("symbols")).select("label", "errors", "symbols", F.round(F.try_divide("errors", "symbols"), 9).alias("cer"))


_SYMBOLS = """array_to_string(list_filter(list_transform({s}, lambda v, i: CASE WHEN i = 1 OR v <> {s}[i - 1] THEN v END), lambda v: v IS NOT NULL AND v <> 0), '')"""
_SIGN = "lambda v: CASE WHEN v > 0.1 THEN 2 WHEN v < -0.1 THEN 1 ELSE 0 END"
A16_NOISE = f"""WITH l AS (SELECT unnest(['clean', '20 dB', '10 dB', '5 dB', '0 dB']) AS label, unnest([NULL, 20.0, 10.0, 5.0, 0.0]) AS snr),
s AS (SELECT vec_id, y, label, i, y[i + 1] + CASE WHEN snr IS NULL THEN 0 ELSE sqrt(({_POWER}) / pow(10, snr / 10)) * n END AS z FROM ({Y}) JOIN {NOISE} USING (vec_id), l),
w AS (SELECT vec_id, label, any_value(y) AS y, list(z ORDER BY i) AS z FROM s GROUP BY ALL),
q AS (SELECT label, list_transform(y, {_SIGN}) AS a, list_transform(z, {_SIGN}) AS b FROM w),
t AS (SELECT label, {_SYMBOLS.format(s="a")} AS r, {_SYMBOLS.format(s="b")} AS h FROM q)
SELECT label, sum(levenshtein(r, h))::BIGINT AS errors, sum(length(r))::BIGINT AS symbols, round(sum(levenshtein(r, h)) / sum(length(r)), 9) AS cer FROM t GROUP BY label"""


def d02_values(spark, d):
    """Samples of the vectors after resampling from half and from three quarters of the rate: sum, sum by place, and one sample."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def go(y: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([G.resample(np.asarray(v), int(r)) for v, r in zip(y, rate, strict=True)])

    x = _waves(spark, d).filter("vec_id % 4 = 0").withColumn("rate", F.when(F.col("vec_id") % 8 == 0, 8000).otherwise(12000)).withColumn("x", go("y", "rate"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", "rate", F.size("x").cast("long").alias("n"), F.round(total("x"), 6).alias("total"), F.round(total(F.transform("x", lambda v, i: v * i)), 5).alias("moment"), F.round(F.element_at("x", 21), 9).alias("one"))


# The filter from its definition: a windowed sinc whose window is a ratio of Bessel series, at the distance of an output's place from each sample.
D02_VALUES = f"""WITH r AS (SELECT * FROM (VALUES (8000, 2, 1), (12000, 4, 3)) t(rate, up, down)),
h AS (SELECT rate, up, down, t, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / up) / (pi() * t / up) END / up * list_sum(list_transform(range(0, 40), lambda k: pow(2.5 * sqrt(greatest(0, 1 - pow(t / (10.0 * up), 2))), 2 * k) / pow(gamma(k + 1), 2)))
  / list_sum(list_transform(range(0, 40), lambda k: pow(2.5, 2 * k) / pow(gamma(k + 1), 2))) AS h FROM (SELECT *, unnest(range(-10 * up, 10 * up + 1)) AS t FROM r)),
g AS (SELECT *, up * h / sum(h) OVER (PARTITION BY rate) AS g FROM h),
v AS (SELECT vec_id, CASE WHEN vec_id % 8 = 0 THEN 8000 ELSE 12000 END AS rate, y, unnest(range(0, len(y))) AS j FROM ({Y}) WHERE vec_id % 4 = 0),
o AS (SELECT vec_id, v.rate, (v.j * up + t) // down AS k, sum(y[v.j + 1] * g) AS x FROM v JOIN g ON g.rate = v.rate AND (v.j * up + t) % down = 0 AND v.j * up + t >= 0 AND (v.j * up + t) // down < ceil(len(y) * up / down) GROUP BY ALL)
SELECT vec_id, rate, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * k), 5) AS moment, round(max(CASE WHEN k = 20 THEN x END), 9) AS one FROM o GROUP BY ALL"""


def d01(spark, d):
    """Downmix of a vector and its reverse."""
    x = _waves(spark, d).select("vec_id", G.downmix(F.array("y", F.reverse("y"))).alias("m"))
    return x.select("vec_id", F.round(F.element_at("m", 1), 9).alias("first"), F.round(F.element_at("m", 32), 9).alias("middle"))


D01 = f"SELECT vec_id, round((y[1] + y[-1]) / 2, 9) AS first, round((y[32] + y[-32]) / 2, 9) AS middle FROM ({Y})"


def d07(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("f"))
    return p.select("p_partkey", F.round(G.hz_to_mel(F.col("f")), 6).alias("mel"), F.round(G.mel_to_hz(G.hz_to_mel(F.col("f"))), 4).alias("hz"))


D07 = "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(700 * (pow(10, log10(1 + p_retailprice / 700)) - 1), 4) AS hz FROM part"


def d08(spark, d):
    """The filter bank at the prices of parts, taken as frequencies: the bands that hear one, and their weights."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("f"))
    x = p.select("p_partkey", F.posexplode(G.mel_bank(F.col("f"))).alias("band", "weight")).filter("weight > 0")
    return x.select("p_partkey", "band", F.round("weight", 10).alias("weight"))


_EDGES = f"SELECT k, 700 * (pow(10, k * log10(1 + {G.RATE / 2} / 700) / {G.MELS + 1}) - 1) AS hz FROM range(0, {G.MELS + 2}) t(k)"
_TRIANGLE = "greatest(0, least(({f} - a.hz) / (m.hz - a.hz), (r.hz - {f}) / (r.hz - m.hz))) * 2 / (r.hz - a.hz)"
D08 = f"""WITH e AS ({_EDGES}) SELECT p_partkey, a.k::INT AS band, round({_TRIANGLE.format(f="p_retailprice")}, 10) AS weight
FROM part JOIN e a ON a.hz < p_retailprice JOIN e m ON m.k = a.k + 1 JOIN e r ON r.k = a.k + 2 AND r.hz > p_retailprice"""
#: The bank at the bins of a frame, as rows (band, bin, weight).
BANK = f"""WITH e AS ({_EDGES})
SELECT a.k AS band, b.k::INT AS bin, {_TRIANGLE.format(f="b.k * 40.0")} AS weight
FROM e a JOIN e m ON m.k = a.k + 1 JOIN e r ON r.k = a.k + 2, range(0, 201) b(k) WHERE weight > 0"""


def d12(spark, d):
    weighed = F.transform(G.pcm16(F.col("y")), lambda v, i: v.cast("long") * (i + 1))
    return _waves(spark, d).select("vec_id", F.aggregate(weighed, F.lit(0).cast("long"), lambda a, v: a + v).alias("digest"))


D12 = f"SELECT vec_id, list_sum(list_transform(y, lambda v, i: trunc(greatest(-1, least(1, v)) * 32767)::BIGINT * i))::BIGINT AS digest FROM ({Y})"


def d13(spark, d):
    """Chunks of 24 samples with their sizes; silence instead of an empty chunk."""
    x = _waves(spark, d).select("vec_id", F.transform(G.chunks(F.col("y"), 24), lambda c: F.size(G.silence_if_empty(c))).alias("n"))
    return x.select("vec_id", F.array_join("n", ",").alias("sizes"))


D13 = f"SELECT vec_id, array_to_string(list_transform(range(0, (len(y) - 1) // 24 + 1), lambda k: least(24, len(y) - k * 24)), ',') AS sizes FROM ({Y})"


def d14(spark, d):
    """Envelope of ten points."""
    return _waves(spark, d).select("vec_id", F.posexplode(G.envelope(F.col("y"), 10)).alias("point", "top"))


D14 = f"""SELECT vec_id, k::INT AS point, round_even(list_max(list_transform(y[(k * len(y)) // 10 + 1:((k + 1) * len(y)) // 10], lambda v: abs(v))), 3) AS top FROM ({Y}), range(0, 10) t(k)"""


def d15(spark, d):
    return _waves(spark, d).select("vec_id", F.size(G.pad(F.col("y"), 100)).cast("long").alias("n"), F.round(F.element_at(G.pad(F.col("y"), 100), 64), 9).alias("last"))


D15 = f"SELECT vec_id, greatest(len(y), 100)::BIGINT AS n, round(y[64], 9) AS last FROM ({Y})"


def a11(spark, d):
    """Mean, population deviation and maximum of every vector."""
    mean, std, top = G.moments(F.col("y"))
    return _waves(spark, d).select("vec_id", F.round(mean, 9).alias("mean"), F.round(std, 9).alias("std"), F.round(top, 9).alias("top"))


A11 = f"SELECT vec_id, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(max(v), 9) AS top FROM (SELECT vec_id, unnest(y) AS v FROM ({Y})) GROUP BY 1"


def x07(spark, d):
    """CTC collapse: runs of equal symbols become one, blanks (0) go."""
    x = _waves(spark, d).select("vec_id", F.transform("y", lambda v: F.when(v > 0.1, 2).when(v < -0.1, 1).otherwise(0)).alias("s"))
    return x.select("vec_id", F.array_join(C.collapse(F.col("s")), "").alias("symbols"))


X07 = f"""SELECT vec_id, array_to_string(list_filter(list_transform(s, lambda v, i: CASE WHEN i = 1 OR v <> s[i - 1] THEN v END), lambda v: v IS NOT NULL AND v <> 0), '') AS symbols
FROM (SELECT vec_id, list_transform(y, lambda v: CASE WHEN v > 0.1 THEN 2 WHEN v < -0.1 THEN 1 ELSE 0 END) AS s FROM ({Y}))"""


def _scores(spark, d):
    """Vectors as score matrices, four symbols a frame."""
    return _waves(spark, d).select("vec_id", G.chunks(F.col("y"), 4).alias("s"))


def x07_greedy(spark, d):
    """The best symbol of every frame, collapsed."""
    return _scores(spark, d).select("vec_id", F.array_join(C.greedy(F.col("s")), "").alias("symbols"))


X07_GREEDY = f"""WITH f AS (SELECT vec_id, list_transform(range(0, len(y) // 4), lambda k: y[k * 4 + 1:k * 4 + 4]) AS f FROM ({Y})),
s AS (SELECT vec_id, list_transform(f, lambda r: list_position(r, list_max(r)) - 1) AS s FROM f)
SELECT vec_id, array_to_string(list_filter(list_transform(s, lambda v, i: CASE WHEN i = 1 OR v <> s[i - 1] THEN v END), lambda v: v IS NOT NULL AND v <> 0), '') AS symbols FROM s"""


def x07_beam(spark, d):
    """The likeliest text of the first four frames by prefix beam search, wide enough to hold all of them."""
    x = _scores(spark, d).select("vec_id", C.beam_search(F.slice("s", 1, 4), 256).alias("b"))
    return x.select("vec_id", F.array_join("b.symbols", "").alias("symbols"), F.round("b.log_p", 6).alias("log_p"))


# All paths of four frames, added up by their text.
X07_BEAM = f"""WITH f AS (SELECT vec_id, t, list_transform(y[t * 4 + 1:t * 4 + 4], lambda v: exp(v)) AS e FROM ({Y}), range(0, 4) r(t)),
p AS (SELECT vec_id, t, k, ln(e[k + 1] / list_sum(e)) AS l FROM f, range(0, 4) r(k)),
q AS (SELECT vec_id, a.k AS a, b.k AS b, c.k AS c, d.k AS d, exp(a.l + b.l + c.l + d.l) AS p
  FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) JOIN p d USING (vec_id) WHERE a.t = 0 AND b.t = 1 AND c.t = 2 AND d.t = 3),
s AS (SELECT vec_id, CASE WHEN a > 0 THEN a::VARCHAR ELSE '' END || CASE WHEN b > 0 AND b <> a THEN b::VARCHAR ELSE '' END || CASE WHEN c > 0 AND c <> b THEN c::VARCHAR ELSE '' END
  || CASE WHEN d > 0 AND d <> c THEN d::VARCHAR ELSE '' END AS symbols, sum(p) AS p FROM q GROUP BY ALL)
SELECT vec_id, symbols, round(ln(p), 6) AS log_p FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) = 1"""

_NAMES = {
    "w01_frames": "w01", "d01_downmix": "d01", "d03_frame_db": "d03", "d04_trim": "d04", "d05_peak": "d05", "d06_noise_level": "d06", "d06_noise_samples": "d06_samples", "a16_noise_errors": "a16_noise", "d02_resample_values": "d02_values", "d07_mel_scale": "d07", "d08_filter_bank": "d08",
    "d12_pcm16": "d12", "d13_chunks": "d13", "d14_envelope": "d14", "d15_padding": "d15", "a11_moments": "a11", "x07_ctc_collapse": "x07", "x07_ctc_greedy": "x07_greedy", "x07_ctc_beam": "x07_beam",
}
QUERIES = {k: globals()[v] for k, v in _NAMES.items()}
ORACLE = {k: globals()[v.upper()] for k, v in _NAMES.items()}
