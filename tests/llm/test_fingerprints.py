"""Fingerprints against the definition in plain loops."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from earshot.llm import fingerprints as P

SCHEMA = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(data, seed):
    return xxhash.xxh64_intdigest(data, seed)


def chained(values, kind="<q", seed=42):
    for v in values:
        seed = xx(struct.pack(kind, v), seed)
    return seed


def brute_fingerprint(text):
    words = [signed(xx(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    if not words:
        return [0] * P.BINS
    runs = [words[i : i + P.SHINGLE] for i in range(len(words) - P.SHINGLE + 1)] or [words]
    least = {}
    for h in (chained(r) for r in runs):
        place = ((h >> 56) + 128) % 256  # signed order
        least[place] = min(least.get(place, 1 << 64), h)
    out = []
    for i in range(P.BINS):
        place = i if i in least else None
        for t in range(P.PROBES):
            j = signed(chained([i, t], "<i")) % P.BINS
            if place is None and j in least:
                place = j
        if place is None:
            place = min(least, key=lambda j: signed(chained([j, i], "<i")))
        out.append(least[place] & 15)
    return out


def prose(n, seed, v=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(v)}" for _ in range(n))


TEXTS = [None, "", " \t\n", "one", "One\ntwo  three ", prose(5, 1), prose(9, 2), prose(60, 3), prose(400, 4), prose(5000, 5, 9000), "é😀 日本 " * 30, "x" * 5000, "a a a a a a a a a"]


def test_fingerprint_brute_force(spark):
    got = P.fingerprints(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)).select("doc_id", P.digits(F.col("fingerprint")).alias("f")).collect()
    for r in got:
        assert [int(c, 16) for c in r.f] == brute_fingerprint(TEXTS[r.doc_id]), r.doc_id


def test_likeness_follows_similarity(spark):
    r, pairs = random.Random(8), []
    for share in (0.0, 0.01, 0.03, 0.1, 0.3, 1.0):
        for k in range(8):
            a = prose(700, hash((share, k)) % 9999, 5000).split()
            pairs.append((" ".join(a), " ".join(w if r.random() >= share else f"n{r.randrange(10**6)}" for w in a)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("j")).collect()
    off = []
    for x in got:
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x.a, x.b))
        true = len(a & b) / len(a | b)
        off.append(x.j - true)
        assert 0 <= x.j <= 1 and abs(off[-1]) < 0.15
    assert abs(sum(off)) / len(off) < 0.02  # no bias
    ends = spark.createDataFrame([("", None), ("", "a"), ("a", "a")], "a string, b string").select(P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("j"))
    assert [x.j for x in ends.collect()] == [1.0, 0.0, 1.0]


def brute_next(rows):
    """Pairs (id, text, next text) in the stated order."""
    line = sorted(((-(-(2**63) if i is None else i), signed(xx((t or "").encode(), 42)), i, t or "") for i, t in rows), key=lambda x: x[:2])
    return sorted((str(a[2]), a[3], b[3]) for a, b in zip(line, line[1:] + line[:1], strict=True))


@pytest.mark.parametrize("case", ["plain", "one", "none", "repeats", "wide", "nulls"])
def test_next_document(spark, case):
    r = random.Random(case)
    rows = {
        "plain": [(i * 3, prose(r.randrange(12), i)) for i in range(300)],
        "one": [(7, "only")],
        "none": [],
        "repeats": [(r.randrange(9), prose(3, r.randrange(40))) for _ in range(200)] + [(4, prose(2, i)) for i in range(150)],
        "wide": [(x, str(x)) for x in (-(2**63), -(2**63) + 1, -5, 0, 2**63 - 1, 2**62)],
        "nulls": [(None, prose(3, i)) for i in range(60)] + [(i, None) for i in range(40)],
    }[case]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("_id", "_cell", "guest", "fingerprint", "next_text", "i2")})
    got = P.with_next(docs).collect()
    assert sorted((str(x.doc_id), x.text, x.next_text) for x in got) == brute_next(rows)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort(reverse=True)
    got = {r.doc_id: r for r in P.op11_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for (i, t), (j, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = sum(a == b for a, b in zip(x.fingerprint, got[j].fingerprint, strict=True)) / P.BINS
        assert x.near_next == pytest.approx(min(1, max(0, (same - 1 / 16) * 16 / 15)))
    for x in list(got.values())[:20]:
        text = dict(docs)[x.doc_id]
        assert [int(c, 16) for c in x.fingerprint] == brute_fingerprint(text)
