"""Operators on small fixtures against brute force, with the defined edge cases."""

import hashlib
import math
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from earshot.llm import chat, components, decontaminate, languages, lm_score, mixing, pii, secrets, simhash, suffix_dedup, tokens, topk
from earshot.llm.bitmixer import ORDERS, SLOTS, BitMixer, count_bits, repeats
from earshot.llm.common import find_all, stage, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(150)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(80, i) for i in range(30)]
    passage = prose(40, 999)
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i] if i % 2 else base[i].replace("a", "a", 1) + " tail", "en", "s0", 0) for i in range(10)]
    out += [(200 + i, prose(20 + i, 500 + i) + " " + passage + " " + prose(15, 700 + i), "fr", "s1", 0) for i in range(12)]
    out += [
        (300, None, None, None, None), (301, "", "en", "s0", 0), (302, "x" * 900, "en", "s0", 900), (303, "Ünïcode ñ 日本 " * 40, "fr", None, 0), (304, "12 34", "en", "s2", 5),
        (305, "one", "en", "s2", 3), (0, base[0], "fr", "s0", len(base[0])), (None, base[3], "en", "s1", 0), (306, " ".join([passage] * 30), "en", "s0", 0),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    return df.withColumns({c: F.lit(1) for c in ("fp", "row", "hits", "base", "spans", "_text", "score", "size", "target")})


# ------------------------------------------------------------- helpers


def test_word_count(spark):
    texts = [None, "", " ", "a", "a b", "a  b", "\na\tb\r\n c ", "x y", "é ü\nñ", "a\x0bb\x0cc", "a \nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_find_all(spark):
    r = random.Random(2)
    texts = ["", "aa", "xaay", "é😀aa aaa"] + ["".join(r.choice("ab é😀") for _ in range(n)) for n in (50, 3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(find_all(F.col("t"), "a+b?").alias("s")).collect()
    for t, row in zip(texts, got, strict=True):
        assert [(x.start, x.end, x.hit) for x in row.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", t)]


# ------------------------------------------------------------- 1


def brute_suffix(rows):
    seen, out = set(), {}
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t, *_ in rows}, key=lambda x: x[0])
    for i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("share", [1.0, 0.004])
def test_suffix_dedup(spark, docs, rows, share, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    want = brute_suffix(rows)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = -(2**63) if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[key], r.doc_id


def test_suffix_family():
    family, seen, r = suffix_dedup.Family(), {}, np.random.default_rng(4)
    gone = set()
    for batch in range(20):
        data = r.integers(97, 99, (60, 7)).astype(np.uint8)
        keys = np.zeros((60, 100), np.uint8)
        keys[:, :7] = data
        ids, lo = r.integers(0, 50, 60), r.integers(0, 9000, 60)
        level = suffix_dedup.Level(np.ascontiguousarray(keys).view("S100").ravel(), ids, np.zeros(60, np.int64), lo)
        for key, place in zip(map(bytes, data), zip(ids.tolist(), lo.tolist(), strict=True), strict=True):
            seen.setdefault(key, set()).add(place)
        for x in family.add(level):
            gone |= set(zip(x.ids.tolist(), x.lo.tolist(), strict=True))
        assert all(len(a) >= len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))
    assert sum(map(len, family.levels)) == len(seen)
    assert gone == {p for places in seen.values() for p in places - {min(places)}} | (gone & {min(p) for p in seen.values()})


# ------------------------------------------------------------- 2


def test_languages(spark):
    a, b = "qu eau oi ent".split(), "sch ung ich keit".split()
    r = random.Random(1)
    text = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))
    train = [(i, text(a if i % 2 else b, 30), "fr" if i % 2 else "de") for i in range(60)]
    names, model = languages.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert names == ["de", "fr"]
    test = [(1, text(a, 40)), (2, text(b, 40)), (3, text(a, 30) + " " + text(b, 30)), (4, None), (5, ""), (6, "12 34 !"), (None, text(a, 3)), (8, text(b, 5000))]
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame(test, "doc_id long, text string"), names, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 4, 5, 6, None, 8)] == ["fr", "de", "und", "und", "und", "fr", "de"]
    assert {m.lang for m in got[3].mixture} == {"fr", "de"} and 0.3 < got[3].score < 0.7
    assert got[4].score == 0 and len(got[1].mixture) == 1
    empty, nothing = languages.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert languages.identify(spark.createDataFrame(test, "doc_id long, text string"), empty, nothing).filter("lang_pred <> 'und'").count() == 0


def brute_mixture(text, names, model):
    """The same definition in plain loops."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    if not any(c != " " for c in letters):
        return "und", 0.0
    padded, seen = [" ", *letters, " "], {}
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if (a, b) != (" ", " "):
            h = ord(a) * 0x9E3779B97F4A7C15 ^ ord(b) * 0xC2B2AE3D27D4EB4F % 2**64 ^ ord(c) * 0x165667B19E3779F9 % 2**64
            at = (h % 2**64) * 0xFF51AFD7ED558CCD % 2**64 >> 51
            seen[at] = seen.get(at, 0) + 1

    def em(columns):
        pi = [1 / len(columns)] * len(columns)
        total = lambda at: sum(s * model[at, k] for s, k in zip(pi, columns, strict=True))
        for _ in range(languages.EM_STEPS if len(columns) > 1 else 0):
            new = [s * sum(n * model[at, k] / total(at) for at, n in seen.items()) / sum(seen.values()) for s, k in zip(pi, columns, strict=True)]
            pi = new
        return pi, sum(n * np.log(total(at)) for at, n in seen.items())

    pi, _ = em(range(len(names)))
    order = sorted(range(len(names)), key=lambda k: (-pi[k], k))
    best = None
    for k in range(1, len(names) + 1):
        shares, like = em(order[:k])
        value = like / 3 - 0.5 * np.log(sum(seen.values()) + 1) * (k - 1)
        if best is not None and value <= best[0]:
            break
        best = value, sorted(zip((-s for s in shares), order[:k], strict=True))[0]
    return names[best[1][1]], min(1.0, -best[1][0])


def test_languages_brute_force(spark, docs, rows):
    texts = [prose(30, i) for i in range(5)] + [rows[0][1] + " Ünïcode ñ 日本" * 9, "😀", "😀 1 2", "𝒳", "a", "x9 y"]
    names, model = languages.fit(docs.filter("lang is not null"))
    twice = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "mixture", "_text", "lang")})
    got = languages.identify(twice, names, model).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        lang, score = brute_mixture(texts[r.doc_id], names, model)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9), texts[r.doc_id]
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {6, 7}
    assert languages.identify(twice.limit(0), names, model).count() == 0


def test_languages_held_out(spark, sf):
    got = languages.op2_languages(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


# ------------------------------------------------------------- 3


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    r = random.Random(9)
    pieces = ["a.b@c.d", "x@y", "é ", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", " ", "-", "@", "_k@e.fg-h.i", "0001.2.3.255", "1.2.3.4.5.6.7.8", "日本"]
    texts = [None, "", "a@b.c_d@e.f", "1" * 5000, "a." * 3000 + "@b" + ".c" * 3000, "+" * 50] + ["".join(r.choice(pieces) for _ in range(30)) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii.spans_of(F.col("text")).alias("s")).collect()
    for row in got:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in row.s if s.base] == brute_pii(texts[row.doc_id]), texts[row.doc_id]


ADDED = [
    ("my iban GB82WEST12345698765432 ok", "iban", True), ("GB82 WEST 1234 5698 7654 32", "iban", True), ("GB83WEST12345698765432", "iban", False), ("ssn 123-45-6789", "ssn", True),
    ("part 123-45-6789", "ssn", False), ("amex card 378282246310005", "pan", True), ("number 378282246310005", "pan", False), ("card" + " far away" * 9 + " 378282246310005", "pan", False), ("call 030 1234567 now", "tel", True),
    ("tel: +49 30 1234567", "tel", False), ("see 378282246310005 credit card", "pan", True),
    ("card 378282246310005 and 371449635398431", "pan", True), ("número de tarjeta 378282246310005", "pan", True), ("123-45-6789 (numéro de sécurité)", "ssn", True), ("in 030 1234567 now", "tel", False),
]


def test_pii_added(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ADDED)] + [(None, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "hit", "start")})
    got = {x.doc_id: {s.kind for s in x.spans} for x in pii.find_pii(df.unionByName(df)).collect()}
    for i, (text, kind, found) in enumerate(ADDED):
        assert (kind in got[i]) == found, text
    assert got[None] == set() and pii.find_pii(df.limit(0)).count() == 0


def test_context_reaches_across_matches(spark):
    """Context is what stands 48 characters before and after, other matches included."""
    from earshot.llm.common import CONTEXT, judge_all

    r = random.Random(12)
    texts = ["", "a@b.c", "a@b.ca@b.c"] + ["".join(r.choice(["a@b.c", "é😀", " ", "card ", "x" * 60, "k.l@m.n-o.p "]) for _ in range(n)) for n in (5, 40, 400)]
    pattern = r"[a-z.]+@[a-z]+(?:\.[a-z]+)"
    near = judge_all(F.col("t"), pattern, lambda h: h["hit"] != "a@b.ca", lambda h, n: F.struct(h["start"], h["end"], n))
    for t, row in zip(texts, spark.createDataFrame([(t,) for t in texts], "t string").select(near.alias("s")).collect(), strict=True):
        want = [(m.start(), m.end(), t[max(0, m.start() - CONTEXT) : m.start()] + " " + t[m.end() : m.end() + CONTEXT]) for m in re.finditer(pattern, t) if m.group() != "a@b.ca"]
        assert [tuple(x) for x in row.s or []] == want


def test_pii_of_one_long_text_is_linear(spark):
    """Forty and eighty thousand matches in one text."""
    took = {}
    for n in (1000, 40_000, 80_000):
        df = spark.createDataFrame([("1.2.3.4 " * n,)], "text string")
        start = time.time()
        assert df.select(F.size(pii.spans_of(F.col("text")))).first()[0] == n
        took[n] = time.time() - start
    assert took[80_000] < 3 * took[40_000] + 2, took


# ------------------------------------------------------------- 4


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "&lt;s&gt; &amp;amp; <s>", "a\nb</s>\n", "", None, "&#10;", "é😀<>"]
    rows = [(c, i, ("user", "assistant", "sy\nstem<")[i % 3], nasty[(i + c) % len(nasty)]) for c in range(5) for i in range(c * 3 + 1)]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, 1, None, "x"), (8, None, "assistant", "y")] + [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(3)).withColumn("tree", F.lit(1))
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        none_first = lambda x: (x is not None, x if x is not None else "")
        own = sorted((r for r in rows if r[0] == c), key=lambda r: ((r[1] is not None, r[1] or 0), none_first(r[2]), none_first(r[3])))
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[c].masked == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 2, 0.0), (2, 1, 99, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {(r.tree, r.leaf): [] for r in chat.chosen_paths(df, 2).collect()}
    for r in chat.chosen_paths(df, 2).orderBy("depth").collect():
        got[r.tree, r.leaf].append(r.node)
    assert got == {(1, 4): [1, 3, 4], (1, 5): [1, 2, 5], (2, 1): [1]}  # a missing parent is a root, a cycle has no path
    best = {r.leaf for r in chat.chosen_paths(df).filter("tree = 1").collect()}
    assert best == {4}


# ------------------------------------------------------------- 5


def brute_tiles(a, b, seed):
    """Look at every pair of places for the longest run of free tokens; first ones first."""
    in_a, in_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (seed - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not in_a[i + n] and not in_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return out
        in_a[i : i + n] = in_b[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiles():
    a = np.arange(1, 21, dtype=np.uint64)
    b = np.concatenate([np.arange(13, 21), [99, 98], np.arange(1, 13)]).astype(np.uint64)  # halves swapped
    assert decontaminate.tiles(a, b) == [(0, 10, 12), (12, 0, 8)]
    r = np.random.default_rng(3)
    for k in range(80):
        a, b = r.integers(1, 3 + k % 4, r.integers(0, 30)).astype(np.uint64), r.integers(1, 3 + k % 4, r.integers(0, 40)).astype(np.uint64)
        want = brute_tiles(a.tolist(), b.tolist(), 3)
        assert decontaminate.tiles(a, b, 3) == want
        near = decontaminate.tiles(a, decontaminate.near_seeds(a, b, 3), 3)
        assert [(x, n) for x, _, n in near] == [(x, n) for x, _, n in want]
    same = np.full(20_000, 7, np.uint64)
    assert decontaminate.tiles(same, same) == [(0, 0, 20_000)]


def test_tokens_beyond_ascii():
    count = lambda t: len(tokens.token_hashes([t])[0])
    assert [count(t) for t in ("“say” – it’s", "日本語 ok", "naïve café", "a…b", None, "")] == [3, 4, 2, 2, 0, 0]
    assert np.array_equal(tokens.token_hashes(["“Quoted words—here”"])[0], tokens.token_hashes(['"quoted words-here"'])[0])


def test_decontaminate(spark, docs, monkeypatch):
    item = prose(40, 999)
    words = item.split()
    bench = spark.createDataFrame([(1, item), (2, prose(30, 4321)), (3, None), (4, "too short"), (5, item)], "item_id long, text string")
    swapped = " ".join(words[20:]).upper() + "! " + prose(9, 8) + " -- " + ", ".join(words[:20])
    half = " ".join(words[:18])
    more = spark.createDataFrame([(900, swapped), (901, half), (902, item), (902, item)], "doc_id long, text string")
    for bits in (1 << 26, 0):  # a bitmap that is full lets everything through
        if not bits:
            monkeypatch.setattr(decontaminate, "_bitmap", lambda seeds: np.full(1 << 23, 255, np.uint8))
        got = decontaminate.contamination(docs.select("doc_id", "text").unionByName(more), bench).select("doc_id", F.inline("hits")).collect()
        found = sorted((r.doc_id, r.item_id) for r in got)
        assert found == sorted((d, i) for d in [*range(200, 212), 306, 900, 902, 902] for i in (1, 5))
        assert all(r.item_tokens == 40 and r.covered >= 32 and r.n_tiles == (2 if r.doc_id == 900 else 1) for r in got)
    for x, y in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.contamination(x, y).filter(F.size("hits") > 0).count() == 0


# ------------------------------------------------------------- 6


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    taken = dict.fromkeys(names, 0)
    kinds = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for i, t, _, s, _ in rows}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    smallest = {s: min(n for (_, n), k in kinds.items() if k == s and n) for s in names}
    for s in names:
        assert abs(taken[s] - target[s]) <= max(smallest[s], 0.01 * target[s]), s
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_sub_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUB_CELL", 7)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "a").otherwise("b").alias("source"), F.lit("w w w").alias("text"))
    per = {r.source: r for r in mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("m"), F.min("copies").alias("k")).collect()}
    for r in per.values():
        assert abs(r.t - r.g) <= 3 and r.m - r.k <= 1


def numpy_rates(size, n, target, cap):
    """The same dual solved alone, by bisection."""
    mean = (size * n).sum() / n.sum()
    words = lambda lam: (n * size * np.minimum(cap, np.exp(np.minimum(lam * size / mean, np.log(cap))))).sum()
    lo, hi = -60.0 * mean / size.min(), 60.0 * mean / size.min()
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
    return np.minimum(cap, np.exp(np.minimum(lo * size / mean, np.log(cap))))


@pytest.mark.parametrize("long", [mixing.LONG, 30])
def test_mixing_rates_against_a_solver(spark, monkeypatch, long):
    """Multipliers of several sources, and copies that stay near along the sizes."""
    monkeypatch.setattr(mixing, "LONG", long)
    r = np.random.default_rng(6)
    rows = [(s, int(z), int(k)) for s in ("a", "b", "c", None) for z, k in zip(*np.unique(r.geometric(0.01, 400), return_counts=True), strict=True)]
    hist = stage(spark.createDataFrame(rows, "source string, size long, n long"), "t-hist")
    targets = stage(mixing.source_targets(hist, (1, 2, 3), 3), "t-targets")
    cells = mixing.tilts(hist, targets, 3).collect()
    assert len(cells) == len(rows)
    for t in targets.collect():
        own = sorted((c for c in cells if c.source == t.source), key=lambda c: -c.size)
        size, n, m = (np.array([getattr(c, k) for c in own], float) for k in ("size", "n", "m"))
        rate = np.array([c.rate for c in own])
        assert np.allclose(rate, numpy_rates(size, n, t.target, 3), rtol=1e-6)
        assert (m <= 3 * n).all() and (m >= 0).all()
        off = np.cumsum(m * size - n * size * rate)
        assert np.abs(off).max() <= size.max() and abs((m * size).sum() - t.target) <= (size.min() if long > 1000 or size.min() < long else size.max() / 2) + 1


def test_mixing_many_sizes_in_one_source(spark):
    """A hundred thousand sizes: no single task has them all, and it ends soon."""
    hist = stage(spark.range(1, 100_001).select(F.lit("s").alias("source"), F.col("id").alias("size"), (F.col("id") % 3 + 1).alias("n")).union(spark.sql("select 't', 5L, 10L")), "t-hist")
    targets = stage(mixing.source_targets(hist, (1, 2, 3), 3), "t-targets")
    start = time.time()
    got = mixing.tilts(hist, targets, 3).groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("w"), F.count(F.lit(1)).alias("k"))
    by = {x.source: x for x in got.collect()}
    want = {x.source: x.target for x in targets.collect()}
    assert by["s"].k == 100_000 and abs(by["s"].w - want["s"]) <= 1 + mixing.CLOSE * want["s"] and abs(by["t"].w - want["t"]) <= 5
    assert time.time() - start < 120


# ------------------------------------------------------------- 7


def test_lm_scores(spark, docs, rows):
    got = lm_score.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(got) == len(rows)
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    count = {}
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, len(words(t)), sum(w in count for w in words(t)), n, round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_without_learning(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    got = lm_score.score_texts(df, F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(got)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def brute_repeats(tokens):
    """Token by token, with plain counters."""
    two, three, runs, agree, run, w, out, pending = {}, {}, {}, {}, 0, [0.6, 0.6], [], []
    for i in range(2, len(tokens)):
        key, t = tuple(tokens[i - 2 : i]), tokens[i]
        guess, third = two.get(key), three.get(tuple(tokens[i - 3 : i])) if i > 2 else None
        if guess is not None:
            gates = (runs, min(run, 15), 1 - 0.9 / (1 + 2 * min(run, 15))), (agree, 0 if third is None else 2 if third == guess else 1, (0.2, 0.05, 0.8)[0 if third is None else 2 if third == guess else 1])
            ins = []
            for held, g, prior in gates:
                ones, n = held.get(g, (0, 0))
                q = (ones + 2 * prior) / (n + 2)
                ins.append(math.log(q / (1 - q)))
                held[g] = ones + (guess == t), n + 1
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, ins, strict=True))))
            out.append((i, guess == t, min(max(p, 1e-5), 1 - 1e-5)))
            pending.append(((guess == t) - p, ins))
            if len(pending) == 32:
                w = [x + 0.02 * sum(e * v[k] for e, v in pending) for k, x in enumerate(w)]
                pending = []
        run = run + 1 if guess == t else 0
        two[key] = t
        if i > 2:
            three[tuple(tokens[i - 3 : i])] = t
    return out


def test_repeats_of_many_texts_at_once():
    """Texts side by side give what each gives alone."""
    r = np.random.default_rng(8)
    texts = [r.integers(0, k, n) for k, n in ((5, 400), (2, 1), (3, 2), (3, 3), (4, 4), (50, 900), (1, 100), (2, 700))] + [np.tile(r.integers(0, 90, 37), 5) for _ in range(9)]
    want, start = [], 0
    for x in texts:
        want += [(at + start, hit, p) for at, hit, p in zip(*(v.tolist() for v in repeats(x)), strict=True)]
        start += len(x)
    got = list(zip(*(v.tolist() for v in repeats(np.concatenate(texts), np.repeat(np.arange(len(texts)), list(map(len, texts))))), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want, strict=True))


def test_repeats():
    r = np.random.default_rng(6)
    line = r.integers(0, 50, 20)
    for x in (r.integers(0, 4, 300), np.concatenate([line] * 9), r.integers(0, 9, 3), np.zeros(200, np.int64), np.concatenate([r.integers(0, 50, 70), line, r.integers(0, 3, 60), line])):
        got = list(zip(*(v.tolist() for v in repeats(x)), strict=True))
        want = brute_repeats(x.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_lm_score_brute_force(spark):
    """The score from its definition, given the spelling's probability; no floor."""
    r = random.Random(3)
    rows = [(i, prose(r.randrange(5, 60), 100 + i), r.choice(["en", "fr", None])) for i in range(60)] + [(70, "q" * 1000, "en"), (71, "q" * 20_000, "en"), (72, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("batch", "part", "tokens", "class")})
    got = {x.doc_id: x for x in lm_score.score_texts(df, F.col("doc_id") < 50).collect()}
    words = {i: lm_score.words((t or "").encode()) for i, t, _ in rows}
    by, total = {}, {}
    for i, _, lang in rows[:50]:
        for w in words[i]:
            by.setdefault(lang, {})[w] = by.get(lang, {}).get(w, 0) + 1
            total[w] = total.get(w, 0) + 1
    n, once = sum(total.values()), sum(c == 1 for c in total.values())
    new = min(max(once / n, 1e-6), 0.5)
    counts = np.zeros((len(ORDERS), SLOTS, 2), np.uint32)
    count_bits([w for w in total if w], counts)
    parts = lm_score.partitions(spark)
    mixers, sizes = [], []
    for p in range(parts):  # as the tasks learn them
        own = [w for w in total if w and zlib.crc32(w) % parts == p]
        if own:
            m = BitMixer(counts)
            cells = m.learn(sorted(own, key=lambda t: zlib.crc32(t, 2)))
            mixers.append((m.weights, cells))
            sizes.append(len(own))
    m = BitMixer(counts)
    m.weights = sum(w * k for (w, _), k in zip(mixers, sizes, strict=True)) / sum(sizes)
    m.refine(sum(c for _, c in mixers))
    for i in (0, 3, 55, 59, 70, 71, 72):
        spelled = m.log10(words[i])
        index = {w: k for k, w in enumerate(dict.fromkeys(words[i]))}
        told = {place: (hit, p) for place, hit, p in brute_repeats([index[w] for w in words[i]])}
        logs = []
        for c in by.values():
            size = sum(c.values())
            p = [(1 - new) * (c.get(w, 0) + lm_score.PRIOR * total.get(w, 0) / n) / (size + lm_score.PRIOR) for w in words[i]]
            each = [s + math.log10(new) if not a else math.log10(a + new * 10**s) for a, s in zip(p, spelled, strict=True)]
            for k, (hit, q) in told.items():
                each[k] = math.log10((1 - q) * 10 ** each[k] + q) if hit else each[k] + math.log10(1 - q)
            logs.append(math.log10(size / n) + sum(each))
        top = max(logs)
        assert got[i].score == pytest.approx(top + math.log10(sum(10 ** (x - top) for x in logs)), rel=2e-3), i
    assert got[71].score < 5 * got[70].score < got[70].score
    assert lm_score.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_bit_mixer_is_a_distribution():
    counts = np.zeros((len(ORDERS), SLOTS, 2), np.uint32)
    types = [w.encode() for w in VOCAB]
    count_bits(types, counts)
    m = BitMixer(counts)
    m.refine(m.learn(types))
    every = [bytes([a]) for a in range(256) if a not in (9, 10, 11, 12, 13, 32)]
    assert (10.0 ** m.log10(every)).sum() < 1
    assert m.log10(types).mean() > m.log10([w[::-1] + b"zz" for w in types]).mean() + 1


# ------------------------------------------------------------- 8


def brute_secrets(t):
    out = []
    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12), ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))
    for i, (kind, p, n) in enumerate(kinds):
        for m in re.finditer(p, t or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= n:
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    r = random.Random(6)
    pieces = ["PassWord", "token", "secret", "api_key", "apikey", ": ", "=", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "xyz.12/3", " ", "é", "0f", "\n"]
    noise = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [None, "", "secret=token:abcdefghijklmnopq", "a" * 4000, "0" * 4000] + ["".join(r.choice(pieces) for _ in range(25)) for _ in range(80)]
    clear = ["get" + "".join(r.choice(VOCAB).capitalize() for _ in range(9)) + str(i % 9) for i in range(40)]
    keys = [f"see {noise()} here" for _ in range(40)]
    words = [prose(70, 3000 + i) for i in range(2500)]  # what words look like
    df = spark.createDataFrame([*enumerate(texts + clear + keys + words), (2, texts[2])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("base", "spans", "_s", "x")})
    out = secrets.find_secrets(df, ("text",)).withColumn("red", secrets.redacted(F.col("text"), F.col("spans"))).collect()
    assert len(out) == df.count()
    got = {x.doc_id: x for x in out}
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i].base] == brute_secrets(t), t
        assert [(s.kind, s.start) for s in got[i].spans if s.kind != "random"] == [(s.kind, s.start) for s in got[i].base]
        if t is not None:
            gone = bytearray(len(t))
            for s in got[i].spans:
                gone[s.start : s.end] = b"\1" * (s.end - s.start)
            assert got[i].red.replace(secrets.MASK, "") == "".join(c for c, g in zip(t, gone, strict=True) if not g)
    flagged = lambda lo, hi: sum(any(s.kind == "random" for s in got[i].spans) for i in range(lo, hi))
    a, b = len(texts), len(texts) + len(clear)
    assert flagged(a, b) == 0 and flagged(b, b + len(keys)) >= 32 and flagged(b + len(keys), len(got)) == 0
    few = secrets.find_secrets(df.filter(F.col("doc_id").between(b, b + 3)))
    assert few.filter(F.size("spans") > 0).count() == 0  # nothing to tell words by
    assert secrets.find_secrets(df.limit(0)).count() == 0


def brute_randomness(token, encoding):
    """The three tests from their textbook formulas; normal tails by erfc."""
    letters = secrets.ALPHABETS[encoding]
    m = len(letters)
    v = [letters.index(c) for c in (token.rstrip("=").lower() if encoding == "hex" else token.rstrip("="))]
    n = len(v)
    upper = lambda z: math.erfc(z / 2**0.5) / 2
    expected = [n * sum(1 for x in range(m) if x * 8 // m == b) / m for b in range(8)]
    chi2 = sum((sum(1 for x in v if x * 8 // m == b) - e) ** 2 / e for b, e in enumerate(expected))
    chi = upper(((chi2 / 7) ** (1 / 3) - (1 - 2 / 63)) / (2 / 63) ** 0.5)  # Wilson and Hilferty
    high = [x * 2 >= m for x in v]
    n1, n2 = sum(high), n - sum(high)
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    p_runs = min(1, 2 * upper(abs(runs - mean) / var**0.5)) if var > 0 else 0
    d = [x - sum(v) / n for x in v]
    sq = sum(x * x for x in d)
    p_serial = min(1, 2 * upper(abs(sum(a * b for a, b in zip(d, d[1:], strict=False)) / sq + 1 / n) * n**0.5)) if sq else 0
    return min(1, 3 * min(chi, p_runs, p_serial))


def test_reference_tokens_take_the_whole_text(spark):
    """The null is made of all words of a text, scored like any token."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(n)) for n in (0, 3, 8, 20, 70, 400)] + ["é" * 50, "word, " * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", secrets.reference(F.col("t")).alias("own")).collect()
    for x in got:
        letters = len(re.sub("[^A-Za-z0-9]", "", x.t))
        taken = sum(secrets.REFERENCE[k.cls - secrets.FIRST_CLASS] for k in x.own)
        assert taken <= letters < taken + (letters // 316 + 1) * min(secrets.REFERENCE) and (letters > 315 or letters < taken + min(secrets.REFERENCE))
    words = [("".join(r.choice(secrets.ALPHABETS["alnum"][: 62 - k % 50]) for _ in range((24, 44, 90)[k % 3])),) for k in range(60)] + [("a" * 24,), ("Ab" * 22,)]
    w = spark.createDataFrame(words, "w string")
    for one, e in ((True, "lower36"), (False, "alnum")):
        token = F.lower("w") if one else F.col("w")
        pairs = w.select(secrets.word_p(F.col("w"), F.lit(one)).alias("a"), secrets.p_value(token, F.lit(e)).alias("b")).collect()
        assert all(abs(p.a - p.b) <= 1e-9 * max(p.b, 1e-3) for p in pairs)


def test_reference_letters_cost_no_search(spark):
    """A letter of the null's tokens costs a look into a table: no search of the alphabet, no sums held as structs."""
    plan = spark.createDataFrame([("some words",)], "t string").select(secrets.reference(F.col("t")).alias("own"))._jdf.queryExecution().optimizedPlan().toString()
    assert "position(" not in plan and "locate(" not in plan and "named_struct(p," not in plan
    r = random.Random(17)
    words = ["".join(r.choice(secrets.ALPHABETS["alnum"]) for _ in range(n)) for n in (2, 24, 90, 127)] + ["0z" * 63, "z" * 127, "0" * 127, "Az" * 45]
    w = spark.createDataFrame([(x,) for x in words], "w string")
    for one, e in ((True, "lower36"), (False, "alnum")):
        got = w.select("w", secrets.word_p(F.col("w"), F.lit(one)).alias("p")).collect()
        for x in got:
            token = x.w.lower() if one else x.w
            assert abs(x.p - brute_randomness(token, e)) <= 1e-6


def test_randomness_brute_force(spark):
    r = random.Random(12)
    rows = [("".join(r.choice(secrets.ALPHABETS[e][: 40 if k % 2 else 9]) for _ in range(20 + 7 * k)) + "=" * (k % 3), e) for e in secrets.ALPHABETS for k in range(6)]
    got = spark.createDataFrame(rows, "t string, e string").select("t", "e", secrets.p_value(F.col("t"), F.col("e")).alias("p")).collect()
    for x in got:
        assert x.p == pytest.approx(brute_randomness(x.t, x.e), rel=1e-3, abs=3e-7), x


# ------------------------------------------------------------- 9


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(rows):
    for _, t, *_ in rows:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def reach(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def flips(r, x, most):
    for b in r.sample(range(64), r.randrange(most + 1)):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("large", [2048, 3])
def test_links_lose_nothing(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    r = random.Random(large)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        fps.append(flips(r, r.choice(fps), 6))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x.node: x.label for x in components.components(simhash.links(df)).collect()}
    groups, want = {}, {}
    for f, c in zip(signed, reach(fps), strict=True):
        want.setdefault(c, set()).add(f)
        groups.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_join_links_in_proportion_to_nodes(spark, monkeypatch):
    """Stars of many tasks over one group, whose links outnumber its members, and odd links."""
    r = random.Random(8)
    group = [r.getrandbits(63) for _ in range(300)]
    pairs = [(u, min(own)) for own in (r.sample(group, 200) for _ in range(40)) for u in own]
    pairs += [(-k, -k - 1) for k in range(1, 12)] + [(5, 9), (9, 5), (9, 5), (7, 9), (4, 4), (-(2**63), 2**63 - 1)]
    staged, real = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: staged.append(real(df, name)) or staged[-1])
    got = {x.node: x.label for x in components.components(spark.createDataFrame(pairs, "u long, v long").repartition(4)).collect()}
    want = {n: n for u, v in pairs if u != v for n in (u, v)}
    for u, v in (p for p in pairs if p[0] != p[1]):
        x, y = sorted((want[u], want[v]))
        want = {n: x if c == y else c for n, c in want.items()}
    assert got == want and len(set(want.values())) == 4
    assert max(d.count() for d in staged) <= len(want) * 1.1
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_blocks_cover_every_pair():
    r = random.Random(3)
    for n in (10, 10**7, 10**9, 10**11):
        masks = simhash._masks(*simhash.blocks_for(n))
        for _ in range(50):
            x = r.getrandbits(64)
            y = flips(r, x, 4)
            assert any(x & m == y & m for m in masks)


def test_near_duplicates(spark, docs, rows):
    got = simhash.near_duplicates(docs.select("doc_id", "text"))
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = {}
    for (i, *_), c in zip(rows, reach(fps), strict=True):
        want.setdefault(c, []).append(i)
    names = {i: min((x for x in g if x is not None), default=None) for g in want.values() for i in g}
    assert {r.doc_id: r.component_id for r in got.collect()} == names
    assert simhash.near_duplicates(docs.select("doc_id", "text").limit(0)).count() == 0


# ------------------------------------------------------------- 10


@pytest.mark.parametrize("side", [1, 2, 16])
def test_top_k(spark, monkeypatch, side):
    monkeypatch.setattr(topk, "ROWS", 37)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 4)
    monkeypatch.setattr(topk, "SIDE", side)
    r = np.random.default_rng(8)
    x = np.round(r.normal(0, 0.2, (150, 8)), 2).astype(np.float32)
    x[40:60] = x[20]  # ties
    good = [*enumerate(x), (600, x[3]), (600, x[3]), (600, x[7]), (7, x[9])]  # repeated ids
    rows = [(i, v.tolist()) for i, v in good] + [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] + [0.0] * 7), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).withColumn("row", F.lit("x"))
    index = stage(topk.quantised(df), "t")
    got = sorted((s.query_id, s.rank, s.vec_id, s.score) for s in topk.top_k(index, index.filter("vec_id % 20 = 0"), 20).collect())
    whole = [(i, np.floor(64 * v.astype(float)).astype(int)) for i, v in good]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for m, (j, v) in enumerate(whole) if m != n)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert got == sorted(want)
    few = stage(topk.quantised(df.filter("vec_id in (0, 1, 2)")), "t")
    assert topk.top_k(few, few, 20).count() == 6
    none = topk.quantised(df.limit(0))
    assert topk.top_k(none, none).count() == 0
