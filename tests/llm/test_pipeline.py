"""The pipeline, stage by stage, against plain Python on a small corpus."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import similar
from earshot.llm.common import stage
from tests.llm.test_operators import brute_fingerprint, prose, reach

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    item = prose(40, 999)
    rows = [(i, prose(70, i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(50 + i, prose(70, i), "en", "s0", 0) for i in range(8)]  # copies
    rows += [(60, prose(30, 77) + " " + item, "en", "s1", 0), (61, prose(30, 78) + " " + item + " tail", "en", "s2", 0)]
    rows += [(70, prose(30, 79) + f" token = {KEY} " + prose(30, 80), "en", "s1", 0)]
    rows += [(80, None, "en", "s1", None), (81, "", "en", "s1", 0), (82, "123 456", None, None, 7), (None, prose(50, 90), None, None, 0), (0, prose(70, 0), "en", "s0", 0)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.lit("x") for c in ("_doc", "row", "fp", "spans", "hits", "lang_pred", "component")})
    kept = [(i, t) for i, t, *_ in rows if t and re.search("[^\\W\\d_]", t)]
    ids = lambda x: sorted((-1 if r.doc_id is None else r.doc_id) for r in x.select("doc_id").collect())
    sort = lambda xs: sorted(-1 if x is None else x for x in xs)

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "secret_scan", "mix"]
    run = dict(corpus_pipeline.STAGES)

    one = stage(run["language"](spark, docs, d), "t")
    assert one.columns == docs.columns and ids(one) == sort(i for i, _ in kept)

    two = stage(run["near_dedup"](spark, one, d), "t")
    groups = {}
    for (i, t), c in zip(kept, reach([brute_fingerprint(t) for _, t in kept]), strict=True):
        groups.setdefault(c, []).append((i is None, i, t))
    stay = [min(g) for g in groups.values()]
    assert two.columns == docs.columns and ids(two) == sort(i for _, i, _ in stay)

    three = stage(run["decontaminate"](spark, two, d), "t")
    clean = [(i, t) for _, i, t in stay if prose(40, 999) not in t]
    assert len(clean) == len(stay) - 2 and three.columns == docs.columns and ids(three) == sort(i for i, _ in clean)

    four = stage(run["secret_scan"](spark, three, d), "t")
    assert four.columns == docs.columns and ids(four) == ids(three)
    texts = {r.doc_id: r.text for r in four.collect()}
    for i, t in clean:
        assert texts[i] == (re.sub("token = " + KEY, "[SECRET]", t) if i == 70 else t)
    assert four.filter("doc_id = 70 and n_chars <> length(text)").isEmpty()

    five = run["mix"](spark, four, d).collect()
    assert len(five) == len(clean)
    for s in {r.source for r in five}:
        own = [r for r in five if r.source == s]
        assert own[0].source_size == sum(len(texts[r.doc_id].split()) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in own)


def test_run_is_the_stages_and_empty_tables_pass(spark, corpus, tmp_path):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, d), "t")
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == sorted(map(str, docs.collect()))
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_by_similarity(spark):
    """Replaced words: every pair of similarity 0.8 or more is linked, no other."""
    rng = random.Random(3)
    texts = []
    for k in range(120):
        words = prose(rng.randint(60, 400), 1000 + k).split()
        texts.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            for _ in range(max(1, len(words) * rng.choice([1, 2, 4]) // 100)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for k in range(0, len(texts), 3):  # least ids, by pairs until nothing changes
        for _ in range(2):
            for i in range(k, k + 3):
                for j in range(k, k + 3):
                    if jaccard(texts[i], texts[j]) >= 0.8:
                        root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert 120 < len(set(root)) < 330 and kept == set(root)


def test_similar_rows_brute_force(spark, monkeypatch):
    """A star of copies around one text, split into small chunks, against all pairs."""
    monkeypatch.setattr(similar, "CHUNK", 16)
    rng = random.Random(4)
    hub = prose(120, 5000).split()
    texts = [" ".join(hub), " ".join(hub), None, "", "one", "a b c d", "a b c d"]
    for _ in range(90):
        copy = list(hub)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            alike = jaccard(a or "", b or "") >= 0.8
            if alike and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    got = {r.row: r.component_id for r in similar.similar_rows(rows, 5, 0.8).collect()}
    assert got == dict(enumerate(root)) and 5 < len(set(root)) < 80
    assert similar.similar_rows(rows.limit(0), 5, 0.8).count() == 0


def test_forest_spans_what_crossing_finds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[:60], rng.integers(40, 60), False), rng.choice(base, 4)])) for _ in range(80)]
    sim = np.array([similar.simhash(s) for s in sets], np.uint64)
    far = np.bitwise_count(sim[:, None] ^ similar.PIVOT[None, :]).astype(np.uint8)
    keys = np.stack([similar.bands(similar.minima(s)).astype(np.uint32) for s in sets])
    marks = np.stack([np.concatenate([f, (similar.minima(s) >> np.uint32(24)).astype(np.uint8), k.view(np.uint8)]) for f, s, k in zip(far, sets, keys, strict=True)])
    label = np.repeat(np.arange(40), 2)
    m = similar.Members(np.arange(80), label, sim, marks)
    edges, stands = similar.forest(m, 0.7)
    root = label.copy()
    for i, j in edges:
        assert root[i] != root[j]
        root[root == root[i]] = root[j]
    listed = lambda *a: [(i, j) for i, others in similar.crossing(m, 0.7, *a) for j in others.tolist()]
    pairs, best = listed(0), listed()
    alike = {(min(i, j), max(i, j)) for i in range(80) for j in m.near(i, np.arange(80), 0.7)[0].tolist() if label[i] != label[j]}
    assert len(pairs) == len(alike) and {(min(p), max(p)) for p in pairs} == alike
    # A pair is listed in the first band it shares; the best of each label are among all.
    for place in range(similar.BANDS):
        fresh = {p for p in alike if not (keys[p[0], :place] == keys[p[1], :place]).any()}
        assert {(min(p), max(p)) for p in listed(place)} == fresh
    assert {(i, label[j]) for i, j in best} == {(i, label[j]) for i, j in pairs} and set(best) <= set(pairs) and len(best) == len({(i, label[j]) for i, j in best})
    assert pairs and all(root[i] == root[j] for i, j in pairs) and len(stands) == len(set(root.tolist()))


def marks_of(sets):
    sim = np.array([similar.simhash(s) for s in sets], np.uint64)
    far = np.bitwise_count(sim[:, None] ^ similar.PIVOT[None, :]).astype(np.uint8)
    least = [similar.minima(s) for s in sets]
    small = [((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8) for m in least]
    keys = [similar.bands(m) for m in least]
    return sim, np.stack([np.concatenate([a, b, k.astype(np.uint32).view(np.uint8)]) for a, b, k in zip(far, small, keys, strict=True)]), keys


def test_no_pair_at_the_threshold_is_lost():
    """Pairs of similarity 0.8 to 0.9: what bands propose is never dropped later."""
    r = np.random.default_rng(7)
    lost = {0.8: 0, 0.85: 0, 0.9: 0}
    for share in lost:
        for _ in range(700):
            n = 180
            common = int(round(n * 2 * share / (1 + share)))
            base = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            a, b = np.sort(base[:n]), np.sort(base[n - common :])
            sim, marks, keys = marks_of([a, b])
            m = similar.Members(np.array([1, 2]), np.array([1, 2]), sim, marks)
            place = np.flatnonzero(keys[0] == keys[1])
            lost[share] += not (len(place) and list(similar.crossing(m, 0.8 - similar.SLACK, int(place[0]))))
    assert lost[0.8] <= 1 and lost[0.85] == lost[0.9] == 0, lost


def test_large_band_costs_its_outsiders():
    """A band of a hundred thousand members of one component and a few others."""
    import time

    r = np.random.default_rng(2)
    n = 100_000
    own = np.unique(r.integers(0, 1 << 63, 100).astype(np.uint64))
    sim, marks, _ = marks_of([own])
    label = np.where(np.arange(n) % 20_000 == 7, np.arange(n), 3)
    m = similar.Members(np.arange(n), label, np.repeat(sim, n), np.repeat(marks, n, axis=0))
    start = time.time()
    pairs = sum(len(x) for _, x in similar.crossing(m, 0.7, 0))
    outside = int((label != 3).sum())
    assert pairs == outside * (n - outside) + outside * (outside - 1) // 2 and time.time() - start < 20


def spread(marks):
    """The nodes' labels after a list of links between 0 .. n - 1."""
    root = list(range(marks[0]))
    for i, j in marks[1]:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_fingerprints_propose_every_pair_at_the_threshold():
    """Pairs of similarity 0.8 to 0.9 agree in a block of their fingerprints and are near by them."""
    r = np.random.default_rng(11)
    for share in (0.8, 0.85, 0.9):
        lost = 0
        for _ in range(400):
            n = 180
            common = int(round(n * 2 * share / (1 + share)))
            base = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            x, y = (np.frombuffer(similar.wide(np.sort(s)), np.uint8) for s in (base[:n], base[n - common :]))
            sims = np.stack([x, y]).view(np.uint64)
            lost += not ((x == y).any() and len(similar.reached(sims)[0]) == 1)
        assert lost <= (1 if share == 0.8 else 0), (share, lost)


@pytest.mark.parametrize("large", [2048, 64])
def test_cell_links_are_a_forest_of_all_near_pairs(monkeypatch, large):
    """Also where the cell is parted by further bits; never more links than members for each choice."""
    monkeypatch.setattr(similar, "LARGE", large)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (30, similar.WORDS)).astype(np.uint64)
    flips = np.packbits(r.random((300, 64 * similar.WORDS)) < 0.12, axis=1).view(np.uint64)
    sims = base[r.integers(0, 30, 300)] ^ flips
    far = np.bitwise_count(sims[:, None] ^ sims[None]).sum(axis=2)
    want = spread((300, zip(*np.nonzero(far <= similar.WIDE), strict=True)))
    found = list(similar.cell_links(sims))
    assert all(len(i) < 300 for i, _ in found)
    assert spread((300, [p for i, j in found for p in zip(i.tolist(), j.tolist(), strict=True)])) == want and len(set(want)) < 60


def test_links_of_a_near_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies of one text under the threshold: links stay in proportion, and blocks of a large group lose none."""
    rng = random.Random(9)
    hub = prose(150, 6000).split()
    texts = []
    for _ in range(400):
        copy = list(hub)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    rows = stage(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4), "t")
    sets = similar.shingle_sets([t.encode() for t in texts], 5)
    want = spread((400, similar.true_links(sets, 0.8)))
    alike = [(i, j) for i in range(400) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert spread((400, alike)) == want and 50 < len(set(want)) < 390
    nodes = stage(similar.marked(rows, 5).select("fp", "wide"), "t")
    assert similar.proposed(nodes, 4).count() <= 400 * 4
    monkeypatch.setattr(similar, "MOST", 64)
    got = {r.row: r.component_id for r in similar.similar_rows(rows, 5, 0.8).collect()}
    assert [got[i] for i in range(400)] == want
