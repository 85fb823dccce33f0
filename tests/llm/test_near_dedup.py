import random

import numpy as np
import pytest

from sievemark.llm import components as components_module
from sievemark.llm.components import components
from sievemark.llm.near_dedup import _Overlaps, drop_near_duplicates, near_duplicates, spanning_links

DOCS = "doc_id long, text string, component_id string"


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    """component of each id, by comparing all pairs"""
    sets = {d: shingles(t, size) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 160))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        rows.append((i, (rng.choice([" ", "\n", "  "])).join(w)))
    return rows


@pytest.mark.parametrize(("size", "percent", "shingles_", "members"), [(5, 80, 2_000_000, 512), (3, 60, 900, 4)])
def test_components_equal_all_pairs(spark, size, percent, shingles_, members):
    # The small bounds on a group make blocks.
    rows = corpus(percent)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Two Words"), (904, "two words"), (905, "two"), (906, "Two  WORDS\n"), (907, "É a b c"), (908, "é a b c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    got = near_duplicates(df, size, percent, group_shingles=shingles_, group_members=members).collect()
    want = brute(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows) - 50


def test_a_large_group_is_the_same_in_blocks(spark):
    # Copies of one base, some at the threshold, some linked only through others: a chain across blocks.
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 9):
            w[rng.randrange(120)] = f"x{i}_{j}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(base[:60] + [f"c{k}" for k in range(i, i + 60)])) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    want = brute(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 3, 85, group_members=7).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 2


@pytest.mark.parametrize(("members", "whole"), [(40, 1 << 16), (40, 20), (512, 1 << 16)])
def test_copies_of_a_template_are_the_same_in_blocks(spark, members, whole):
    # Most are candidates of each other, near the threshold on either side of it.
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    want = brute(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 3, 85, group_members=members, whole_group=whole).collect()}
    assert got == want and 20 < len({c for _, c in want.values()}) < 240


def test_overlaps_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    o = _Overlaps(sets)
    for i, x in enumerate(sets):
        assert o.shared(i).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_known_links_are_skipped():
    sets = [np.unique(np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))] * 4
    ids, side = np.array([4, 3, 2, 1]), np.zeros(4, int)
    assert spanning_links(ids, sets, side, 80, np.array([7, 7, 7, 7])) == []
    one = spanning_links(ids, sets, side, 80, np.array([7, 7, 8, 8]))
    assert len(one) == 1 and {x > 2 for x in one[0]} == {True, False}
    assert spanning_links(ids, sets, np.array([0, 0, 0, 1]), 80, None)


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone x y z"), (7, long), (8, long + " end")]
    df = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (7, 7, True), (8, 7, False)], key=str)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 1, None, None, 7], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(30)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_components_of_random_graphs(spark, monkeypatch, broadcast):
    # Minima are broadcast, or shuffled when there are too many of them.
    monkeypatch.setattr(components_module, "BROADCAST_BYTES", broadcast)
    rng = random.Random(6)
    nodes = rng.sample(range(-1000, 1000), 300)
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(170)] + [(nodes[0], x) for x in nodes[:40]]
    label = {x: x for e in edges for x in e}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges + edges[:50], "a long, b long"), "a", "b")
    want = {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert got.count() == len(want) and 10 < len(set(want.values())) < 100
    assert components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long"), "a", "b").count() == 0


def _stage(spark):
    """The number of the last stage so far."""
    group = f"stage-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    spark.sparkContext.parallelize([1], 1).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return max(k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds)


def test_rounds_of_the_components_take_few_stages(spark):
    # Each stage of a cluster has hundreds of tasks with small files, however few edges there are.
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(30)], "a long, b long")
    before = _stage(spark)
    got = components(edges, "a", "b")
    after = _stage(spark)
    tracker = spark.sparkContext.statusTracker()
    ran = [i for k in range(before + 1, after) if (i := tracker.getStageInfo(k)) and i.numCompletedTasks]
    assert {r["component"] for r in got.collect()} == {0, 1000}
    assert 20 < len(ran) < 75
