import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievemark.llm import centroids, differencing, phrases

# Centroid clustering


def lloyd(rows, k, rounds, dims, seed=2):
    """Brute force over Python integers: {row number: (cluster, distance)}, and the final centroids."""
    kept = {}
    for at, (vid, v) in enumerate(rows):
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept[at] = (vid, [math.floor(256.0 * float(x)) for x in v])
    key = lambda at: (hashlib.sha256(f"{seed}:{'null' if kept[at][0] is None else kept[at][0]}".encode()).hexdigest(), kept[at][1])
    c = [kept[at][1] for at in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, z)), i) for i, z in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, x in kept.values():
            mine[near(x)[1]].append(x)
        c = [[sum(col) // len(mine[i]) for col in zip(*mine[i])] if mine[i] else z for i, z in enumerate(c)]
    return {at: near(x)[::-1] for at, (_, x) in kept.items()}, c


def vectors(seed, n, dims, spread=0.02):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in mids[i % 6] + spread * rng.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(1, 300, 4),
    vectors(2, 90, 4) + [(5, [0.5] * 4)] * 40 + [(None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0])],
    [(i, [float(i % 3), -0.001 * (i % 2), 0.0, 0.0]) for i in range(60)],
    [(1, [1e6, 3.5e7, -2e5, 0.0]), (2, [1e6, 3.4e7, 2e5, 1.0]), (3, [0.0, 0.0, 0.0, 0.0]), (4, [-1e6, 0.25, 0.0, 0.0])],
])
def test_clusters_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    got = centroids.cluster(df, k=7, rounds=3, dims=4).collect()
    want, c = lloyd(rows, 7, 3, 4)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == sorted((rows[at][0] is None, rows[at][0] or 0, z, d) for at, (z, d) in want.items())
    per = Counter()
    for z, d in want.values():
        per[z] += d
    for r in got:
        assert r.inertia == sum(per.values()) and r.cluster_inertia == per[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clusters_of_an_empty_table(spark):
    out = centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


@pytest.mark.parametrize("kind", [np.float64, object])
def test_whole_nodes_are_assigned_and_agree(kind):
    rng = np.random.default_rng(3)
    mids = rng.integers(-3000, 3000, (12, 8))
    x = mids[rng.integers(0, 12, 3000)] + rng.integers(-9, 10, (3000, 8))
    x[:500] = x[0]
    tree = centroids.Tree(x[centroids.kd_order(x)].astype(kind))
    label, counts, sums, whole = tree.assign(np.concatenate((mids, mids[:2])).astype(kind))
    flat = tree.x.astype(np.int64)
    brute = ((flat[:, None] - np.concatenate((mids, mids[:2]))[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == brute).all() and counts.tolist() == np.bincount(brute, minlength=14).tolist()
    assert all(sums[z].astype(np.int64).tolist() == flat[brute == z].sum(axis=0).tolist() for z in range(14))
    # Two centroids lie in the same place as two others, so a few nodes keep a tie; most are done as a whole.
    assert whole > 1500


def test_boxes_prune_only_what_is_strictly_dominated():
    low, high = np.array([[0.0, 0.0]]), np.array([[2.0, 2.0]])
    c = np.array([[1.0, 1.0], [5.0, 1.0], [3.0, 1.0], [1.0, 1.0]])
    # The third is as far as the first from the edge of the box: it ties there, and stays.
    gone = centroids.dominated(low, high, c, (c * c).sum(axis=1), np.ones((1, 4), bool))
    assert gone.tolist() == [[False, True, False, False]]


# Packing by differencing


def test_tokens_are_those_of_the_whole_tokenizer():
    tok = differencing.default_tokenizer()
    whole = differencing._tokenizer(tok.path)
    rng = random.Random(5)
    odd = ["", " \n", "don't STOP'S the<|endoftext|>x a\x1cb\x85c\xa0d  e", "ΑΣ Σας İstanbul ǅ ﬁ ́x 한글 각 é É", "x" * 5000, "١٢٣ ½ 12a'LL ª º µ × ÷ ß ẞ", "".join(map(chr, range(0x21, 0x250)))]
    odd += ["aB" + chr(c) + "Cd'" + chr(c) for c in range(0x21, 0x250)]
    odd += ["".join(rng.choice("abcÉß'1-,. <|>\ńſ") for _ in range(200)) for _ in range(50)]
    for text in odd * 2:
        assert np.frombuffer(tok(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_difference_is_near_the_best_split():
    rng = random.Random(1)
    for _ in range(30):
        sizes, k = [rng.randint(1, 50) for _ in range(8)], rng.randint(2, 3)
        groups = differencing.difference(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(8)) and len(groups) <= k
        best = min(max(sum(s for s, b in zip(sizes, bins) if b == w) for w in range(k)) for bins in itertools.product(range(k), repeat=8))
        assert max(sum(sizes[i] for i in g) for g in groups) <= 4 / 3 * best
    # Two parts: the largest are set against each other, 8 and 7, 6 and 5, then 4 against what is left.
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in differencing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


@pytest.mark.parametrize("sizes", [[], [1], [512], [2048], [2048, 512, 512, 1], [512] * 9, [300, 300, 300], [2047, 2], [1] * 3000, [512, 511] * 700])
def test_windows_hold_every_piece_once(sizes):
    groups = differencing.windows(sizes, 2048)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in g) <= 2048 for g in groups)


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def test_documents_fill_windows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma's", "é"]) for _ in range(int(rng.lognormvariate(5, 1)))) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (500, "", "x"), (None, "two words", "x"), (501, "long " * 30000, "x")]
    out = differencing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)).collect()
    whole = differencing._tokenizer(differencing.default_tokenizer().path)
    ids = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows if i is not None and i != 500}
    windows, docs = defaultdict(list), defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    assert [(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in docs[500]] == [(0, 1, 1, zlib.crc32(b"\x01\0\0\0"))] * 2
    for doc, own in ids.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    lengths = []
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        lengths.append(at)
    assert padding(lengths, 2048) < 0.02 * sum(lengths)
    empty = differencing.pack_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# Phrase collocations


def brute(rows, least, depth, percent, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, depth + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def prose(seed, n):
    rng = random.Random(seed)
    names = ["New York City", "à la carte", "machine learning", "x y x y x", "of the"]
    words = ["the", "of", "Word", "eÉ", "rare%d", "a\x00b", "\xa0", "sea"]
    out = []
    for i in range(n):
        parts = [rng.choice(names) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice([" ", "\t ", " "]).join(p % i if "%" in p else p for p in parts).replace("sea", rng.choice(["sea", "sea.", "sea\n"])), rng.choice(["en", "en", "de", None, "und", ""])))
    return out + [(None, "en"), ("", None)] + out[:20]


@pytest.mark.parametrize("shard_words", [40, 1_000_000])
@pytest.mark.parametrize("percent", [100, 60])
def test_phrases_equal_brute_force(spark, shard_words, percent):
    rows = prose(4, 160)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, n int, phrase int").repartition(3)
    got = phrases.collocations(df, least=12, percent=percent, top=30, shard_words=shard_words).collect()
    want = brute(rows, 12, 5, percent, 30)
    assert sorted(map(tuple, got)) == want and len(want) > 60


def test_phrases_of_nothing_frequent(spark):
    none = phrases.collocations(spark.createDataFrame([(None, None), ("a b c", "en")], "text string, lang string"))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_slices_end_with_a_piece(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 7)
    text = "aa bb cc dd ee, f g\nhhhhhhhhhhhhhhhhhhhhhhhhhhhh. i j k l m n o p q;;"
    parts = list(phrases.slices(np.frombuffer(text.encode(), np.uint8)))
    assert b"".join(p.tobytes() for p in parts).decode() == text and len(parts) > 3
    words, begins = zip(*(phrases.piece_words(p) for p in parts))
    assert [w for p in words for w in p.to_pylist()] == re.findall(r"[^\s.,;]+", text)
    assert sum(int(b.sum()) for b in begins) == 4


def test_automaton_states_are_sets_of_end_positions():
    rng = random.Random(2)
    numbers = np.array([0] + [rng.choice([0, 1, 1, 2, 3]) for _ in range(400)], np.int32)
    a = phrases.SuffixAutomaton(numbers, np.arange(3, dtype=np.uint64), 4)
    ends = defaultdict(set)
    for m in range(1, 5):
        for i in range(len(numbers) - m + 1):
            gram = tuple(int(x) for x in numbers[i : i + m])
            if all(gram):
                ends[gram].add(i + m)
    grams = [[(w + 1,) for w in range(3)]]
    for m in range(2, 5):
        grams.append([grams[-1][h] + (int(w) + 1,) for h, w in zip(a.head[m - 1], a.last[m - 1])])
    state = {g: int(s) for level, states in zip(grams, a.state) for g, s in zip(level, states)}
    assert set(state) == set(ends)
    for x, y in itertools.combinations(state, 2):
        assert (state[x] == state[y]) == (ends[x] == ends[y])
    for g, s in state.items():
        own = [len(x) for x in state if state[x] == s]
        assert a.count[s] == len(ends[g]) and (a.longest[s], a.shortest[s]) == (max(own), min(own))
        if len(g) == max(own) and len(g) > 1:
            outside = [g[i:] for i in range(1, len(g)) if state[g[i:]] != s]
            assert a.link[s] == (state[outside[0]] if outside else -1)


def test_filters_lose_nothing(spark, monkeypatch):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    bits = phrases.bloom(df)
    assert len(bits) == 1 << phrases.FILTER_BITS - 3 and phrases.may_hold(bits, hashes.astype(np.uint64)).all()
    assert phrases.may_hold(bits, np.arange(100_000, dtype=np.uint64)).mean() < 0.01
    # A full filter lets everything through, and the result is the same.
    monkeypatch.setattr(phrases, "may_hold", lambda bits, hashes: np.ones(len(hashes), bool))
    numbers = np.array([0, 1, 2, 3, 0, 3, 1], np.int32)
    assert phrases.without_rare(numbers, np.array([0, 2]), 3).tolist() == [2, 1, 0]


def some_shards(n=6, words=300):
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(words)] for _ in range(n)]
    rows = []
    for i, text in enumerate(texts):
        own = sorted(set(text))
        numbers = np.array([0, *(own.index(w) + 1 for w in text)], np.int32)
        rows.append(phrases._shard_row(i, "en", pa.array(own), np.zeros(len(own), np.int64), numbers).select(["shard", "lang", "words", "numbers"]))
    everything = SimpleNamespace(value=np.full(1 << phrases.FILTER_BITS - 3, 255, np.uint8))
    return texts, rows, {1: everything}


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_buckets_add_up_over_tasks(monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_COUNTS", held)
    texts, rows, filters = some_shards()
    tasks = [b for part in (rows[:2], rows[2:]) for b in phrases._bucket_counts(part, filters, 2, 4)]
    handed = sorted((r for b in tasks for r in b.to_pylist()), key=lambda r: r["part"])
    assert len(tasks) == (2 if held > 1000 else 6)
    got = [x for b in phrases._full([pa.RecordBatch.from_pylist(handed, schema=tasks[0].schema)], 4) for x in b.column(0).to_pylist()]
    names = sorted({w for t in texts for w in t})
    of = dict(zip(names, phrases._hashes(pa.array(names), "en")))
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    sums = Counter()
    for (a, b), n in pairs.items():
        sums[int(phrases.buckets(phrases.pair_hashes(np.array([of[a]]), np.array([of[b]])))[0])] += n
    assert sorted(got) == sorted(x for x, n in sums.items() if n >= 4) and len(got) > 20
    # Two bytes or so for a count, where a row of hashes took 24.
    assert phrases.decoded(3, phrases.encoded(np.array([0, 7, 900_000]), np.array([1, 300, 1 << 40])))[1].tolist() == [1, 300, 1 << 40]
    assert len(phrases.encoded(np.arange(0, 1 << 20, 170), np.ones(6169, np.int64))) < 2 * 6169


@pytest.mark.parametrize("held", [200, 1 << 20])
def test_a_task_adds_up_its_shards(monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_COUNTS", held)
    texts, rows, filters = some_shards()
    batches = list(phrases._phrases(rows, filters, 3))
    handed = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
    if held > 10_000:
        # One row for each part, not one for each phrase of each shard.
        assert len(handed) <= 1 << phrases.PHRASE_PART_BITS and len({p for r in handed for p in r["phrases"]}) == sum(len(r["phrases"]) for r in handed) > 3 * len(handed)
    want = Counter(" ".join(t[i : i + m]) for t in texts for m in (2, 3) for i in range(len(t) - m + 1))
    got = pa.Table.from_batches(phrases._summed([pa.RecordBatch.from_pylist(handed, schema=batches[0].schema)], 2)).to_pylist()
    assert {(r["phrase"], r["m"]): r["a"] for r in got} == {(p, len(p.split())): n for p, n in want.items() if n >= 2} and len(got) > 100


def test_a_reader_of_shards_holds_few(spark, monkeypatch):
    left = []
    monkeypatch.setattr(phrases, "remove", lambda spark, path: left.append(path))
    df = spark.range(6, numPartitions=1).selectExpr("repeat('one two three four five six. ', 40000) AS text", "'en' AS lang")
    phrases.frequent_phrases(df, shard_words=12)
    files = [pq.ParquetFile(f).metadata for f in Path(left[-1].removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 8 and max(groups) <= 4
