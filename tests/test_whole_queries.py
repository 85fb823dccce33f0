"""Registered queries over all rows of a table, against brute force."""

import random
import re
from collections import Counter

import pytest

from sievemark.operators import access as AC
from sievemark.operators import semantic as M
from sievemark.plans import catalog


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(5)
    common = [f"a line that many texts have, number {i}" for i in range(4)]
    rows = []
    for i in range(45):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"the thing {rng.randrange(30)} of text {rng.randrange(12)}" for _ in range(rng.randrange(1, 9))]
        text = rows[-3][1] if i % 9 == 8 else "\n".join(lines) + "\n" * (i % 2)
        rows.append((i, text, [None, "en", "de", "fr"][i % 4], f"src{i % 3}"))
    rows[7] = (7, "", "fr", "src1")
    root = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    return root, {"/".join(x for x in (s, g, f"{i}.txt") if x): (i, t) for i, t, g, s in rows}


def scores(docs):
    new = {f"moved/{p}": t + "\nadded line" if i % 40 == 0 else t for p, (i, t) in docs.items()}
    out = []
    for p, (_, a) in docs.items():
        for q, b in new.items():
            x, y = Counter(a.splitlines(True)), Counter(b.splitlines(True))
            big, small = max(len(a), len(b)), min(len(a), len(b))
            shared = sum(len(k) * n for k, n in (x & y).items())
            if (shared or a == b) and 2 * small >= big and (score := 100 if a == b else min(99, 100 * shared // big)) >= 50:
                out.append((p, q, score))
    return out


def test_similarity_and_renames_of_all_documents(spark, docs):
    want = scores(docs[1])
    assert sum(int(p.split("/")[-1][:-4]) % 20 != 0 for p, _, _ in want) > 40
    # Rows are classes of equal texts; with their members they are all pairs.
    old = {p: t for p, (_, t) in docs[1].items()}
    new = {f"moved/{p}": t + "\nadded line" if i % 40 == 0 else t for p, (i, t) in docs[1].items()}
    alike = lambda side, p: [q for q, t in side.items() if t == side[p]]
    rows = catalog.queries()["similarity"](spark, docs[0]).collect()
    assert all((r["old_path"], r["new_path"]) == (min(alike(old, r["old_path"])), min(alike(new, r["new_path"]))) for r in rows)
    assert all((r["old_members"], r["new_members"]) == (len(alike(old, r["old_path"])), len(alike(new, r["new_path"]))) for r in rows)
    assert sorted((p, q, r["score"]) for r in rows for p in alike(old, r["old_path"]) for q in alike(new, r["new_path"])) == sorted(want)
    assert max(r["old_members"] for r in rows) > 2 and 100 in {r["score"] for r in rows if old[r["old_path"]] == ""}
    only = lambda k, r: [x for x in want if x[k] == r[k] and x[2] >= r[2]] == [r]
    got = catalog.queries()["rename_pairs"](spark, docs[0]).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in want if only(0, r) and only(1, r))


def test_judged_order_of_all_events(spark, tmp_path):
    rng = random.Random(6)
    events = [(i, rng.choice([None, 0.25, 0.5, rng.random()])) for i in range(400)]
    rng.shuffle(events)
    spark.createDataFrame(events, "event_id long, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    cls = {0: None, 1: "relevant", 2: "other"}
    judged = [(i, cls[i % 3], v) for i, v in sorted(events) if i % 3]
    order = sorted(judged, key=lambda r: (r[1] != "relevant", r[2] is None, -(r[2] or 0), r[0]))
    want = [(*r, place[0]) for r, place in zip(order, judged)] + [(i, None, v, i) for i, v in events if i % 3 == 0]
    got = catalog.queries()["judged_order"](spark, str(tmp_path))
    assert got.columns == ["pos", "class", "probability", "new_pos"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def ranked(texts, query):
    """brute force over all passages: ``-ranking score, path, line, start, end, score``"""
    encoder = M.HashingEncoder()
    q = encoder.encode([query], "query")[0].astype(float).tolist()
    out = []
    for p, t in texts.items():
        for a, b in M.passage_bounds(t):
            score = sum(x * y for x, y in zip(encoder.encode([t[a:b]], "passage")[0].astype(float).tolist(), q))
            out.append((-(score - 0.02 * (1 - min((b - a) / 500, 1) ** 0.5)), p, t.count("\n", 0, a) + 1, a, b, score))
    return sorted(out)


def test_concepts_of_all_languages(spark, docs):
    want = ranked({p: t for p, (_, t) in docs[1].items()}, "the thing")[:50]
    assert len({p.split("/")[1] for _, p, *_ in want}) > 3
    got = catalog.queries()["concept"](spark, docs[0]).collect()
    assert [(r["path"], r["start"], r["end"], r["line"]) for r in got] == [(p, a, b, n) for _, p, n, a, b, _ in want]
    assert [r["ranking_score"] for r in got] == pytest.approx([-w[0] for w in want])


def test_hybrid_takes_the_best_of_all_free_passages(spark, tmp_path):
    rng = random.Random(7)
    words = "some other words that are not near to it at all".split()
    near = [(i, "thing " * rng.randrange(1, 4), "de", "near") for i in range(600)]
    # The match is behind the first passage, in a line that starts there.
    late = [(1000 + i, "thin ing hin " * (60 + i) + "\n" + " ".join(rng.choices(words, k=150)) + "\na thing\n", [None, "fr", "en"][i % 3], "late") for i in range(6)]
    far = [(2000 + i, " ".join(rng.choices(words, k=40)), None, "far") for i in range(5)]
    spark.createDataFrame([*near, *late, *far], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {"/".join(x for x in (s, g, f"{i}.txt") if x): t for i, t, g, s in [*near, *late, *far]}
    exact = [(p, m.start(), m.end()) for p, t in texts.items() for m in re.finditer("thing", t)]
    held, best = {}, []
    for p, a, b in exact:
        held.setdefault(p, []).append((a, b))
    for r, p, _, a, b, _ in ranked(texts, "thing"):
        if not any(x < b and a < y for x, y in held.get(p, [])):
            held.setdefault(p, []).append((a, b))
            best.append((p, a, b, -r))
    got = catalog.queries()["hybrid"](spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["start"], r["end"]) for r in got if r["tier"] == 0) == sorted(exact)
    concepts = sorted(((r["path"], r["start"], r["end"], r["score"]) for r in got if r["tier"] == 1), key=lambda r: -r[3])
    assert [c[:3] for c in concepts] == [b[:3] for b in best[:3]] and concepts[0][0].startswith("late")
    assert [c[3] for c in concepts] == pytest.approx([b[3] for b in best[:3]])


def test_scopes_reach_the_end_of_long_lines(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 100_001 + "tion the ing", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.queries()["all_of_within"](spark, str(tmp_path)).collect()] == [("s/en/1.txt", "tail")]
    assert sorted(tuple(r) for r in catalog.queries()["smallest_enclosing"](spark, str(tmp_path)).collect()) == [("s/en/1.txt", 100_001 + n, "file") for n in (0, 5, 9)]


def test_sources_behind_the_first_step_are_tried(spark, monkeypatch):
    monkeypatch.setattr(AC, "LISTED", 10)
    rng = random.Random(8)
    rows = [(f"p{i:03}", rng.randrange(1, 60)) for i in range(45)]
    for most, files in ((200, 30), (2000, 12), (2000, 99)):
        used, want = 0, set()
        for p, n in rows:
            if n <= 50 and used + n <= most and len(want) < files:
                used, want = used + n, want | {p}
        got = AC.admit(spark.createDataFrame(rows, "path string, size long"), "skip", most, files, 50).collect()
        assert {r["path"] for r in got if r["status"] == "admitted"} == want and len(got) == 45
