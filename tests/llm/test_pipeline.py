import random

import corpus_pipeline
from sievemark.llm import registry
from tests.llm.test_near_dedup import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"]}
    rows = []
    for i in range(160):
        lang = rng.choice(list(parts))
        rows.append([i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(20, 90))), lang, rng.choice(["s1", "s2", "s3", None])])
    for i in range(160, 200):  # exact and near copies
        words = rows[i - 160][1].split()
        if i % 2:
            words[-1] = "kalo"
        rows.append([i, "  ".join(words), rows[i - 160][2], "s1"])
    rows += [[200, None, "aa", "s1"], [201, "", None, "s2"], [202, "123 456 %%%", "aa", "s1"]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = registry.table(spark, str(tmp_path), "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [tuple(r) for r in docs.collect()]

    ids = lambda name: sorted(r[0] for r in kept[name])
    text = {r[0]: r[1] for r in rows}
    assert not {200, 201, 202} & set(ids("language_id")) and len(ids("language_id")) >= 195
    first = {}
    for i in ids("language_id"):
        first.setdefault(" ".join(text[i].split()), i)
    assert ids("exact_dedup") == sorted(first.values())

    label = {i: i for i in ids("exact_dedup")}
    sets = {i: shingles(text[i], 5) for i in label}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    assert ids("minhash_near_dedup") == sorted(i for i in label if label[i] == i)

    mixed = ids("mix_sources")
    assert set(mixed) <= set(ids("minhash_near_dedup")) and max(mixed.count(i) for i in set(mixed)) <= 3
    pieces = kept["best_fit_packing"]
    assert sorted(p[0] for p in pieces if p[1] == 0) == mixed
    bins = {}
    for p in pieces:
        bins.setdefault(p[5], []).append((p[6], p[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame(documents()[:60], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 20
