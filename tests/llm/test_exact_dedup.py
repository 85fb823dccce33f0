import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm.exact_dedup import PatriciaTrie, drop_exact_duplicates, exact_duplicates

DOCS = "doc_id long, text string, lang string, keep_id string, sha_ int"


def brute(rows):
    groups = {}
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(key, []).append(doc)
    out = []
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        ids = [x for x in groups[key] if x is not None]
        keep = min(ids) if ids else None
        out.append((doc, keep, len(groups[key]), doc == keep, hashlib.sha256(key.encode()).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.one_of(st.none(), st.integers(0, 9))), max_size=60), st.sampled_from([900, 4000, 1 << 20]))
def test_trie_merges_like_a_dict(entries, budget):
    trie, want = PatriciaTrie(budget), {}
    for key, doc in entries:
        trie.insert(key, (doc, 1, 1))
        want.setdefault(key, []).append(doc)
    got = dict(trie.items())
    assert set(got) == set(want)
    for key, docs in want.items():
        ids = [d for d in docs if d is not None]
        low = min(ids) if ids else None
        assert got[key] == (low, docs.count(low), len(docs))


def test_trie_spills_subtrees_of_long_keys():
    rng, trie, want = random.Random(3), PatriciaTrie(20_000), {}
    for i in range(600):
        key = bytes(rng.choices(b"abc", k=rng.randrange(1, 200)))
        trie.insert(key, (i, 1, 1))
        want[key] = min(i, want.get(key, i))
    assert trie.spilled
    assert {k: v[0] for k, v in trie.items()} == want


def rows():
    texts = ["a b", "a  b", "a\tb", "a\n\r b", None, "", " ", "\t", "x" * 50_000, "x" * 50_000 + " ", "é ü", "a b", "A b", "unique"]
    out = [(i, t, "en", "k", i) for i, t in enumerate(texts)]
    return [*out, (0, "a b", "fr", "z", 1), (None, "a b", None, None, None), (None, "only null", None, None, None), (None, "only null", None, None, None)]


def test_verdicts_equal_brute_force(spark):
    data = rows()
    got = exact_duplicates(spark.createDataFrame(data, DOCS).repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute([r[:2] for r in data]), key=key)


def test_filter_leaves_one_row_of_each_text_with_all_columns(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    kept = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
    assert len(kept) == len(set(kept)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_duplicates(df).count() == 0 and drop_exact_duplicates(df).count() == 0
