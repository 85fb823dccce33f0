import duckdb
import pandas as pd
import pytest

from sievemark.llm.mixing import mix, mixed
from sievemark.llm.registry import oracle_sql

DOCS = "doc_id long, text string, source string, size string, target long"


def data(sizes):
    rows, k = [], 0
    for source, words in sizes.items():
        for n in words:
            rows.append((k, " ".join(["w"] * n) if n else None, source, "s", k))
            k += 1
    return rows


CASES = {
    "plain": {"a": [10] * 50, "b": [7] * 40, "c": [3] * 30, "d": [20] * 10},
    "caps": {"a": [1] * 3, "b": [500] * 20, "c": [2], "d": [100] * 30},
    "one": {"only": [5, 6, 7]},
    "nulls": {"a": [4] * 30, None: [9] * 20, "": [0, 1, 2], "z": [0, 0]},
    "nothing": {"a": [0, 0], "b": [0]},
}


@pytest.mark.parametrize("name", CASES)
def test_equals_sql(spark, name):
    rows = data(CASES[name])
    got = {r["doc_id"]: tuple(r)[1:] for r in mix(spark.createDataFrame(rows, DOCS)).collect()}
    con = duckdb.connect()
    con.register("documents_", pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "source"]))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM documents_")
    want = {r[0]: r[1:] for r in con.execute("SELECT doc_id, size, source_size, target, taken FROM (" + oracle_sql()["op7_mix_sources"] + ")").fetchall()}
    assert got == want


def test_taken_words_come_near_the_targets(spark):
    rows = data(CASES["plain"])
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    by = {}
    for (_, _, source, *_), r in zip(rows, sorted(got, key=lambda r: r["doc_id"])):
        by.setdefault(source, [r["target"], 0, r["source_size"]])[1] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    for target, taken, size in by.values():
        assert target <= 3 * size and abs(target - taken) <= 10
    assert sum(t for t, _, _ in by.values()) == pytest.approx(sum(s for _, _, s in by.values()))


def test_rows_come_as_often_as_they_are_taken(spark):
    df = spark.createDataFrame(data(CASES["nulls"]), DOCS)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix(df).collect() if r["size"]}
    out = mixed(df)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert all(count.get(k, 0) == n for k, n in taken.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b", "s", None, None)] * 3 + [(None, "a b c", "s", None, None)] * 2
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and len({(r["doc_id"], r["taken"]) for r in got}) == 2
    assert mix(spark.createDataFrame([], DOCS)).count() == 0 and mixed(spark.createDataFrame([], DOCS)).count() == 0
