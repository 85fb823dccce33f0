import random
import re
import subprocess
import time

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.errors import CapabilityError, EvidenceError, RegexError
from sievemark.functions import paths as P
from sievemark.functions import text as T
from sievemark.functions.pattern import Pattern, escape, smart_case_is_sensitive
from sievemark.functions.redaction import mask, redact, redaction_count, sensitive
from sievemark.operators import access as AC
from sievemark.operators import audit as A
from sievemark.operators import budget as B
from sievemark.operators import changes as C
from sievemark.operators import ignore as IG
from sievemark.operators import ranges as G
from sievemark.operators import search as S
from sievemark.operators import semantic as M
from sievemark.operators import structure as X
from sievemark.plans import catalog
from sievemark.session import small_batches

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["literal_summary", "any_of", "context_windows", "audit", "overlap_anti", "intersect_ranges", "roles", "structure", "cosine_topk", "prefix_budget", "redact_counts", "imports"])
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize(("text", "want"), [("a\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("\n", [""]), ("", []), ("a\r\nb\rc", ["a\r", "b\rc"]), ("\n\n", ["", ""])])
def test_lines_end_at_line_feeds_only(spark, text, want):
    assert [r["line"] for r in T.lines(table(spark, [("p", text)])).orderBy("line_no").collect()] == want


def test_patterns():
    for bad in (r"(a)\1", "(?=a)b", "(?<!a)b", "(", "", "a\0"):
        with pytest.raises(RegexError):
            Pattern(bad)
    assert Pattern(r"\\1").text == r"\\1"
    assert not smart_case_is_sensitive("foo", False) and smart_case_is_sensitive("foO", False)
    assert not smart_case_is_sensitive(r"fo\S\p{Lu}", False) and smart_case_is_sensitive(r"fo\S", True)
    assert re.fullmatch(escape("a.b*[x]^$-"), "a.b*[x]^$-")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab é😀.", max_size=12), min_size=1, max_size=5), st.sampled_from(["a", "aa", "aba", "é", "."]))
def test_literal_occurrences(spark, lines, term):
    df = table(spark, [(str(i), x) for i, x in enumerate(lines)], "path string, line string")
    got = {r["path"]: (r["n"], [tuple(o) for o in r["o"]]) for r in df.select("path", T.occurrence_count(F.col("line"), Pattern(term, literal=True)).alias("n"), T.occurrences(F.col("line"), Pattern(term, literal=True)).alias("o")).collect()}
    for i, x in enumerate(lines):
        want = [(m.start(), m.end()) for m in re.finditer(re.escape(term), x)]
        assert got[str(i)] == (len(want), want)


def test_regex_occurrences_and_empty_matches(spark):
    df = table(spark, [("p", "x ab aab"), ("q", "")], "path string, line string")
    got = lambda p: {r["path"]: [tuple(o) for o in r["o"]] for r in df.select("path", T.occurrences(F.col("line"), Pattern(p)).alias("o")).collect()}
    assert got("a+b")["p"] == [(2, 4), (5, 8)]
    assert got("^")["q"] == [(0, 0)] and got("z*")["q"] == [(0, 0)]


def test_offsets_of_wide_characters(spark):
    r = table(spark, [("p", "a\r😀é|")]).select(T.byte_offset(F.col("text"), F.lit(4)).alias("b"), T.utf16_offset(F.col("text"), F.lit(4)).alias("u"), T.line_start_bytes(F.lit("é\nb"), F.lit(2)).alias("s")).first()
    assert (r["b"], r["u"], r["s"]) == (8, 4, 3)


def test_excerpts(spark):
    line = "x" * 600
    df = table(spark, [("p", line)])
    cut = lambda a, b: df.select(T.excerpt(F.col("text"), F.lit(a), F.lit(b)).alias("e")).first()["e"]
    assert cut(0, 1) == "x" * 500 + "…" and cut(599, 600) == "…" + "x" * 500 and cut(300, 301) == "…" + "x" * 500 + "…"


@pytest.mark.parametrize(("text", "masked", "n"), [
    ('api_key = "abc"', 'api_key = "[REDACTED]"', 1), ("token: string", "token: string", 0), ("my-secret=zz; x", 'my-secret="[REDACTED]"; x', 1), ("sk-abcdefgh1", "[REDACTED]", 1),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\n[REDACTED]\n-----END RSA PRIVATE KEY-----", 1), ("tokens are words", "tokens are words", 0),
])
def test_redaction(spark, text, masked, n):
    df = table(spark, [("p", text)])
    r = df.select(redact(F.col("text")).alias("m"), redaction_count(F.col("text")).alias("n"), redact(redact(F.col("text"))).alias("again")).first()
    assert (r["m"], r["n"]) == (masked, n) and (r["again"] == r["m"] or n)


def test_file_scores(spark):
    paths = ["src/app/page.ts", "page.ts", "page", "src/pages/x.ts", "lib/pxaxgxe.go", ".page"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["s"] for r in df.select("path", P.file_score(F.col("path"), "page").alias("s")).collect()}
    assert got == {"src/app/page.ts": 95, "page.ts": 95, "page": 100, "src/pages/x.ts": 70, "lib/pxaxgxe.go": round(40 * 4 / 7), ".page": 85}
    with pytest.raises(EvidenceError):
        P.file_score(F.col("path"), "*.ts")


@pytest.mark.parametrize(("path", "glob", "exclude", "hidden", "want"), [
    ("a/b.ts", ["*.ts"], None, True, True), ("a/b.ts", ["a/*.js"], None, True, False), ("a/c/b.ts", ["a/**/*.ts"], ["!c"], True, False), ("a/.x/b", None, None, False, False),
    ("a/.git/config", None, None, True, False), ("x.ts", ["*.ts", "!x.ts"], None, True, False), ("a/b.{c}", ["*.{c,d}"], None, True, False), ("a/b.d", ["*.{c,d}"], None, True, True), ("ab1", ["ab[0-9]"], None, True, True),
])
def test_scopes(spark, path, glob, exclude, hidden, want):
    assert spark.createDataFrame([(path,)], "path string").where(P.in_scope(F.col("path"), glob, exclude, hidden)).count() == want


def test_unknown_times_stay_or_go(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "id int, mtime_ms double")
    assert {r["id"] for r in S.modified_between(df, "mtime_ms", 5, 9, True).collect()} == {1, 2}
    assert {r["id"] for r in S.modified_between(df, "mtime_ms", 5, 9).collect()} == {1}


def points(ranges):
    return {(k, x) for k, a, b in ranges for x in range(a, b)}


RANGES = st.lists(st.tuples(st.sampled_from("pq"), st.integers(0, 20), st.integers(1, 6)).map(lambda t: (t[0], t[1], t[1] + t[2])), max_size=8)


@settings(max_examples=12, deadline=None)
@given(RANGES, RANGES)
def test_range_algebra(spark, a, b):
    schema = "path string, start long, end long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    take = lambda df: [tuple(r) for r in df.select("path", "start", "end").collect()]
    assert points(take(G.merge(x))) == points(a)
    assert points(take(G.subtract(x, y))) == points(a) - points(b)
    assert points(take(G.intersect(x, y))) == points(a) & points(b)
    want = [r for r in a if not any(k == r[0] and s < r[2] and r[1] < e for k, s, e in b)]
    assert sorted(take(G.overlap_anti(x, y))) == sorted(want)
    ranked = [(*r, i) for i, r in enumerate(a)]
    kept = []
    for r in ranked:
        if not any(k[0] == r[0] and k[1] < r[2] and r[1] < k[2] for k in kept):
            kept.append(r)
    got = [tuple(r) for r in G.greedy_dedupe(spark.createDataFrame(ranked, schema + ", rank int")).collect()]
    assert sorted(got) == sorted(kept)


def test_two_kinds_of_budget(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 9, 2, 4, 1])], "k string, i int, s int")
    assert {r["i"] for r in B.prefix(df, "s", 12, ["i"]).collect()} == {0}
    assert {r["i"] for r in B.retained(df, "s", ["i"], "k", 12, 99).collect()} == {0, 2, 3, 4}
    pages = [r["i"] for n in range(3) for r in B.page(df, n, 2, ["i"]).orderBy("ord").collect()]
    assert pages == [0, 1, 2, 3, 4]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_shortest_edit(a, b):
    gone, come = C.shortest_edit(a, b)
    lines = lambda r: {i for s, e in r for i in range(s, e + 1)}
    rest_a = [x for i, x in enumerate(a, 1) if i not in lines(gone)]
    assert rest_a == [x for i, x in enumerate(b, 1) if i not in lines(come)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(rest_a) == best[-1][-1]


def test_ambiguous_renames_stay_apart(spark):
    gone = table(spark, [("a", "x\ny\n"), ("b", "x\ny\n"), ("c", "p\nq\nr\n")])
    come = table(spark, [("d", "x\ny\n"), ("e", "p\nq\ns\n")])
    scores = C.similarity(gone, come)
    assert [tuple(r) for r in C.rename_pairs(scores).collect()] == [("c", "e", 66)]
    assert sorted(tuple(r) for r in C.judged_renames(scores).collect()) == [("a", "d", 100, "copies"), ("c", "e", 66, None)]
    two = C.judged_renames(C.similarity(table(spark, [("a", "x\ny\nz\nw\n")]), table(spark, [("b", "x\ny\nz\nv\n"), ("c", "x\ny\nz\nu\n"), ("d", "x\ny\n"), ("e", "")])))
    assert sorted(tuple(r) for r in two.collect()) == [("a", "b", 75, "several-targets"), ("a", "c", 75, "several-targets"), ("a", "d", 50, "better-elsewhere")]
    copies = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.lit("same\n").alias("text"))
    assert [tuple(r) for r in C.similarity(copies, copies).collect()] == [("0", "0", 100, 3000, 3000)]


@settings(max_examples=80, deadline=None)
@given(st.text("ab\n", max_size=300), st.integers(10, 40), st.integers(0, 9))
def test_passages_cover_the_text(text, size, overlap):
    # Ends advance if the overlap is below half a passage, as by default; beyond it only the starts must.
    spans = M.passage_bounds(text, size, overlap)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b <= d and b - a <= size + 1 and (b < d or overlap >= size // 2)


def test_a_line_feed_at_the_end_makes_a_longer_passage():
    assert M.passage_bounds("x" * 1000 + "\n" + "y" * 500)[0] == (0, 1001)


def test_semantic_search_needs_an_encoder(spark):
    with pytest.raises(CapabilityError):
        M.concept(table(spark, [("p", "text")]), "query", None)
    got = M.concept(table(spark, [("p", "the red fox"), ("q", "something else")]), "red fox", M.HashingEncoder(), 5).collect()
    assert got[0]["path"] == "p"


def test_validation_and_closure(spark):
    v = lambda rows: spark.createDataFrame(rows, "path string, version string")
    got = {r["path"]: r["status"] for r in A.validate(v([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)]), v([("a", "1"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {"a": "current", "b": "stale", "c": "stale", "d": "unknown"}
    one = v([("a", "1")])
    assert A.closure(one, one) and not A.closure(one, one, skipped=1) and not A.closure(one, v([])) and not A.closure(one, one, one)


OUTLINE = '''import os
class A:  # class B:
    """def no(): class"""
    def f(self,
          x="def g():"):
        def inner(): pass
        return x

    async def g(self):
        pass
def top(): return 1
class Empty:
'''


def test_python_outline():
    got = [(n, k, a, b, s, body) for n, k, a, b, s, body, _ in X.python_outline(OUTLINE)]
    assert got == [("A", "class", 2, 10, [], True), ("f", "method", 4, 8, ["A"], True), ("inner", "function", 6, 6, ["A", "f"], True), ("g", "method", 9, 10, ["A"], True), ("top", "function", 11, 11, [], True), ("Empty", "class", 12, 13, [], False)]


def test_outline_of_broken_sources():
    got = X.python_outline("def a(:\n  pass\n\nclass B:\n  def m(self): return (1,\n2)\n  x = \"\"\"open\n def no(): 0\n")
    assert ("B", "class") in [g[:2] for g in got] and ("m", "method") in [g[:2] for g in got] and "no" not in [g[0] for g in got]
    odd = X.python_outline("class A:\n    def f(x):\n        y = 1\n      bad = 2\ndef after(): pass\n")
    assert [g[:2] for g in odd][:2] == [("A", "class"), ("f", "method")] and odd[-1][:2] == ("after", "function")
    began = time.perf_counter()
    assert len(X.python_outline("def a(\n" * 20_000)) == 20_000 and time.perf_counter() - began < 20
    for text in ("", "\n\n", "\x00", "def", "class :", "?" * 50, "(" * 300, "\t def x():\n", "a" * 100_000):
        assert isinstance(X.python_outline(text), list)


def test_names_of_secrets():
    yes = ["password", "db_password", "MY-SECRET", "apiKey", "api_key_2", "aws-secret-access-key", "x_service-key", "access_token", "privatekey"]
    no = ["passwords", "tokenize", "keys", "key", "_token", "token_", "1_token", "secretary", "api", "apiary_key"]
    assert [n for n in yes if not sensitive(n)] == [] and [n for n in no if sensitive(n)] == []
    for text, want in (
        ("a token = 'x\ny'", 1), ('{"password": null, "token": "abc"}', 1), ("token=", 0), ("token = password = x", 1), ("use sk-12345678, ghp_abcdefgh. and sk-1234567", 2), ("re-sk-abcdefgh-", 1), ("ask-abcdefgh", 0),
        ("password: 'string'; secret: \"stringy\"", 1), ("-----BEGIN PRIVATE KEY-----x", 0), ("-----BEGIN A PRIVATE KEY-----x-----END A PRIVATE KEY----- token: 1", 2),
    ):
        assert mask(text)[1] == want, text


def test_import_traces(spark):
    imports = [("a.ts", "x", "x", "./b", "named"), ("a.ts", "y", "y", "./b", "named"), ("a.ts", "p", "default", "pkg", "default"), ("a.ts", "n", "*", "./c.js", "namespace"), ("a.ts", "m", "m", "./missing", "named"), ("a.ts", "s", "s", "./star", "named"), ("a.ts", "l", "l", "./loop", "named"), ("b.ts", "z", "w", "./d/", "named")]
    exports = [("b.ts", "x", None, None, "named"), ("b.ts", "y", "z", None, "named"), ("d/index.ts", "w", None, None, "named"), ("star.ts", None, None, "./b", "star"), ("loop.ts", "l", "l", "./loop", "named")]
    own = [("b.ts", "x"), ("d/index.ts", "w")]
    files = [(p,) for p in ("a.ts", "b.ts", "c.ts", "d/index.ts", "star.ts", "loop.ts")]
    got = X.trace_imports(
        spark.createDataFrame(imports, "path string, local string, imported string, specifier string, kind string"), spark.createDataFrame(exports, "path string, exported string, local string, specifier string, kind string"),
        spark.createDataFrame(own, "path string, name string"), spark.createDataFrame(files, "path string"),
    )
    rows = {r["local"]: (r["status"], r["reason"], r["target"], r["name"]) for r in got.where("path = 'a.ts'").collect()}
    assert rows == {
        "x": ("resolved", None, "b.ts", "x"), "y": ("resolved", None, "d/index.ts", "w"), "p": ("unresolved", "package-or-alias", None, "default"), "n": ("module", None, "c.ts", "*"),
        "m": ("unresolved", "missing", None, "m"), "s": ("unresolved", "export-star-unsupported", None, "s"), "l": ("unresolved", "circular-re-export", None, "l"),
    }


def test_ordinary_terms(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", "\n".join("".join(rng.choices("ana ", k=20)) for _ in range(4))) for i in range(12)]
    got = S.any_of(table(spark, rows), ["ana", "na"]).collect()
    want = [(p, t, n, m.start(), m.end()) for p, text in rows for n, line in enumerate(text.split("\n"), 1) for t in ("ana", "na") for m in re.finditer(t, line)]
    assert sorted((r["path"], r["term"], r["line_no"], r["start"], r["end"]) for r in got) == sorted(want)
    with pytest.raises(EvidenceError):
        S.any_of(table(spark, rows), ["one"])


def test_previews_do_not_overlap(spark):
    found = spark.createDataFrame([("p", n) for n in (1, 2, 9, 30)] + [("q", 5)], "path string, line_no int")
    assert sorted(tuple(r) for r in S.preview_windows(found).collect()) == [("p", 1, 7), ("p", 27, 33), ("q", 2, 8)]


def test_comparisons_end_when_their_steps_are_spent(spark):
    old, new = [f"a{i}" for i in range(1500)], [f"b{i}" for i in range(1500)]
    with pytest.raises(C.StepsSpent):
        C.shortest_edit(old, new)
    # Few differences in long sources take few steps.
    long = [f"line {i}" for i in range(100_000)]
    changed = [x for i, x in enumerate(long) if i != 70_000]
    changed[10] = "other"
    assert C.shortest_edit(long, changed, 100) == ([(11, 11), (70_001, 70_001)], [(11, 11)])
    base = table(spark, [("same", "x\n"), ("far", "\n".join(old)), ("near", "x\ny\n")])
    now = table(spark, [("same", "x\n"), ("far", "\n".join(new)), ("near", "x\nz\n")])
    got = {(r["path"], r["side"], r["start_line"]) for r in C.changed_lines(base, now, 1000).collect()}
    assert got == {("far", "unknown", None), ("near", "old", 2), ("near", "new", 2)}


def test_turns_are_taken_in_one_large_tier(spark):
    df = spark.range(500).select(F.lit(1).alias("tier"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("path"), F.col("id").alias("position")).repartition(5)
    df = df.union(spark.createDataFrame([(None, "q", 1), (None, None, 2), (None, None, 1)], "tier int, path string, position long"))
    got = [(r["tier"], r["path"], r["position"]) for r in AC.round_robin(df).orderBy("tier", "ord").collect()]
    want = sorted(((i // 7, f"p{i % 7}", i) for i in range(500)))
    assert got == [(None, None, 1), (None, "q", 1), (None, None, 2), *((1, p, i) for _, p, i in want)]
    assert sorted(r["ord"] for r in AC.round_robin(df.where("tier = 1")).collect()) == list(range(1, 501))


def test_ignore_rules_are_those_of_git(spark, tmp_path):
    files = {
        ".gitignore": "*.log\n!keep.log\n/build\nout/\n**/tmp/x*\na/*/c.txt\n\\#odd\n \ntrail \n[ab].q\n{x}.z\n",
        "a/.gitignore": "!*.log\n/only\nsub/\n", "a/b/.gitignore": "*.log\n!deep.log\n*.md\n", "build/.gitignore": "!*\n",
    }
    names = ["x.log", "keep.log", "c.txt", "only", "#odd", "trail", "a.q", "{x}.z", "x.z", "deep.log", "r.md", "xy", "build", "out", "sub"]
    folders = ["", "a/", "a/b/", "build/", "out/", "q/out/", "tmp/", "q/tmp/", "a/sub/", "a/b/sub/deep/", "a/only/", "q/build/"]
    paths = [f + n for f in folders for n in names]
    git = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, text=True, **k)
    git("init", "-q")
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    hidden = set(git("-c", "core.quotePath=false", "-c", "core.excludesFile=", "check-ignore", "--no-index", "--stdin", input="\n".join(paths)).stdout.split("\n")) - {""}
    got = {r["path"] for r in IG.ignored(table(spark, [(p, "") for p in paths]).select("path"), IG.rules(table(spark, list(files.items())))).collect()}
    assert got == hidden and 20 < len(hidden) < len(paths) - 20
    more = table(spark, [("x/.ssh/id", ""), ("x/ssh/id", "")]).select("path")
    assert [r["path"] for r in IG.visible(more, table(spark, [("x/.gitignore", "!*\n")])).collect()] == ["x/ssh/id"]


class Sources:
    """What a worker does with the batches of some sources: the function given to ``mapInArrow``."""

    def __init__(self, spark):
        self.schema = spark.createDataFrame([], "path string, text string").schema

    def select(self, *names):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return f


def test_passages_leave_a_worker_some_at_a_time(spark):
    texts = ["", None, "ab\n" * 50_000, "é" * 2_000_000, *["line of a text\n" * (i % 200) for i in range(3000)]]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts, pa.string())], names=["path", "text"])
    out = list(M.passages(Sources(spark))([batch]))
    assert max(len(b) for b in out) <= 1024 and max(b.nbytes for b in out) < 4 << 20
    got = [r for b in out for r in b.to_pylist()]
    want = [(str(i), a, b, t.count("\n", 0, a) + 1, t[a:b]) for i, t in enumerate(texts) if t for a, b in M.passage_bounds(t)]
    assert [(r["path"], r["start"], r["end"], r["line"], r["text"]) for r in got] == want
    bare = [r for b in M.passages(Sources(spark), texts=False)([batch]) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in bare] == [r[:4] for r in want]


@pytest.mark.parametrize("by_line", [True, False])
def test_occurrences_leave_a_worker_some_at_a_time(by_line):
    texts = ["aab\n" * 60_000, *["b aa\nab" * 300 for _ in range(400)], ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc", "text"])
    out = list(S._occurring([batch], ["aa", "b"], by_line, True))
    assert len(out) > 5 and max(len(b) for b in out) <= 1 << 15
    want = []
    for doc, text in enumerate(texts):
        at = 0
        for number, line in enumerate(text.split("\n") if by_line else [text], 1):
            want += [(doc, i, t, number, m.start(), m.end(), at) for i, t in enumerate(["aa", "b"]) for m in re.finditer(t, line)]
            at += len(line) + 1
    assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == sorted(want)


def test_arrow_batches_are_small_unless_the_session_says_so(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda s: [r[0] for r in s.range(3000, numPartitions=1).selectExpr("repeat('x', 10000) AS t").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    own = spark.newSession()
    assert max(sizes(small_batches(own))) < 5 << 20
    own.conf.set(name, "16m")
    assert small_batches(own).conf.get(name) == "16m"
