import os
import subprocess
import uuid

import pytest
from pyspark.sql import functions as F

from sievemark.errors import CapabilityError, CursorError, EvidenceError
from sievemark.functions.pattern import Pattern
from sievemark.operators import access, audit, semantic
from sievemark.operators import syntax as SX
from sievemark.operators.semantic import HashingEncoder
from sievemark.plans.contract import Limits, context_tier, parse
from sievemark.plans.engine import Engine
from sievemark.plans.snapshots import Cursor
from sievemark.sources import git, workspace
from sievemark.streaming.lines import counts_by_window, watch

ROWS = [("src/a.py", "class A:\n    def run(self):\n        return 'needle'\n"), ("src/b.txt", "no\nNeedle and needle\npassword = \"hunter2 needle\"\n"), ("doc/c.md", "needle\n" * 5), (".hidden/d", "needle")]


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


@pytest.fixture
def engine(spark):
    return Engine(spark.createDataFrame(ROWS, "path string, text string"), clock=Clock(), limits=Limits(page_matches=3, snapshots=3))


@pytest.mark.parametrize(("raw", "code"), [
    ({"mode": "nope"}, "E_MODE_UNKNOWN"), ({"mode": "callers"}, "E_MODE_REFUSED"), ({"pattern": "a", "query": "b"}, "E_FIELD_UNKNOWN"), ({"pattern": "a", "context": 21}, "E_FIELD_BOUNDS"),
    ({"pattern": "a", "anyOf": ["b", "c"]}, "E_SELECTOR"), ({}, "E_SELECTOR"), ({"mode": "audit"}, "E_FIELD_MISSING"), ({"mode": "inspect"}, "E_FIELD_MISSING"), ({"pattern": "a", "limit": True}, "E_FIELD_BOUNDS"),
])
def test_contract_errors(raw, code):
    with pytest.raises(EvidenceError) as e:
        parse(raw)
    assert e.value.code == code


def test_a_safe_field_is_offered_without():
    with pytest.raises(EvidenceError) as e:
        parse({"mode": "files", "query": "x", "scope": "strict"})
    assert e.value.next_request == {"mode": "files", "query": "x"} and e.value.recovery == "retry"
    assert [context_tier(x)[0] for x in (0.5, 0.3, 0.1)] == ["full", "tight", "critical"]


def test_content_search_pages(engine):
    first = engine.search({"mode": "matches", "pattern": "needle", "ignoreCase": False})
    assert (first.counts["found"], first.counts["files"], first.counts["returned"], first.status) == (9, 4, 3, "complete")
    seen, cursor = first.rows, first.cursor
    while cursor:
        page = engine.search({"mode": "matches", "cursor": cursor})
        seen, cursor = seen + page.rows, page.cursor
    assert [(r["path"], r["line_no"]) for r in seen] == sorted((r["path"], r["line_no"]) for r in seen) and len(seen) == 9
    assert engine.session.queries == 1 and engine.session.continued == 2


def test_auto_gives_a_summary_when_a_page_is_too_small(engine):
    out = engine.search({"pattern": "needle", "ignoreCase": False})
    assert out.kind == "summary" and out.rows[0] == {"path": "doc/c.md", "match_lines": 5, "occurrences": 5}
    assert engine.search({"pattern": "Needle", "ignoreCase": False}).kind == "matches"


def test_secrets_are_masked_in_what_is_shown_only(engine):
    out = engine.search({"mode": "matches", "pattern": "hunter2", "literal": True, "context": 1})
    assert out.rows[0]["excerpt"] == 'password = "[REDACTED]"' and out.counts["found"] == 1 and out.facts["redacted"] >= 1
    assert "hunter2" not in str(out.rows)
    assert "hunter2" in engine.search({"mode": "matches", "pattern": "hunter2", "redact": False}).rows[0]["excerpt"]


def test_scope_expands_only_if_it_may(engine):
    out = engine.search({"mode": "matches", "pattern": "password", "path": "doc"})
    assert out.facts["expanded_to_root"] and out.counts["found"] == 1
    assert engine.search({"mode": "matches", "pattern": "password", "path": "doc", "scope": "strict"}).counts["found"] == 0


def test_cursors_fail_in_their_own_ways(engine):
    out = engine.search({"mode": "matches", "pattern": "needle"})
    c = Cursor.parse(out.cursor)
    for bad, code in ((("x"), "E_CURSOR_MALFORMED"), (str(Cursor("00000000-0000-4000-8000-000000000000", "matches", 0)), "E_CURSOR_NOT_FOUND"), (str(Cursor(c.snapshot, "analysis", 0)), "E_CURSOR_KIND"), (str(Cursor(c.snapshot, "matches", 999)), "E_CURSOR_OFFSET"), (str(Cursor(c.snapshot, "matches", 0, "abc")), "E_CURSOR_OPTIONS")):
        with pytest.raises(CursorError) as e:
            engine.search({"mode": "matches", "cursor": bad})
        assert e.value.code == code
    engine.snapshots.clock.now = 601
    with pytest.raises(CursorError) as e:
        engine.search({"mode": "matches", "cursor": out.cursor})
    assert e.value.code == "E_CURSOR_EXPIRED"


def test_selected_paths_have_pages_of_their_own(engine):
    out = engine.search({"mode": "matches", "pattern": "needle"})
    snap, _ = engine.snapshots.get(out.cursor)
    rows, _ = engine.snapshots.page(engine.snapshots.select(snap, ["src/b.txt"]), 9)
    assert [r["line_no"] for r in rows] == [2, 3]


def test_audit_is_unknown_under_partial_coverage(spark):
    rows = [(*r, r[0].startswith(".")) for r in ROWS]
    df = spark.createDataFrame(rows, "path string, text string, ignored boolean")
    ask = {"mode": "audit", "patterns": [{"id": "a", "literal": "needle"}, {"id": "b", "literal": "absent"}]}
    status = lambda out: {r["id"]: r["status"] for r in out.rows}
    assert status(Engine(df).search(ask)) == {"a": "present", "b": "unknown"}
    out = Engine(df).search(ask | {"ignorePolicy": "include"})
    assert status(out) == {"a": "present", "b": "absent_with_complete_coverage"} and not out.partial
    assert Engine(df).search({"mode": "matches", "pattern": "needle"}).coverage["filesystem"] == "policy-filtered"


def test_other_modes(spark, engine):
    assert engine.search({"mode": "files", "query": "b.txt"}).rows[0]["path"] == "src/b.txt"
    assert {r["name"] for r in engine.search({"mode": "outline", "path": "src/a.py"}).rows} == {"A", "run"}
    block = engine.search({"mode": "inspect", "path": "src/a.py", "line": 3}).rows[0]
    assert (block["start_line"], block["end_line"]) == (2, 4)
    assert engine.search({"anyOf": ["needle", "class"]}).facts["term_counts"] == {"needle": (9, 4), "class": (1, 1)}
    assert [r["path"] for r in engine.search({"allOf": ["needle", "password"]}).rows] == ["src/b.txt"]
    assert any(r["language"] == "python" and r["sources"] == 1 for r in engine.search({"mode": "capabilities"}).rows)
    for raw in ({"mode": "concept", "query": "x"}, {"mode": "hybrid", "query": "x"}, {"mode": "structure", "pattern": "f($A)"}, {"mode": "imports", "path": "a.ts"}, {"pattern": "x", "roles": ["comment"]}):
        with pytest.raises(CapabilityError):
            engine.search(raw)
    both = Engine(engine.sources, encoder=HashingEncoder()).search({"mode": "hybrid", "query": "needle"})
    assert [r["tier"] for r in both.rows] == sorted(r["tier"] for r in both.rows) and both.counts["exact"] == 10
    assert sum(r["tier"] == 0 for r in both.rows) == 3


CODE = [
    ("a.py", "import os\n\ndef one(x):\n    # needle here\n    return os.go(x, x)\n\nclass A:\n    def two(self):\n        return 'needle' + go(self, 1)\n"), ("b.py", "def broken(:\n needle\n"),
    ("c.txt", "needle\n"), ("d.py", "é = '€'; go(é, é)  # needle\r\nneedle = f'{go(1, 1)!r} needle'\n"),
]


def test_structure_roles_and_functions_of_python(spark):
    engine = Engine(spark.createDataFrame(CODE, "path string, text string"), syntax=SX.PythonSyntax())
    out = engine.search({"mode": "structure", "pattern": "go($A, $A)"})
    assert [(r["path"], r["line"], r["excerpt"]) for r in out.rows] == [("d.py", 1, "go(é, é)"), ("d.py", 2, "go(1, 1)")]
    assert out.partial and "1 sources can't be parsed" in out.reasons
    assert [r["excerpt"] for r in engine.search({"mode": "structure", "pattern": "$F($$$ARGS)"}).rows] == ["os.go(x, x)", "go(self, 1)", "go(é, é)", "go(1, 1)"]
    assert [r["excerpt"] for r in engine.search({"mode": "structure", "pattern": "def $F($$$):\n    return $X"}).rows] == ["def one(x):\n    # needle here\n    return os.go(x, x)", "def two(self):\n        return 'needle' + go(self, 1)"]
    assert [r["path"] for r in engine.search({"mode": "structure", "pattern": "go($A, $A)", "maxFilesToParse": 1}).rows] == []
    for bad in ("go(", "  ", "x" * 5000):
        with pytest.raises(EvidenceError):
            engine.search({"mode": "structure", "pattern": bad})
    lines = lambda roles: [(r["path"], r["line_no"]) for r in engine.search({"mode": "matches", "pattern": "needle", "roles": roles}).rows]
    assert lines(["comment"]) == [("a.py", 4), ("d.py", 1)] and lines(["string"]) == [("a.py", 9), ("d.py", 2)] and lines(["code"]) == [("d.py", 2)]
    inside = engine.search({"allOf": ["needle", "go("], "within": "function"})
    assert [(r["path"], r["scope"]) for r in inside.rows] == [("a.py", "one"), ("a.py", "two")] and inside.partial is False
    assert [r["path"] for r in engine.search({"allOf": ["needle", "go("]}).rows] == ["a.py", "d.py"]
    offered = {r["capability"]: r["available"] for r in engine.search({"mode": "capabilities"}).rows if r["language"] == "python"}
    assert offered == {"outline": True, "roles": True, "structure": True, "imports": True, "tests": True}


def test_terms_found_and_retained(spark):
    df = spark.createDataFrame([(f"p{i}", "ab\n" * 5 + "cd") for i in range(6)], "path string, text string")
    out = Engine(df, limits=Limits(retained_occurrences=10, term_bytes=70)).search({"anyOf": ["ab", "cd"]})
    assert out.counts["found"] == 36 and out.counts["retained"] == 10 and out.partial
    # Terms are kept in the order in which they are asked for.
    assert out.facts["term_counts"] == {"ab": (30, 6)} and out.facts["retained_counts"] == {"ab": 10}
    engine = Engine(df, limits=Limits(term_bytes=70))
    first = engine.search({"anyOf": ["ab", "cd"]})
    again = engine.search({"cursor": first.facts["term_cursor"]})
    assert [(r["term"], r["found"], r["retained"]) for r in again.rows] == [("cd", 6, 6)] and again.cursor is None


def test_a_short_context_gives_summaries(spark):
    df = spark.createDataFrame([(f"folder/{i:03}", "needle\n") for i in range(40)], "path string, text string")
    assert Engine(df, limits=Limits(page_bytes=16_384)).search({"pattern": "needle"}).kind == "matches"
    tight, full = (Engine(df, remaining=x, limits=Limits(summary_files=40)).search({"pattern": "needle"}) for x in (0.05, 0.9))
    assert (tight.kind, full.kind) == ("summary", "matches") and len(tight.rows) < 40
    assert len(Engine(df, remaining=0.05).search({"mode": "matches", "pattern": "needle"}).rows) < 40


def test_a_long_block_goes_on_by_cursor(spark):
    text = "def f():\n" + "".join(f"    x{i} = 'é'\n" for i in range(60))
    engine = Engine(spark.createDataFrame([("a.py", text)], "path string, text string"), limits=Limits(page_bytes=300))
    out = engine.search({"mode": "inspect", "path": "a.py", "line": 3})
    parts = [out.rows[0]["text"]]
    while out.cursor:
        assert out.partial and len(out.rows[0]["text"].encode()) <= 300
        cursor, out = out.cursor, engine.search({"mode": "inspect", "cursor": out.cursor})
        parts.append(out.rows[0]["text"])
    assert "".join(parts) == text and len(parts) > 2 and engine.search({"mode": "inspect", "cursor": cursor}).rows[0]["text"] == parts[-1]
    with pytest.raises(EvidenceError):
        engine.search({"mode": "inspect", "cursor": cursor[:-1] + ("1" if cursor[-1] != "1" else "2")})


def test_credentials_are_not_listed():
    home = workspace.Path.home()
    for p in (home / ".config/gh/x", home / ".netrc", home / ".password-store", "/proc/1", "/x/.ssh/id"):
        assert workspace.protected(workspace.Path(p))
    assert not workspace.protected(workspace.Path("/x/config/gh"))


class Judge:
    classes = ("good", "bad")

    def judge(self, query, texts):
        if len(texts) > 2:
            raise ValueError("too many")
        return [("good" if query in t else "bad", 0.5) for t in texts]


def test_a_judge_orders_and_never_removes(engine):
    plain = Engine(engine.sources, encoder=HashingEncoder())
    judged = Engine(engine.sources, encoder=HashingEncoder(), judge=Judge())
    ask = {"mode": "hybrid", "query": "Needle"}
    key = lambda out: sorted((r["path"], r["start"]) for r in out.rows)
    out = judged.search(ask)
    assert key(out) == key(plain.search(ask)) and not out.partial
    assert [r["class"] for r in out.rows] == sorted((r["class"] for r in out.rows), key=Judge.classes.index)


def test_batches_windows_and_caches(spark):
    assert semantic.judge_batches(["a" * 30, "b" * 30, "c" * 90, "d", "e"], 2, 60) == [[0, 1], [3, 4]]
    assert semantic.token_windows(0) == [] and semantic.token_windows(256) == [(0, 256)] and semantic.token_windows(300) == [(0, 256), (192, 300)]
    cache = spark.createDataFrame([("a", [1.0], 5), ("b", [1.0], 9), ("c", [1.0], 7)], "key string, embedding array<float>, used_ms long")
    assert {r["key"] for r in semantic.prune_cache(cache, 10).collect()} == {"b", "c"}
    one, two = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert audit.same_rows(one, one) and not audit.same_rows(one, two)
    pages, at = access.Continuations("aé😀b" * 5, 7), 0
    text = ""
    while at is not None:
        piece, at = pages.page(at)
        text += piece
    assert text == "aé😀b" * 5
    with pytest.raises(EvidenceError):
        pages.page(1)
    assert access.source_page("x" * 50, 25, 10) == (20, 30) and len(("é" * 50)[slice(*access.source_page("é" * 50, 0, 10))].encode()) <= 10


def test_validation_of_saved_evidence(spark):
    before = spark.createDataFrame(ROWS, "path string, text string")
    now = before.where("path <> 'doc/c.md'").withColumn("text", F.when(F.col("path") == "src/b.txt", "changed").otherwise(F.col("text")))
    engine = Engine(before, current=lambda: now)
    saved = engine.search({"mode": "matches", "pattern": "needle"})
    out = engine.search({"mode": "validate", "cursor": str(Cursor(saved.facts["snapshot"], "matches", 0))})
    assert [(r["path"], r["status"]) for r in out.rows] == [("doc/c.md", "stale"), ("src/b.txt", "stale"), (".hidden/d", "current"), ("src/a.py", "current")]
    assert out.facts["validity"] == "stale" and out.partial


def test_a_source_that_changes_behind_a_search_is_stale(spark, tmp_path):
    place, other = str(tmp_path / "t"), str(tmp_path / "u")
    write = lambda rows, to: spark.createDataFrame(rows, "path string, text string").write.mode("overwrite").parquet(to)
    write(ROWS, place)
    engine = Engine(lambda: spark.read.parquet(place), encoder=HashingEncoder(), syntax=SX.PythonSyntax())
    asked = {
        "matches": {"mode": "matches", "pattern": "needle"}, "analysis-terms": {"anyOf": ["needle", "class"]}, "analysis": {"allOf": ["needle", "class"]},
        "analysis-hybrid": {"mode": "hybrid", "query": "needle"},
    }
    saved = {kind: engine.search(raw) for kind, raw in asked.items()}
    structure = engine.search({"mode": "structure", "pattern": "class $A: $$$"})
    status = lambda kind, out, **more: {x["path"]: x["status"] for x in engine.search({"mode": "validate", "cursor": str(Cursor(out.facts["snapshot"], kind, 0)), **more}).rows}
    assert all(set(status(kind, out).values()) == {"current"} for kind, out in saved.items())
    write([("src/a.py", "class A: needle = 1\n"), *ROWS[1:3]], other)
    spark.read.parquet(other).write.mode("overwrite").parquet(place)
    assert status("matches", saved["matches"]) == {".hidden/d": "stale", "src/a.py": "stale", "src/b.txt": "current", "doc/c.md": "current"}
    assert status("matches", saved["matches"], matchIndex=2) == {"doc/c.md": "current"}
    assert status("analysis", saved["analysis"]) == status("analysis", structure) == {"src/a.py": "stale"}
    assert status("analysis-terms", saved["analysis-terms"])["src/a.py"] == "stale" and status("analysis-hybrid", saved["analysis-hybrid"])[".hidden/d"] == "stale"
    out = engine.search({"mode": "validate", "cursor": str(Cursor(saved["matches"].facts["snapshot"], "matches", 0))})
    assert [(r["path"], r["reason"]) for r in out.rows][:2] == [(".hidden/d", "the source is gone"), ("src/a.py", "the source has changed")]
    # The saved pages are what they were, and a new search sees the new text.
    assert engine.search({"mode": "matches", "pattern": "class A: needle", "literal": True}).counts["found"] == 1


def test_sources_that_cannot_be_read_again_are_unknown(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "path string, text string").write.parquet(place)
    engine = Engine(spark.read.parquet(place))
    saved = engine.search({"mode": "matches", "pattern": "needle"})
    spark.createDataFrame(ROWS[:1], "path string, text string").write.mode("overwrite").parquet(place)
    out = engine.search({"mode": "validate", "cursor": str(Cursor(saved.facts["snapshot"], "matches", 0))})
    assert {x["status"] for x in out.rows} == {"unknown"} and out.partial and out.facts["validity"] == "unknown"


def test_only_some_sources_are_checked_and_it_is_said(spark):
    engine = Engine(spark.createDataFrame(ROWS, "path string, text string"), limits=Limits(validated_sources=3))
    saved = engine.search({"mode": "matches", "pattern": "needle"})
    out = engine.search({"mode": "validate", "cursor": str(Cursor(saved.facts["snapshot"], "matches", 0))})
    assert [x["path"] for x in out.rows] == [".hidden/d", "doc/c.md", "src/a.py"] and out.facts["validity"] == "unknown" and "1 more sources were not checked" in out.reasons


def test_absence_is_not_told_when_sources_change_during_the_scan(spark, tmp_path, monkeypatch):
    place, other = str(tmp_path / "t"), str(tmp_path / "u")
    spark.createDataFrame(ROWS, "path string, text string").write.parquet(place)
    ask = {"mode": "audit", "patterns": [{"id": "a", "literal": "needle"}, {"id": "b", "literal": "absent"}]}
    engine = Engine(lambda: spark.read.parquet(place))
    assert [x["status"] for x in engine.search(ask).rows] == ["present", "absent_with_complete_coverage"]
    scan = audit.audit

    def slow(*args):
        out = scan(*args)
        out.count()
        spark.createDataFrame([("doc/c.md", "absent\n"), *ROWS[:2]], "path string, text string").write.mode("overwrite").parquet(other)
        monkeypatch.setattr(audit, "audit", scan)
        return out

    monkeypatch.setattr(audit, "audit", slow)
    out = Engine(lambda: spark.read.parquet(place), current=lambda: spark.read.parquet(other)).search(ask)
    assert [x["status"] for x in out.rows] == ["present", "unknown"] and out.partial and out.facts["changed_sources"] == [".hidden/d", "doc/c.md"]


def test_roles_are_those_of_occurrences(spark):
    text = "x = needle('needle')  # needle needle\n"
    engine = Engine(spark.createDataFrame([("a.py", text), ("b.py", "needle = 1\n")], "path string, text string"), syntax=SX.PythonSyntax())
    ask = lambda role: engine.search({"mode": "matches", "pattern": "needle", "roles": [role]})
    for role, n in (("comment", 2), ("string", 1), ("call", 1)):
        out = ask(role)
        assert (out.counts["found"], out.counts["occurrences"], out.counts["files"], out.rows[0]["n"], len(out.rows[0]["occurrences"])) == (1, n, 1, n, n)
    assert [(x["start"], x["end"]) for x in ask("comment").rows[0]["occurrences"]] == [(24, 30), (31, 37)]
    assert ask("code").counts["occurrences"] == 2 and ask("declaration").counts["found"] == 0
    many = engine.search({"anyOf": ["needle", "x ="], "roles": ["comment"]})
    assert many.counts["found"] == 2 and many.facts["term_counts"] == {"needle": (2, 1), "x =": (0, 0)}
    assert [r["path"] for r in engine.search({"allOf": ["needle", " = "], "roles": ["code"]}).rows] == ["a.py", "b.py"]
    assert engine.search({"mode": "matches", "pattern": "needle", "roles": ["code"], "maxFilesToParse": 1}).partial


def test_occurrences_lie_wholly_in_changed_lines(spark):
    base = spark.createDataFrame([("a", "one\ntwo\nthree\n"), ("b", "x\ny")], "path string, text string")
    now = spark.createDataFrame([("a", "one\nTWO two\nthree\n"), ("b", "x\ny z"), ("c", "two\n")], "path string, text string")
    engine = Engine(now, base=base)
    lines = lambda **raw: [(r["path"], r["line_no"]) for r in engine.search({"mode": "matches", "changes": {}, **raw}).rows]
    assert lines(pattern="two", ignoreCase=False) == [("a", 2), ("c", 1)] and lines(pattern="three") == []
    # An empty match belongs to the line that it begins in; at the end of a last line without a line feed it counts.
    assert lines(pattern="^") == [("a", 2), ("b", 2), ("c", 1)] and lines(pattern="$") == [("a", 2), ("b", 2), ("c", 1)]
    out = engine.search({"anyOf": ["two", "x"], "changes": {}})
    assert out.facts["term_counts"] == {"two": (2, 2), "x": (0, 0)} and [(r["path"], r["line_no"], r["start"]) for r in out.rows] == [("a", 2, 4), ("c", 1, 0)]
    assert [r["path"] for r in engine.search({"allOf": ["y", "z"], "changes": {}}).rows] == ["b"] and engine.search({"allOf": ["x", "z"], "changes": {}}).rows == []


@pytest.mark.parametrize("raw", [
    {"anyOf": ["a", "b"], "ignoreCase": True}, {"allOf": ["a", "b"], "literal": True}, {"anyOf": ["a", "b"], "context": 2}, {"pattern": "a", "matchIndex": 1}, {"anyOf": ["a", "b"], "scope": "auto"},
    {"mode": "outline", "path": "a", "cursor": "x"}, {"mode": "outline", "path": "a", "matchIndex": 1},
])
def test_fields_without_use_are_refused(raw):
    with pytest.raises(EvidenceError):
        parse(raw)


def test_a_saved_match_is_followed(engine):
    out = engine.search({"mode": "matches", "pattern": "return"})
    cursor = str(Cursor(out.facts["snapshot"], "matches", 0))
    assert [r["name"] for r in engine.search({"mode": "outline", "cursor": cursor, "matchIndex": 1}).rows] == ["A", "run"]
    with pytest.raises(EvidenceError):
        engine.search({"mode": "outline", "cursor": cursor, "matchIndex": 9})


def test_nothing_outlines_other_languages(spark):
    for facts in (None, {"imports": None}):
        engine = Engine(spark.createDataFrame(ROWS, "path string, text string"), syntax=SX.PythonSyntax(), facts=facts)
        with pytest.raises(CapabilityError):
            engine.search({"mode": "outline", "path": "src/x.ts"})


def test_all_passages_take_part(spark):
    rows = [(f"p{i:02}", "needle here\n" if i % 2 else "other words\n") for i in range(30)]
    engine = Engine(spark.createDataFrame(rows, "path string, text string"), encoder=HashingEncoder(), limits=Limits(retained_lines=10))
    out = engine.search({"mode": "concept", "query": "other words"})
    assert out.partial and out.counts["found"] == 30 and out.counts["retained"] == 10
    assert out.facts["score_profile"]["n"] == 30 if "n" in out.facts["score_profile"] else True
    hybrid = engine.search({"mode": "hybrid", "query": "needle"})
    assert hybrid.counts["exact"] == 15 and not hybrid.partial
    assert engine.search({"mode": "concept", "query": "x", "maxFilesToParse": 3}).counts["found"] == 3


def test_dropped_snapshots_leave_no_files(spark, tmp_path):
    engine = Engine(spark.createDataFrame(ROWS, "path string, text string"), limits=Limits(snapshots=1))
    first = engine.search({"mode": "matches", "pattern": "needle"})
    held, _ = engine.snapshots.get(str(Cursor(first.facts["snapshot"], "matches", 0)))
    files = [d._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for d in (held.rows, held.manifest)]
    assert all(os.path.isdir(f) for f in files)
    engine.search({"mode": "matches", "pattern": "class"})
    assert not any(os.path.isdir(f) for f in files)


def test_search_in_changed_lines(spark):
    base = spark.createDataFrame([("src/b.txt", "no\nNeedle and needle\n"), *ROWS[2:]], "path string, text string")
    out = Engine(spark.createDataFrame(ROWS, "path string, text string"), base=base).search({"mode": "matches", "pattern": "needle", "changes": {}})
    assert [(r["path"], r["line_no"]) for r in out.rows] == [("src/a.py", 3), ("src/b.txt", 3)]


def test_operations(spark, engine):
    done = engine.start({"mode": "files", "query": "c.md"}, 120)
    assert done.kind == "files"
    op = engine.operations.start(lambda: spark.range(10**9).selectExpr("sum(sqrt(id))").collect())
    assert engine.search({"mode": "cancel", "operationId": op.id}).rows[0]["state"] == "cancelled"
    with pytest.raises(EvidenceError):
        engine.search({"mode": "await", "operationId": "none"})


def test_workspace(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"text\n", ".hidden": b"h", "sub/_x.log": b"log", "bin": b"a\0b", "bad": b"\xff\xfea", "broken": b"ab\xffc", "empty": b"", "big": b"x" * 50, ".gitignore": b"*.log\n"}.items():
        (tmp_path / name).write_bytes(data)
    df, listing = workspace.read_workspace(spark, str(tmp_path), str(tmp_path), source_bytes=40)
    got = {r["path"]: (r["status"], r["ignored"]) for r in df.collect()}
    assert got == {"a.txt": ("admitted", False), ".hidden": ("admitted", False), "sub/_x.log": ("admitted", True), "bin": ("binary", False), "bad": ("unavailable", False), "broken": ("unavailable", False), "empty": ("empty", False), "big": ("unavailable", False), ".gitignore": ("admitted", False)}
    assert not listing.partial and workspace.list_workspace(str(tmp_path), str(tmp_path), 2).partial
    with pytest.raises(EvidenceError):
        workspace.admitted_root("/proc", str(tmp_path))


def test_git_trees(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "é.txt").write_text("one\n")
    (tmp_path / "b.bin").write_bytes(b"\0")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "new").write_text("n")
    got = {r["path"]: r["text"] for r in git.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"é.txt": "one\n", "b.bin": None}
    assert git.worktree_names(str(tmp_path)) == ["b.bin", "new", "é.txt"]


def test_streams(spark, tmp_path):
    schema = "path string, text string, at timestamp"
    spark.createDataFrame([("p", "a needle\nb", None), ("q", "none", None)], schema).withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for i, (df, mode) in enumerate(((watch(source, Pattern("needle", literal=True)), "append"), (counts_by_window(source, Pattern("needle", literal=True), "at"), "complete"))):
        q = df.writeStream.format("memory").queryName(f"found{i}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"found{i}").count() == 1


class CountingEncoder(HashingEncoder):
    """Notes in a folder what it is asked for, so that the tests see what workers embed."""

    def __init__(self, folder, window_tokens=None):
        super().__init__(64, window_tokens)
        self.folder = folder

    def encode(self, texts, role):
        if role == "passage":
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(map(repr, texts)))
        return super().encode(texts, role)

    def seen(self):
        out = [line for name in os.listdir(self.folder) for line in open(f"{self.folder}/{name}").read().split("\n")]
        for name in os.listdir(self.folder):
            os.remove(f"{self.folder}/{name}")
        return out


def test_long_passages_are_read_in_windows(spark):
    encoder = HashingEncoder(64, 8)
    text = "  " + " ".join(f"w{i}" for i in range(20)) + " end \n"
    bounds = semantic.window_bounds(text, encoder)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(a < c < b < d for (a, b), (c, d) in zip(bounds, bounds[1:]))
    assert all(len(text[a:b].split()) <= 8 for a, b in bounds) and semantic.window_bounds("a b", encoder) == [(0, 3)] and semantic.window_bounds(text, HashingEncoder()) == [(0, len(text))]
    # What matters stands in the last window of a passage, where a reader of its first tokens would not get.
    rows = [("long", " ".join(f"filler{i % 3}" for i in range(60)) + " quartz heron umbrella"), ("short", "filler1 filler2 umbrella things here")]
    df = spark.createDataFrame(rows, "path string, text string")
    first = lambda e: semantic.concept(df, "quartz heron umbrella", e, 1).first()
    assert first(encoder)["path"] == "long" and first(encoder)["score"] > 0.8 and first(HashingEncoder())["score"] < first(encoder)["score"]


def test_a_cache_embeds_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    clock = Clock()
    encoder = CountingEncoder(str(tmp_path / "seen"))
    cache = semantic.EmbeddingCache(spark, f"file://{tmp_path}/cache", clock)
    df = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "one two")], "path string, text string")
    ask = lambda rows: sorted((r["path"], round(r["score"], 6)) for r in semantic.concept(rows, "one", encoder, None, cache).collect())
    want = sorted((r["path"], round(r["score"], 6)) for r in semantic.concept(df, "one", HashingEncoder(), None).collect())
    assert ask(df) == want and sorted(encoder.seen()) == ["'one two'", "'three'"]
    assert ask(df) == want and encoder.seen() == []
    # A write that was broken off has no mark, and is not read.
    spark.createDataFrame([("bad", [0.0])], "key string, embedding array<float>").write.parquet(f"file://{tmp_path}/cache/vectors-broken")
    assert cache.vectors().count() == 2
    clock.now = 10.0
    assert ask(df.where("path = 'b'")) == [x for x in want if x[0] == "b"]
    # The vector used last stays; the other one is embedded again when it is needed.
    cache.prune(64 * 4 + 64)
    assert cache.vectors().count() == 1 and len(cache.folders("vectors")) == 1
    assert ask(df) == want and encoder.seen() == ["'one two'"] and cache.vectors().count() == 2
    engine = Engine(df, encoder=encoder, cache=cache)
    assert engine.search({"mode": "concept", "query": "one"}).counts["found"] == 3 and encoder.seen() == []
