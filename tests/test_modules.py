"""Syntax trees as tables, module graphs and scopes of Python sources."""

import ast

import pytest
from pyspark.sql import functions as F

from sievemark.errors import CapabilityError, EvidenceError
from sievemark.operators import modules as MO
from sievemark.operators import nodes as N
from sievemark.operators import ranges as G
from sievemark.operators.syntax import PythonSyntax
from sievemark.plans.engine import Engine

SOURCE = '''@dec(1)
class A(Base):
    """é"""
    def f(self, x: int = g(2), *y):
        for i in [k(z) for z in y if p(z)]:
            while q():
                r(lambda a: s(a))
        return t(f"{u(1)}")

try:
    v()
except E as e:
    match w():
        case {"k": n, **rest}:
            pass
'''


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_numbers_nest_as_the_tree_does():
    rows = N.python_nodes(SOURCE)
    by = {r[0]: r for r in rows}
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1] == len(rows) - 1
    for node, last, parent, depth, kind, field, name, start, end in rows[1:]:
        p = by[parent]
        assert p[0] < node <= last <= p[1] and depth == p[3] + 1 and 0 <= start < end <= len(SOURCE)
    # Every node with a place is there once, with the text that the parser gives it.
    want = sorted(ast.get_source_segment(SOURCE, n) for n in ast.walk(ast.parse(SOURCE)) if hasattr(n, "lineno"))
    assert sorted(SOURCE[r[7] : r[8]] for r in rows if r[4] not in ("Module", "comprehension")) == want
    assert [SOURCE[r[7] : r[8]] for r in rows if r[4] == "comprehension"] == ["z in y if p(z)"]


def test_questions_about_trees(spark):
    table = N.node_table(frame(spark, [("a.py", SOURCE), ("b.py", "def (:"), ("c.txt", "x"), ("d.py", None), ("e.py", "x = 1\n" * 50)]), PythonSyntax(), 100).cache()
    assert {r["path"]: r["status"] for r in table.groupBy("path").agg(F.first("status").alias("status")).collect()} == {"a.py": "ok", "b.py": "syntax-error", "d.py": "ok", "e.py": "limit"}
    assert sorted(r["name"] for r in N.calls_in_loops(table.where("status = 'ok'")).collect()) == ["k", "p", "q", "r", "s"]
    around = {r["name"]: r["function"] for r in N.enclosing_functions(table.where("status = 'ok'")).collect()}
    assert around == {"g": "f", "k": "f", "p": "f", "q": "f", "r": "f", "s": "lambda", "t": "f", "u": "f"}


def test_sweeps_take_time_in_proportion(spark):
    ranges = spark.range(100_000).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("name"), (F.col("id") * 3).alias("start"), F.when(F.col("id") % 100 == 0, F.col("id") * 3 + 299).otherwise(F.col("id") * 3 + 2).alias("end"))
    points = spark.range(1_000_000).select(F.lit("p").alias("path"), (F.col("id") * 7 % 300_000).alias("at"))
    out = G.smallest_enclosing(points, ranges)
    got = out.agg(F.count(F.lit(1)), F.sum(F.when(F.col("end") - F.col("start") == 2, 1).otherwise(0)), F.sum((F.col("name").cast("long") == F.floor(F.col("at") / 3)).cast("int"))).first()
    # Of three places two are in the short range of their own (one in a hundred has only the long one), the third in a long one.
    assert got[0] == 300_000 - 1000 and got[1] == 2 * (100_000 - 1000) and got[2] == 2 * 100_000 + 1000


TREE = [
    ("pkg/__init__.py", ""),
    ("pkg/core.py", "def run(x):\n    return x\n\nLIMIT = 3\n"),
    ("pkg/api.py", "from .core import run as go, LIMIT\nfrom . import core\n"),
    ("pkg/sub/__init__.py", "from ..api import go\n"),
    ("pkg/sub/leaf.py", "import pkg.core as c\nfrom pkg.sub import go\nfrom .missing import x\nfrom .. import api\nimport os, pkg.core\nfrom pkg.core import nothing\n"),
    ("pkg/wild.py", "from .core import *\n"),
    ("other.py", "from pkg.wild import run\nfrom pkg import *\n"),
]


def traces(spark, rows, **where):
    df = frame(spark, rows)
    out = MO.python_traces(MO.python_facts(df).cache(), df.select("path"))
    return {(r["path"], r["local"]): (r["status"], r["reason"], r["target"], r["name"], r["hops"]) for r in out.collect()}


def test_imports_are_traced_to_their_declarations(spark):
    got = traces(spark, TREE)
    assert got[("pkg/api.py", "go")] == ("resolved", None, "pkg/core.py", "run", 1)
    assert got[("pkg/api.py", "core")] == ("module", None, "pkg/core.py", "*", 1)
    assert got[("pkg/sub/__init__.py", "go")] == ("resolved", None, "pkg/core.py", "run", 2)
    leaf = {k[1]: v for k, v in got.items() if k[0] == "pkg/sub/leaf.py"}
    assert leaf["go"] == ("resolved", None, "pkg/core.py", "run", 3)
    assert leaf["c"] == leaf["pkg"] == ("module", None, "pkg/core.py", "*", 1) and leaf["api"][:3] == ("module", None, "pkg/api.py")
    assert leaf["x"][:2] == ("unresolved", "missing") and leaf["os"][:2] == ("unresolved", "package-or-alias") and leaf["nothing"][:2] == ("unresolved", "export-not-found")
    assert got[("other.py", "run")][:2] == ("unresolved", "export-star-unsupported") and got[("other.py", None)][:3] == ("module", None, "pkg/__init__.py")


def test_absolute_names_begin_at_the_root_of_their_packages(spark):
    rows = [("src/lib/__init__.py", ""), ("src/lib/a.py", "def f(): pass\n"), ("src/lib/b.py", "from lib.a import f\nimport lib\n"), ("tool.py", "import src.lib.a\nimport lib.a\n"), ("src/lone.py", "from lib import a\n")]
    got = traces(spark, rows)
    assert got[("src/lib/b.py", "f")][2] == "src/lib/a.py" and got[("src/lib/b.py", "lib")][2] == "src/lib/__init__.py" and got[("src/lone.py", "a")][2] == "src/lib/a.py"
    assert got[("tool.py", "src")][2] == "src/lib/a.py" and got[("tool.py", "lib")][:2] == ("unresolved", "package-or-alias")


@pytest.mark.parametrize(("body", "uses"), [
    ("go()\n", [1]),
    ("def f(go):\n    go()\n", []),
    ("def f(x=go):\n    go = 1\n    return go\n", [1]),
    ("def f():\n    return [go for go in go]\n", [2]),
    ("x = [go(y) for y in z if go]\n", [1, 1]),
    ("x = {go: 1 for k in go for go in k}\n", [1]),
    ("class A:\n    go = 1\n    x = go\n    def m(self):\n        return go\n", [5]),
    ("class A(go):\n    def go(self): pass\n    y = go\n", [1]),
    ("def f():\n    global go\n    go()\n", [3]),
    ("def f():\n    global go\n    go = 2\n\ngo()\n", []),
    ("def f():\n    def g():\n        nonlocal go\n        go = 1\n    go = 3\n    return go\n", []),
    ("def f():\n    for go in y: pass\n    go\n", []),
    ("def f():\n    with y as (a, go): pass\n    go\n", []),
    ("try: pass\nexcept E as e: go(e)\n", [2]),
    ("def f():\n    try: pass\n    except E as go: pass\n    go\n", []),
    ("def f(y):\n    if (go := y): pass\n    return go\n", []),
    ("def f(y):\n    [(go := v) for v in y]\n    return go\n", []),
    ("def f(y):\n    match y:\n        case {'a': go}: return go\n", []),
    ("lambda go: go(1)\nlambda a: go(a)\n", [2]),
    ("def f():\n    from other import go\n    return go\n", [3]),
    ("def f() -> go:\n    @go\n    def g(): pass\n", [1, 2]),
    ("go.x = 1\ndel go.y\ngo[0] += 1\n", [1, 2, 3]),
    ("import go\ngo()\n", []),
])
def test_uses_are_resolved_by_scope(body, uses):
    facts = MO.module_facts("from lib import go\n" + body)
    assert sorted(f[5] - 1 for f in facts if f[0] == "use" and f[1] == "go") == uses


SUITE = [
    *TREE,
    ("tests/test_core.py", "from pkg.core import run\n\ndef test_one():\n    assert run(1)\n    run(2)\n\ndef test_two(run):\n    run(1)\n\nclass TestMore:\n    def test_three(self):\n        return run\n    def helper(self): run(9)\n"),
    ("tests/test_leaf.py", "from pkg.sub import go\nimport unittest\n\nclass Deep(unittest.TestCase):\n    def test_go(self):\n        go(1)\n"),
    ("tests/core_test.py", "import os\n"),
    ("tests/test_text.py", "def test_x():\n    '''about core'''\n"),
    ("tests/test_far.py", "def test_y(): pass\n"),
    ("pkg/plain.py", "from pkg.core import run\nrun(1)\n"),
]


def test_tests_are_told_apart(spark):
    engine = Engine(frame(spark, SUITE), syntax=PythonSyntax())
    out = engine.search({"mode": "tests", "path": "pkg/core.py", "redact": False})
    got = [(r["test"], r["association"], r["case"], r["uses"]) for r in out.rows]
    assert got == [
        ("tests/test_core.py", "direct", "TestMore.test_three", [12]), ("tests/test_core.py", "direct", "test_one", [4, 5]),
        ("tests/test_leaf.py", "indirect", "Deep.test_go", [6]),
        ("tests/core_test.py", "weak", None, []), ("tests/test_text.py", "weak", None, []),
    ]
    assert {r["test"]: r["reason"] for r in out.rows}["tests/core_test.py"] == "only the names are alike" and not out.partial
    assert [r["test"] for r in engine.search({"mode": "tests", "path": "pkg/core.py", "symbol": "LIMIT"}).rows if r["association"] != "weak"] == []


def test_imports_of_real_sources(spark):
    engine = Engine(frame(spark, [*TREE, ("bad.py", "def (")]), syntax=PythonSyntax())
    ask = lambda **raw: [(r["local"], r["target"]) for r in engine.search({"mode": "imports", **raw}).rows]
    assert ask(path="pkg/api.py") == [("LIMIT", "pkg/core.py"), ("core", "pkg/core.py"), ("go", "pkg/core.py")]
    assert ask(path="pkg/api.py", line=2) == [("core", "pkg/core.py")] and ask(path="pkg/api.py", symbol="run") == [("go", "pkg/core.py")]
    out = engine.search({"mode": "imports", "path": "pkg/core.py"})
    assert out.rows == [] and out.partial and {"1 sources can't be parsed", "there is no import at that place"} <= set(out.reasons)
    with pytest.raises(EvidenceError):
        engine.search({"mode": "imports", "path": "no.py"})
    with pytest.raises(CapabilityError):
        engine.search({"mode": "imports", "path": "x.ts"})
