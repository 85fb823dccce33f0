"""The module graph of Python sources: facts of imports, exports and declarations, dotted and relative names
resolved to modules and packages, and uses of imported names resolved by lexical scope.

A worker reads one source at a time; everything between sources is a join of fact tables.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .nodes import children
from .structure import trace_imports
from .syntax import Places, parsed

#: Names of test sources, and of the functions and classes that are test cases in them.
TEST_SOURCE = r"(^|/)(__tests__|tests?)/|(^|/)test_[^/]*\.py$|_test\.py$|[._-](test|spec)\.[^/]+$"
TEST_CASE, TEST_CLASS = "test", "Test"

_FACTS = "path string, fact string, local string, imported string, specifier string, kind string, line long, end_line long, start long, end long, case string"
_COLUMNS = [c.split()[0] for c in _FACTS.split(", ")]


# Scopes of one source


@dataclass
class Scope:
    """The names that a module, function, class or comprehension binds: the import that binds a name, or None."""

    kind: str
    around: Scope | None
    case: str | None = None
    suite: str | None = None
    bound: dict[str, list] = field(default_factory=lambda: defaultdict(list))
    elsewhere: dict[str, str] = field(default_factory=dict)

    def of(self, name: str) -> Scope | None:
        """The scope whose name is meant.  What a class binds is seen in the class itself alone."""
        scope: Scope | None = self
        if self.elsewhere.get(name) == "global":
            while scope.around is not None:
                scope = scope.around
            return scope if name in scope.bound else None
        while scope is not None:
            if name in scope.bound and (scope is self or scope.kind != "class"):
                return scope
            scope = scope.around
        return None


_SCOPED = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Lambda: "function", ast.ClassDef: "class", ast.ListComp: "comprehension", ast.SetComp: "comprehension", ast.DictComp: "comprehension", ast.GeneratorExp: "comprehension"}


def _is_suite(node: ast.ClassDef) -> bool:
    return node.name.startswith(TEST_CLASS) or any("TestCase" in ast.unparse(b) for b in node.bases)


class Reading:
    """Bindings and uses of a source.  ``imports``: ``(local, imported, specifier, kind, node, at_top)``."""

    def __init__(self, text: str):
        self.places, self.root = Places(text), parsed(text)
        self.module = Scope("module", None)
        self.imports: list[tuple] = []
        self.stars: list[str] = []
        self.uses: list[tuple[Scope, ast.Name]] = []
        todo: list[tuple[ast.AST, Scope]] = [(self.root, self.module)]
        while todo:
            node, scope = todo.pop()
            todo += reversed(self._step(node, scope))

    def _step(self, node: ast.AST, scope: Scope) -> list[tuple[ast.AST, Scope]]:
        """Note what a node binds or uses; its children with the scopes that they stand in."""
        kind = _SCOPED.get(type(node))
        if kind is None:
            self._bind(node, scope)
            return [(child, scope) for _, child in children(node)]
        name = getattr(node, "name", None)
        if name:
            scope.bound[name].append(None)
        case, suite = scope.case, None
        if kind == "function" and name and name.startswith(TEST_CASE) and (scope.kind == "module" or scope.suite):
            case = f"{scope.suite}.{name}" if scope.suite else name
        elif kind == "class" and scope.kind == "module" and _is_suite(node):
            suite = name
        inner = Scope(kind, scope, case, suite)
        out = []
        for name, child in children(node):
            # Decorators, defaults, bases and the first iterable of a comprehension stand outside of the scope.
            outside = name in ("decorator_list", "bases", "keywords", "returns", "defaults", "kw_defaults")
            if isinstance(child, ast.comprehension):
                first = child is node.generators[0]
                out += [(child.iter, scope if first else inner), (child.target, inner), *((test, inner) for test in child.ifs)]
            elif isinstance(child, ast.arg):
                inner.bound[child.arg].append(None)
                out += [(child.annotation, scope)] if child.annotation else []
            else:
                out.append((child, scope if outside else inner))
        return out

    def _bind(self, node: ast.AST, scope: Scope) -> None:
        target = scope
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                self.uses.append((scope, node))
                return
            self._bound(target, node.id, None)
        elif isinstance(node, ast.NamedExpr):
            # Binds where the comprehension stands.
            while target.kind == "comprehension":
                target = target.around
            self._bound(target, node.target.id, None)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            for name in node.names:
                target.elsewhere[name] = "global" if isinstance(node, ast.Global) else "nonlocal"
        elif isinstance(node, ast.ExceptHandler) and node.name:
            self._bound(target, node.name, None)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            self._bound(target, node.name, None)
        elif isinstance(node, ast.MatchMapping) and node.rest:
            self._bound(target, node.rest, None)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                self._imported(target, alias.asname or alias.name.split(".")[0], "*", alias.name, "namespace", node)
        elif isinstance(node, ast.ImportFrom):
            specifier = "." * node.level + (node.module or "")
            for alias in node.names:
                if alias.name == "*":
                    self.stars.append(specifier)
                    self.imports.append((None, "*", specifier, "side-effect", node, target is self.module))
                else:
                    self._imported(target, alias.asname or alias.name, alias.name, specifier, "named", node)

    def _bound(self, scope: Scope, name: str, what) -> None:
        if scope.elsewhere.get(name) == "global":
            scope = self.module
        scope.bound[name].append(what)

    def _imported(self, scope: Scope, local: str, imported: str, specifier: str, kind: str, node: ast.AST) -> None:
        entry = (local, imported, specifier, kind, node, scope is self.module)
        self.imports.append(entry)
        self._bound(scope, local, entry)

    def used(self) -> Iterator[tuple[Scope, ast.Name, tuple]]:
        """Uses of names that an import binds, and nothing else in the scope that is meant."""
        for scope, node in self.uses:
            home = scope.of(node.id)
            bound = home.bound[node.id] if home else []
            if len(bound) == 1 and bound[0] is not None:
                yield scope, node, bound[0]


def module_facts(text: str) -> list[tuple]:
    """``fact, local, imported, specifier, kind, line, end_line, start, end, case`` of a source.

    Facts are ``import``, ``export`` (a re-exported name, or all of a module), ``declaration``, ``case`` and ``use``.
    """
    r = Reading(text)
    span = lambda n: (n.lineno, n.end_lineno, *r.places.node(n))
    out = [("import", local, imported, specifier, kind, *span(node), None) for local, imported, specifier, kind, node, _ in r.imports]
    out += [("export", None, None, specifier, "star", None, None, None, None, None) for specifier in r.stars]
    for name, what in r.module.bound.items():
        if len(what) == 1 and what[0] is not None:
            _, imported, specifier, kind, node, _ = what[0]
            out.append(("export", imported, name, specifier, kind, *span(node), None))
        else:
            out += [("export", None, name, None, "named", None, None, None, None, None), ("declaration", name, None, None, None, None, None, None, None, None)]
    done = set()
    for node in ast.walk(r.root):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for case in cases_of(node, r.root):
                if case not in done:
                    done.add(case)
                    out.append(("case", None, None, None, None, *span(node), case))
    out += [("use", entry[0], entry[1], entry[2], entry[3], *span(node), scope.case) for scope, node, entry in r.used()]
    return out


def cases_of(node: ast.AST, root: ast.Module) -> Iterator[str]:
    """Names of the test cases that a declaration at the top of a source is or holds."""
    if node not in root.body:
        return
    if not isinstance(node, ast.ClassDef):
        if node.name.startswith(TEST_CASE):
            yield node.name
    elif _is_suite(node):
        yield from (f"{node.name}.{f.name}" for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.name.startswith(TEST_CASE))


# Over tables


def python_facts(sources: DataFrame) -> DataFrame:
    """:func:`module_facts` with ``path`` for each Python source; a row ``syntax-error`` for one that can't be parsed.

    Null text counts as empty.  One pass without a shuffle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"]):
                try:
                    rows += [(path, *f) for f in module_facts(text or "")]
                except SyntaxError:
                    rows.append((path, "syntax-error", *(None,) * (len(_COLUMNS) - 2)))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("line", "end_line", "start", "end")})

    return sources.where(F.col("path").rlike(r"\.pyi?$")).select("path", "text").mapInPandas(run, _FACTS)


def _folder(path: Column) -> Column:
    return F.when(F.locate("/", path) == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def package_roots(files: DataFrame) -> DataFrame:
    """``folder, root``: where absolute names begin for the sources of a folder: the nearest folder that is no package."""
    folders = files.select(_folder(F.col("path")).alias("folder")).distinct()
    packages = files.where(F.col("path").rlike(r"(^|/)__init__\.pyi?$")).select(_folder(F.col("path")).alias("package")).distinct()
    parts = F.split("folder", "/")
    # Every folder above, nearest first, as many as its path has parts.
    each = folders.select("folder", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.when(k > 0, F.array_join(F.slice(parts, 1, k), "/")).otherwise(F.lit("")))).alias("up", "above"))
    free = each.join(packages, each["above"] == packages["package"], "left_anti")
    return free.groupBy("folder").agg(F.min_by("above", "up").alias("root"))


def resolve_python(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """``path, specifier, target, reason`` of dotted names (``pkg.mod``, ``.mod``, ``..pkg``): a module or a package.

    A relative name counts its dots from the folder of its source, an absolute one begins at the root of the packages
    around its source, or at the top.  What is nowhere among the sources is ``package-or-alias`` if it is absolute.
    """
    every = specifiers.select("path", "specifier").distinct()
    placed = every.withColumn("folder", _folder(F.col("path"))).join(package_roots(files), "folder", "left")
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace("specifier", r"^\.+", ""), r"\.", "/")
    up = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.size("up") - (F.col("dots") - 1)
    joined = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit("/"), b)).otherwise(F.concat(a, b))
    cleared = placed.withColumn("dots", dots).withColumn("rest", rest).withColumn("up", up)
    base = F.when(F.col("dots") > 0, F.when(above >= 0, F.array(joined(F.array_join(F.slice("up", F.lit(1), F.greatest(above, F.lit(0))), "/"), F.col("rest"))))).otherwise(
        F.array_distinct(F.array(joined(F.coalesce("root", F.lit("")), F.col("rest")), F.col("rest")))
    )
    stems = cleared.withColumn("stems", base)
    names = F.transform("stems", lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit(".pyi")), F.when(s == "", F.lit("__init__.py")).otherwise(F.concat(s, F.lit("/__init__.py")))))
    candidates = stems.select("path", "specifier", F.explode(F.flatten(names)).alias("candidate"))
    found = candidates.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "specifier").agg(F.count(F.lit(1)).alias("k"), F.min("candidate").alias("c"))
    j = cleared.select("path", "specifier", "dots").join(found, ["path", "specifier"], "left")
    reason = F.when(F.col("k").isNull(), F.when(F.col("dots") > 0, F.lit("missing")).otherwise(F.lit("package-or-alias"))).when(F.col("k") > 1, F.lit("ambiguous"))
    return j.select("path", "specifier", F.when(F.col("k") == 1, F.col("c")).alias("target"), reason.alias("reason"))


def _below(specifier: Column, name: Column) -> Column:
    """The name of a module inside a package."""
    return F.concat(specifier, F.when(specifier.endswith("."), F.lit("")).otherwise(F.lit(".")), name)


def graph(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``imports, exports, declarations, modules`` for :func:`structure.trace_imports`, from :func:`python_facts`.

    ``from package import name`` means what the package binds under that name, and its module of that name otherwise.
    """
    imports = facts.where("fact = 'import'").select("path", "local", "imported", "specifier", "kind", "line", "end_line")
    exports = facts.where("fact = 'export'").select("path", F.col("imported").alias("exported"), "local", "specifier", "kind")
    own = facts.where("fact = 'declaration'").select("path", F.col("local").alias("name"))
    named = imports.where("kind = 'named'").select("path", "specifier", "imported")
    inner = named.select("path", _below(F.col("specifier"), F.col("imported")).alias("specifier"))
    modules = cut(resolve_python(imports.select("path", "specifier").union(exports.where("specifier IS NOT NULL").select("path", "specifier")).union(inner), files))
    target = modules.where("target IS NOT NULL").select(F.col("path").alias("m_path"), F.col("specifier").alias("m_spec"), F.col("target").alias("m_target"))
    bound = exports.where("exported IS NOT NULL").select(F.col("path").alias("b_path"), F.col("exported").alias("b_name")).distinct()

    def inside(rows: DataFrame, name: str) -> DataFrame:
        """The rows with the module inside a package in place of a name that the package does not bind."""
        below = _below(F.col("specifier"), F.col(name))
        sub = target.select(F.col("m_path").alias("s_path"), F.col("m_spec").alias("s_spec")).distinct()
        x = rows.withColumn("below_", F.when(F.col("kind") == "named", below))
        x = x.join(target, (F.col("path") == F.col("m_path")) & (F.col("specifier") == F.col("m_spec")), "left").join(bound, (F.col("m_target") == F.col("b_path")) & (F.col(name) == F.col("b_name")), "left")
        x = x.join(sub, (F.col("path") == F.col("s_path")) & (F.col("below_") == F.col("s_spec")), "left")
        other = F.col("s_spec").isNotNull() & F.col("b_name").isNull()
        put = {"specifier": F.col("below_"), "kind": F.lit("namespace"), name: F.lit("*")}
        return x.select(*[F.when(other, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in rows.columns])

    return inside(imports, "imported"), inside(exports, "local"), own, modules


def python_traces(facts: DataFrame, files: DataFrame, start: Column | None = None) -> DataFrame:
    """``path, local, status, reason, target, name, hops`` of the imports of Python sources (those that ``start`` takes)."""
    imports, exports, declarations, modules = graph(facts, files)
    first = imports if start is None else imports.where(start)
    return trace_imports(imports.drop("line", "end_line"), exports, declarations, files, modules=modules, start=first.drop("line", "end_line"))


def related_tests(facts: DataFrame, traces: DataFrame, sources: DataFrame, target: str) -> DataFrame:
    """``test, target, association, reason, case, line, uses`` of the test sources of one source.

    ``direct``: a test source imports the target; ``indirect``: an import ends there over others; ``weak``: neither,
    but its name, or its text, says the name of the target.  A row for each case that uses what was imported, with the
    lines of the uses; one without a case if there is none.  Nothing is run.
    """
    stem = target.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if stem == "__init__":
        stem = target.rsplit("/", 2)[-2] if "/" in target else ""
    cases = facts.where("fact = 'case'").select("path").distinct()
    names = sources.select("path").where(F.col("path").rlike(TEST_SOURCE) & F.col("path").rlike(r"\.pyi?$"))
    tests = names.union(cases).distinct().where(F.col("path") != target)
    near = traces.where(F.col("target") == target).join(tests, "path", "left_semi")
    how = near.groupBy("path", "local").agg(F.min("hops").alias("hops"))
    per = how.groupBy("path").agg(F.when(F.min("hops") == 1, F.lit("direct")).otherwise(F.lit("indirect")).alias("association"))
    uses = facts.where("fact = 'use' AND case IS NOT NULL").join(how.select("path", "local"), ["path", "local"], "left_semi")
    by_case = uses.groupBy("path", "case").agg(F.min("line").alias("line"), F.sort_array(F.collect_list("line")).alias("uses"))
    reason = F.when(F.col("association") == "direct", F.lit("imports the target")).otherwise(F.lit("an import ends at the target"))
    strong = per.join(by_case, "path", "left").select(F.col("path").alias("test"), "association", reason.alias("reason"), "case", "line", F.coalesce("uses", F.array().cast("array<bigint>")).alias("uses"))
    bare = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), r"^test_|_test$", "")
    weak = sources.select("path", "text").join(tests, "path", "left_semi").join(per.select("path"), "path", "left_anti")
    weak = weak.where((bare == stem) | (F.lit(bool(stem)) & F.col("text").contains(stem)))
    because = F.when(bare == stem, F.lit("only the names are alike")).otherwise(F.lit("only the text says the name"))
    weak = weak.select(F.col("path").alias("test"), F.lit("weak").alias("association"), because.alias("reason"), F.lit(None).cast("string").alias("case"), F.lit(None).cast("long").alias("line"), F.array().cast("array<bigint>").alias("uses"))
    return strong.union(weak).withColumn("target", F.lit(target)).select("test", "target", "association", "reason", "case", "line", "uses")
