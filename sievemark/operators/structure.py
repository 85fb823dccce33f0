"""Code structure: outlines of Python sources, static import traces and test candidates over fact tables.

JavaScript, TypeScript and Go need a syntax provider, which gives the fact tables; without one they are unavailable.
"""

from __future__ import annotations

import tokenize
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError
from ..session import cut
from .syntax import SyntaxProvider

SIGNATURE_CHARACTERS = 600
MAX_HOPS = 8
# Suffixes tried for a specifier without an extension, and sources of compiled extensions.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
COMPILED = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def required(provider: SyntaxProvider | None, what: str) -> SyntaxProvider:
    if provider is None:
        raise CapabilityError(f"{what} needs a syntax provider; none is configured", recovery="choose-capability")
    return provider


# Python outline


@dataclass
class Statement:
    """A statement, or the head of one: its first line, how deep it is indented in blocks, and its words."""

    line: int
    level: int
    words: list[str]


_SILENT = {tokenize.NL, tokenize.COMMENT, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.TYPE_COMMENT}


_TOP = ("def ", "class ", "async ", "@")


def _read(lines: list[str], first: int, end: int) -> tuple[list[Statement], bool]:
    """The statements of some lines from the tokens of the language, and whether these went through to the end."""
    out, level, now = [], 0, None
    rest = iter(lines[first:end])
    try:
        for t in tokenize.generate_tokens(lambda: (line + "\n" if (line := next(rest, None)) is not None else "")):
            if t.type in (tokenize.INDENT, tokenize.DEDENT):
                level += 1 if t.type == tokenize.INDENT else -1
            elif t.type == tokenize.NEWLINE:
                now = None
            elif t.type not in _SILENT:
                if now is None:
                    now = Statement(first + t.start[0], level, [])
                    out.append(now)
                now.words.append(t.string)
    except (tokenize.TokenError, SyntaxError):
        return out, False
    return out, True


def statements(lines: list[str]) -> list[Statement]:
    """The statements of Python lines.

    Where the tokens break off (an open string or bracket, an indentation that fits nothing) each part up to the next
    declaration at the start of a line is read for itself, as far as it goes.
    """
    out, whole = _read(lines, 0, len(lines))
    if whole:
        return out
    tops = [0, *(i for i, line in enumerate(lines) if i and line.startswith(_TOP)), len(lines)]
    return [s for a, b in zip(tops, tops[1:]) for s in _read(lines, a, b)[0]]


def _declared(words: list[str]) -> tuple[str, str] | None:
    at = 1 if words[0] == "async" else 0
    if words[at : at + 1] in (["def"], ["class"]) and words[at + 1 : at + 2] and words[at + 1].isidentifier() and words[at + 2 : at + 3] in (["("], [":"], ["["]):
        return words[at], words[at + 1]
    return None


def _has_inline_body(words: list[str]) -> bool:
    """Whether words follow the colon that ends a head."""
    depth = 0
    for i, word in enumerate(words):
        depth += (word in ("(", "[", "{")) - (word in (")", "]", "}"))
        if word == ":" and depth == 0:
            return i + 1 < len(words)
    return False


def python_outline(text: str) -> list[tuple]:
    """(name, kind, start_line, end_line, scope, has_body, signature) of functions, methods and classes.

    A declaration ends on the line before the next statement that is indented no deeper; a function right inside
    a class is a method.
    """
    lines = text.split("\n")
    found, around = [], []
    above: Statement | None = None
    for s in statements(lines):
        if above is not None and found and found[-1]["statement"] is above and s.level > above.level:
            found[-1]["body"] = True
        while around and around[-1]["statement"].level >= s.level:
            around.pop()["end"] = s.line - 1
        what = _declared(s.words)
        if what:
            entry = {"statement": s, "kind": what[0], "name": what[1], "scope": [e["name"] for e in around], "inside": around[-1]["kind"] if around else "", "end": len(lines), "body": _has_inline_body(s.words)}
            found.append(entry)
            around.append(entry)
        above = s
    kind = lambda e: "class" if e["kind"] == "class" else "method" if e["inside"] == "class" else "function"
    return [(e["name"], kind(e), e["statement"].line, e["end"], e["scope"], e["body"], lines[e["statement"].line - 1][:SIGNATURE_CHARACTERS].rstrip()) for e in found]


def outline(sources: DataFrame) -> DataFrame:
    """``path, name, kind, start_line, end_line, scope, has_body, signature`` of Python sources."""
    columns = ["path", "name", "kind", "start_line", "end_line", "scope", "has_body", "signature"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *s) for p, t in zip(part["path"], part["text"]) for s in python_outline(t or "")]
            yield pd.DataFrame(rows, columns=columns)

    return sources.select("path", "text").mapInPandas(run, "path string, name string, kind string, start_line long, end_line long, scope array<string>, has_body boolean, signature string")


# Imports over fact tables


def module_candidates(imports: DataFrame) -> DataFrame:
    """``path, specifier, candidate``: the paths that a relative specifier may name.

    Other specifiers (packages, aliases) have none.
    """
    base = F.when(F.locate("/", "path") == 0, F.lit("")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    joined = F.concat_ws("/", F.when(base == "", None).otherwise(base), F.col("specifier"))
    none = F.array().cast("array<string>")

    def step(acc, part):
        up = F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    normal = F.array_join(F.aggregate(F.split(joined, "/"), none, step), "/")
    rows = imports.where(F.col("specifier").rlike(r"^\.{1,2}/") & ~F.col("specifier").rlike(r"[\\\x00?#]")).select("path", "specifier").distinct().withColumn("p", normal)
    rows = rows.where(~F.col("p").rlike(r"^\.\.(/|$)"))
    ext = F.regexp_extract(F.substring_index("p", "/", -1), r".(\.[^.]*)$", 1)
    bare = F.concat(F.array("p"), F.array(*[F.concat("p", F.lit(s)) for s in SUFFIXES]), F.array(*[F.concat("p", F.lit("/index" + s)) for s in SUFFIXES]))
    more = F.array("p")
    for e, sources in COMPILED.items():
        more = F.when(ext == e, F.array(F.col("p"), *[F.concat(F.expr(f"left(p, length(p) - {len(e)})"), F.lit(s)) for s in sources])).otherwise(more)
    return rows.select("path", "specifier", F.explode(F.array_distinct(F.when(ext == "", bare).otherwise(more))).alias("candidate"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``path, specifier, target, reason`` of each specifier: one existing candidate, or why there is none."""
    found = module_candidates(imports).join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "specifier").agg(F.count(F.lit(1)).alias("k"), F.min("candidate").alias("c"))
    every = imports.select("path", "specifier").distinct()
    j = every.join(found, ["path", "specifier"], "left")
    relative = F.col("specifier").rlike(r"^\.{1,2}/")
    reason = (
        F.when(F.col("specifier").isNull(), F.lit("not-a-literal")).when(~relative, F.lit("package-or-alias")).when(F.col("specifier").rlike(r"[\\\x00?#]"), F.lit("unsupported"))
        .when(F.col("k").isNull(), F.lit("missing")).when(F.col("k") > 1, F.lit("ambiguous"))
    )
    return j.select("path", "specifier", F.when(F.col("k") == 1, F.col("c")).alias("target"), reason.alias("reason"))


def trace_imports(imports: DataFrame, exports: DataFrame, declarations: DataFrame, files: DataFrame, hops: int = MAX_HOPS, modules: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """``path, local, status, reason, target, name, hops`` for each import binding.

    imports: ``path, local, imported, specifier, kind`` (named, default, namespace, side-effect); exports: ``path,
    exported, local, specifier, kind`` (named, default, namespace, star); declarations: ``path, name``.  A name is
    followed through re-exports and local imports to its declaration, at most ``hops`` modules far; a step is a join
    of what is still open with the fact tables.  ``modules`` says where specifiers lead (:func:`resolve_modules` if it is not
    given), and ``start`` which of the imports are traced (all of them).
    """
    if modules is None:
        modules = resolve_modules(imports.select("path", "specifier").unionByName(exports.where("specifier IS NOT NULL").select("path", "specifier")), files)
    m = modules.select(F.col("path").alias("m_path"), F.col("specifier").alias("m_spec"), F.col("target").alias("m_target"), F.col("reason").alias("m_reason"))
    m = cut(m)
    count = lambda d, *k: d.groupBy(*k).agg(F.count(F.lit(1)).alias("n_"), F.first("local").alias("x_local"), F.first("specifier").alias("x_spec"), F.first("kind").alias("x_kind"))
    ex = count(exports.where("kind <> 'star'"), "path", "exported").select(F.col("path").alias("e_path"), F.col("exported").alias("e_name"), F.col("n_").alias("e_n"), F.col("x_local").alias("e_local"), F.col("x_spec").alias("e_spec"), F.col("x_kind").alias("e_kind"))
    stars = exports.where("kind = 'star'").select(F.col("path").alias("s_path")).distinct().withColumn("star", F.lit(True))
    own = declarations.groupBy("path", "name").agg(F.count(F.lit(1)).alias("d_n")).select(F.col("path").alias("d_path"), F.col("name").alias("d_name"), "d_n")
    im = imports.where("local IS NOT NULL").groupBy("path", "local").agg(F.count(F.lit(1)).alias("i_n"), F.first("imported").alias("i_imported"), F.first("specifier").alias("i_spec"), F.first("kind").alias("i_kind")).select(F.col("path").alias("i_path"), F.col("local").alias("i_local"), "i_n", "i_imported", "i_spec", "i_kind")

    # An open row stands at module ``at`` and follows ``spec`` for ``want``; ``seen`` are the exports it went through.
    state = (imports if start is None else start).select("path", "local", F.col("path").alias("at"), F.col("specifier").alias("spec"), F.col("imported").alias("want"), F.col("kind").alias("how"), F.array().cast("array<string>").alias("seen"))
    done = []
    for hop in range(1, hops + 1):
        j = state.join(m, (F.col("at") == F.col("m_path")) & F.col("spec").eqNullSafe(F.col("m_spec")), "left")
        # In the module an export of that name, then its local binding: a declaration there or an import.
        j = j.join(ex, (F.col("m_target") == F.col("e_path")) & (F.col("want") == F.col("e_name")), "left").join(stars, F.col("m_target") == F.col("s_path"), "left")
        j = j.join(own, (F.col("m_target") == F.col("d_path")) & (F.coalesce("e_local", "e_name") == F.col("d_name")), "left").join(im, (F.col("m_target") == F.col("i_path")) & (F.col("e_local") == F.col("i_local")), "left")
        key = F.concat_ws("\0", "m_target", "want")
        whole, again = F.col("how").isin("namespace", "side-effect"), F.col("e_spec").isNotNull()
        both = F.coalesce("i_n", F.lit(0)) + F.coalesce("d_n", F.lit(0))
        reason = (
            F.when(F.col("m_target").isNull(), F.coalesce("m_reason", F.lit("missing"))).when(whole, F.lit(None))
            .when(F.array_contains("seen", key), F.lit("circular-re-export")).when(F.col("e_n").isNull() & F.col("star"), F.lit("export-star-unsupported"))
            .when(F.col("e_n").isNull(), F.lit("export-not-found")).when(F.col("e_n") > 1, F.lit("ambiguous-export"))
            .when(~again & (both > 1), F.lit("ambiguous-local")).when(~again & (both == 0), F.lit("local-binding-unresolved"))
        )
        j = j.withColumn("reason", reason)
        status = F.when(F.col("reason").isNotNull(), F.lit("unresolved")).when(whole, F.lit("module")).when(~again & F.col("d_n").isNotNull(), F.lit("resolved"))
        # A step is computed once: what it settles and what stays open are both read from it.
        j = cut(j.select("path", "local", "want", "how", "m_target", "e_local", "e_spec", "e_kind", "i_spec", "i_imported", "i_kind", "reason", status.alias("status"), F.concat("seen", F.array(key)).alias("seen")))
        name = F.when(F.col("status") == "resolved", F.coalesce("e_local", "want")).otherwise(F.col("want"))
        target = F.when(F.col("status") != "unresolved", F.col("m_target"))
        done.append(j.where("status IS NOT NULL").select("path", "local", "status", "reason", target.alias("target"), name.alias("name"), F.lit(hop).alias("hops")))
        again = F.col("e_spec").isNotNull()
        pick = lambda a, b: F.when(again, F.col(a)).otherwise(F.col(b))
        state = j.where("status IS NULL").select("path", "local", F.col("m_target").alias("at"), pick("e_spec", "i_spec").alias("spec"), pick("e_local", "i_imported").alias("want"), pick("e_kind", "i_kind").alias("how"), "seen")
        if state.isEmpty():
            break
    done.append(state.select("path", "local", F.lit("unresolved").alias("status"), F.lit("hop-budget").alias("reason"), F.lit(None).cast("string").alias("target"), F.col("want").alias("name"), F.lit(hop).alias("hops")))
    return reduce(DataFrame.unionByName, done)


def related_tests(traces: DataFrame, changed: DataFrame, test_pattern: str = r"(^|/)(__tests__|tests?)/|[._-](test|spec)\.[^/]+$") -> DataFrame:
    """``test, target, association`` of sources that import a changed one: direct in one hop, otherwise indirect;
    names that look like tests come first."""
    t = traces.where("target IS NOT NULL").join(changed.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    how = F.when(F.min("hops") == 1, F.lit("direct")).otherwise(F.lit("indirect"))
    found = t.groupBy(F.col("path").alias("test"), "target").agg(how.alias("association"))
    return found.withColumn("test_like", F.col("test").rlike(test_pattern)).orderBy(F.desc("test_like"), "test", "target")
