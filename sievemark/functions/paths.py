"""Column expressions over relative POSIX paths: languages, breakdown keys, ranking scores, globs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..errors import EvidenceError

# Extensions of the languages that have structural operators.
EXTENSIONS = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".mts", ".cts"),
    "tsx": (".tsx",),
    "go": (".go",),
    "python": (".py", ".pyi"),
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The folder of a path, ``.`` at the top."""
    return F.when(F.locate("/", path) == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def type_key(path: Column) -> Column:
    e = extension(path)
    return F.when(F.length(e) < 2, F.lit("[no extension]")).otherwise(e)


def language(path: Column) -> Column:
    out, e = None, extension(path)
    for name, known in EXTENSIONS.items():
        out = F.when(e.isin(*known), F.lit(name)) if out is None else out.when(e.isin(*known), F.lit(name))
    return out


@F.pandas_udf(IntegerType())
def _fuzzy(path: pd.Series, query: pd.Series) -> pd.Series:
    """40 * characters / span of the query's characters found in order, by graphemes; null if one is missing."""
    import regex

    split = regex.compile(r"\X").findall

    def score(text: str, q: str):
        chars, at, first, last = split(text), 0, None, 0
        wanted = split(q)
        for c in wanted:
            try:
                i = chars.index(c, at)
            except ValueError:
                return None
            first, last, at = (i if first is None else first), i, i + 1
        return int(40 * len(wanted) / max(1, last - first + 1) + 0.5) if wanted else None

    return pd.Series([score(p, q) for p, q in zip(path, query)], dtype="Int32")


def file_score(path: Column, query: str) -> Column:
    """How well a path answers a file query; null for paths that don't.

    100 for the whole file name, 95 for its stem, 85 and 70 for a part of the name or path, 60 when each of several
    words is in the path, at most 40 for the characters of one word in order.
    """
    if "*" in query or "?" in query:
        raise EvidenceError("a file query is text, not a glob", "E_FILE_QUERY")
    if len(query) > 256 or "\n" in query:
        raise EvidenceError("a file query is one line of at most 256 characters", "E_FILE_QUERY")
    if not query:
        return F.lit(0)
    p, q = F.lower(path), query.lower()
    name = basename(p)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    words = q.split()
    if len(words) > 1:
        rest = F.when(_all([p.contains(w) for w in words]), F.lit(60))
    elif words:
        rest = _fuzzy(p, F.lit(words[0]))
    else:
        rest = F.lit(None).cast("int")
    near = F.when(name == q, 100).when(stem == q, 95).when(name.contains(q), 85).when(p.contains(q), 70)
    return near.otherwise(rest) if len(words) > 1 or not words else F.coalesce(near, rest)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def glob_regex(glob: str) -> str:
    """An anchored regular expression of an ignore-file style glob: without a slash it matches at any depth."""
    g = glob[1:] if glob.startswith("!") else glob
    anywhere = "/" not in g.rstrip("/")
    g = g.lstrip("/")
    out, i = "", 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            body = g[i + 1 : j].replace("\\", r"\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        elif c == "{" and "}" in g[i:]:
            j = g.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in g[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    tail = ".*" if g.endswith("/") else "(?:/.*)?"
    return "^" + ("(?:.*/)?" if anywhere else "") + out + tail + "$"


def in_scope(path: Column, glob: list[str] | None = None, exclude: list[str] | None = None, hidden: bool = True) -> Column:
    """Include globs, then excludes, then everything below ``.git``: later rules win over earlier ones."""
    ok = F.lit(True)
    if glob:
        positive = [g for g in glob if not g.startswith("!")]
        state = F.lit(not positive)
        for g in glob:
            state = F.when(path.rlike(glob_regex(g)), F.lit(not g.startswith("!"))).otherwise(state)
        ok = ok & state
    for g in exclude or []:
        ok = ok & ~path.rlike(glob_regex(g))
    if not hidden:
        ok = ok & ~path.rlike(r"(^|/)\.[^/]")
    return ok & ~path.rlike(r"(^|/)\.git(/|$)")
