"""Syntax facts of sources: functions, roles and structural patterns, from a provider that runs on the workers.

``PythonSyntax`` is the provider that comes with the engine; it uses the parser and the tokens of Python itself.  Other
languages need a provider of their own.  Offsets count code points of the text.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvidenceError
from ..functions import paths as P

#: The names of roles.  Fixed values.
ROLES = ("declaration", "call", "import", "export", "comment", "string", "jsx-text", "code", "unknown")
PATTERN_BYTES = 4096


class SyntaxProvider(Protocol):
    """Facts of source code; ``languages`` are those it can parse.  A source that it can't parse raises SyntaxError."""

    languages: frozenset[str]
    #: What it gives for each of them.
    offers: frozenset[str]

    def functions(self, text: str) -> list[tuple[str, int, int]]: ...

    def roles(self, text: str) -> list[tuple[str, int, int]]: ...

    def pattern(self, pattern: str) -> Callable[[str], list[tuple[int, int]]]: ...

    def nodes(self, text: str, most: int) -> list[tuple]: ...


class Places:
    """Offsets in a text from lines and columns; the parser's columns count bytes, those of tokens code points."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def of_bytes(self, line: int, column: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode()))

    def of_points(self, place: tuple[int, int]) -> int:
        return self.starts[place[0] - 1] + place[1]

    def node(self, n: ast.AST) -> tuple[int, int]:
        return self.of_bytes(n.lineno, n.col_offset), self.of_bytes(n.end_lineno, n.end_col_offset)


def parsed(text: str) -> ast.Module:
    try:
        return ast.parse(text.replace("\r", " "))  # as long, and lines end at line feeds only
    except (ValueError, RecursionError, MemoryError) as e:
        raise SyntaxError(str(e)) from e


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DECLARED = (*_FUNCTIONS, ast.ClassDef)
_IMPORTS = (ast.Import, ast.ImportFrom)


class PythonSyntax:
    """Python by its own parser."""

    languages = frozenset({"python"})
    offers = frozenset({"roles", "structure", "imports", "tests"})

    def functions(self, text: str) -> list[tuple[str, int, int]]:
        """(name, start, end) of functions and methods, without their decorators."""
        places = Places(text)
        return sorted((n.name, *places.node(n)) for n in ast.walk(parsed(text)) if isinstance(n, _FUNCTIONS))

    def roles(self, text: str) -> list[tuple[str, int, int]]:
        """(role, start, end): comments, strings, imports, names that are declared, names that are called, and code
        for all that is neither comment nor string."""
        places, out = Places(text), []
        for n in ast.walk(parsed(text)):
            if isinstance(n, _IMPORTS):
                out.append(("import", *places.node(n)))
            elif isinstance(n, ast.Call):
                out.append(("call", *places.node(n.func)))
            elif isinstance(n, _DECLARED):
                start, end = places.node(n)
                name = re.compile(rf"\b{re.escape(n.name)}\b").search(text, start, end)
                if name:
                    out.append(("declaration", *name.span()))
        silent, open_ = [], []
        try:
            for t in tokenize.generate_tokens(io.StringIO(text.replace("\r", " ")).readline):
                if t.type == tokenize.FSTRING_START:
                    open_.append(t.start)
                elif t.type == tokenize.FSTRING_END:
                    began = open_.pop()
                    if not open_:
                        silent.append(("string", places.of_points(began), places.of_points(t.end)))
                elif t.type in (tokenize.COMMENT, tokenize.STRING) and not open_:
                    silent.append(("comment" if t.type == tokenize.COMMENT else "string", places.of_points(t.start), places.of_points(t.end)))
        except tokenize.TokenError as e:
            raise SyntaxError(str(e)) from e
        at = 0
        for _, start, end in silent:
            if start > at:
                out.append(("code", at, start))
            at = end
        if at < len(text):
            out.append(("code", at, len(text)))
        return sorted({*out, *silent}, key=lambda r: (r[1], r[2], r[0]))

    def nodes(self, text: str, most: int) -> list[tuple]:
        """The tree as rows; see :func:`nodes.python_nodes`."""
        from .nodes import python_nodes

        return python_nodes(text, most)

    def pattern(self, pattern: str) -> Callable[[str], list[tuple[int, int]]]:
        return partial(_structural, wanted=_pattern_nodes(pattern))


# Structural patterns: ``$NAME`` stands for one expression, the same wherever it stands again; ``$$$NAME`` for any
# number of arguments, elements or statements.

_ONE, _MANY = "one_of_pattern_", "many_of_pattern_"


def _pattern_nodes(pattern: str) -> list[ast.AST]:
    """The nodes of a pattern: one expression, or statements."""
    if not pattern.strip() or len(pattern.encode()) > PATTERN_BYTES:
        raise EvidenceError("a structural pattern has 1 to 4096 bytes", "E_PATTERN")
    plain = re.sub(r"\$\$\$([A-Z_][A-Z0-9_]*)?", lambda m: _MANY + (m[1] or ""), pattern)
    plain = re.sub(r"\$([A-Z_][A-Z0-9_]*)", lambda m: _ONE + m[1], plain)
    try:
        body = ast.parse(plain).body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise EvidenceError(f"the pattern is no Python: {e}", "E_PATTERN") from e
    if not body:
        raise EvidenceError("the pattern has no code", "E_PATTERN")
    return [body[0].value] if len(body) == 1 and isinstance(body[0], ast.Expr) else body


def _variable(node: object) -> str | None:
    """The name of the metavariable that a node of a pattern is."""
    if isinstance(node, ast.Expr):
        node = node.value
    if isinstance(node, ast.arg) and node.annotation is None:
        return node.arg if node.arg.startswith((_ONE, _MANY)) else None
    return node.id if isinstance(node, ast.Name) and node.id.startswith((_ONE, _MANY)) else None


def _matches(wanted: object, node: object, bound: dict[str, str]) -> dict[str, str] | None:
    """The bindings under which a node has the form of a pattern's node."""
    name = _variable(wanted)
    if name and name.startswith(_ONE) and isinstance(node, ast.AST):
        said = ast.unparse(node)
        return bound | {name: said} if bound.get(name, said) == said else None
    if isinstance(wanted, list):
        return _match_all(wanted, node, bound) if isinstance(node, list) else None
    if isinstance(wanted, ast.AST):
        if type(wanted) is not type(node):
            return None
        for field in wanted._fields:
            if field in ("ctx", "type_comment", "kind"):
                continue
            a, b = getattr(wanted, field, None), getattr(node, field, None)
            if isinstance(a, str) and a.startswith(_ONE) and isinstance(b, str):
                # A name that is declared or taken from an object.
                if bound.get(a, b) != b:
                    return None
                bound = bound | {a: b}
                continue
            got = _matches(a, b, bound)
            if got is None:
                return None
            bound = got
        return bound
    return bound if wanted == node and type(wanted) is type(node) else None


def _match_all(wanted: list, nodes: list, bound: dict[str, str]) -> dict[str, str] | None:
    """A list of a pattern against a list; ``$$$`` takes as few as it can."""
    if not wanted:
        return bound if not nodes else None
    name = _variable(wanted[0])
    if name and name.startswith(_MANY):
        for k in range(len(nodes) + 1):
            said = "\n".join(map(ast.unparse, nodes[:k]))
            if name != _MANY and bound.get(name, said) != said:
                continue
            got = _match_all(wanted[1:], nodes[k:], bound if name == _MANY else bound | {name: said})
            if got is not None:
                return got
        return None
    if not nodes:
        return None
    got = _matches(wanted[0], nodes[0], bound)
    return None if got is None else _match_all(wanted[1:], nodes[1:], got)


def _structural(text: str, wanted: list[ast.AST]) -> list[tuple[int, int]]:
    places, out = Places(text), set()
    for n in ast.walk(parsed(text)):
        if len(wanted) == 1:
            if isinstance(n, (ast.expr, ast.stmt)) and _matches(wanted[0], n, {}) is not None:
                out.add(places.node(n))
            continue
        for field in ("body", "orelse", "finalbody"):
            block = getattr(n, field, None)
            if isinstance(block, list):
                for i in range(len(block) - len(wanted) + 1):
                    if _match_all(wanted, block[i : i + len(wanted)], {}) is not None:
                        out.add((places.node(block[i])[0], places.node(block[i + len(wanted) - 1])[1]))
    return sorted(out)


# Over tables


def _facts(parts: Iterator[pd.DataFrame], what: Callable[[str], list[tuple]], named: bool) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, text in zip(part["path"], part["text"]):
            try:
                rows += [(path, "ok", *(f if named else (None, *f))) for f in what(text or "")]
            except SyntaxError:
                rows.append((path, "syntax-error", None, None, None))
        yield pd.DataFrame(rows, columns=["path", "status", "name", "start", "end"]).astype({"start": "Int64", "end": "Int64"})


def facts(sources: DataFrame, provider: SyntaxProvider, what: str, pattern: str | None = None) -> DataFrame:
    """``path, status, name, start, end``: the ``functions``, ``roles`` or ``structure`` of the sources in languages of
    the provider; one row with status ``syntax-error`` for a source that can't be parsed.

    One pass without a shuffle.  Null text counts as empty.
    """
    call = provider.pattern(pattern) if what == "structure" else getattr(provider, what)
    spoken = sources.where(P.language(F.col("path")).isin(*sorted(provider.languages))).select("path", "text")
    return spoken.mapInPandas(partial(_facts, what=call, named=what != "structure"), "path string, status string, name string, start long, end long")


def _holding(text: str, provider: SyntaxProvider, terms: list[str]) -> list[tuple[str, int, int]]:
    return [(n, a, b) for n, a, b in provider.functions(text) if all(t in text[a:b] for t in terms)]


def all_of_in_functions(sources: DataFrame, provider: SyntaxProvider, terms: list[str]) -> DataFrame:
    """:func:`facts` of the functions that hold all terms, case-sensitive, wherever they are nested.

    Only sources with all terms are parsed.
    """
    near = sources.where(P.language(F.col("path")).isin(*sorted(provider.languages)))
    for t in terms:
        near = near.where(F.col("text").contains(t))
    what = partial(_holding, provider=provider, terms=terms)
    return near.select("path", "text").mapInPandas(partial(_facts, what=what, named=True), "path string, status string, name string, start long, end long")
