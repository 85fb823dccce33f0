"""Syntax trees as tables.

A node has its number in the order in which nodes begin (a parent before its children) and the largest number among
its descendants, so being inside another node is a comparison of numbers: ``a.node < d.node <= a.last``.  Questions
about ancestors and scopes are sorted sweeps over the numbers of a source, never joins of all nodes with all nodes.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .ranges import smallest_enclosing
from .syntax import Places, SyntaxProvider, parsed

#: Nodes of one source at most; a larger one has the status ``limit`` and no nodes.
NODES = 100_000
LOOPS = ("For", "AsyncFor", "While")
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef", "Lambda")
CLOSED = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
_COLUMNS = ["path", "status", "node", "last", "parent", "depth", "kind", "field", "name", "start", "end"]
_SCHEMA = "path string, status string, node long, last long, parent long, depth int, kind string, field string, name string, start long, end long"


class TooManyNodes(Exception):
    """A source has more nodes than are kept."""


def children(node: ast.AST) -> Iterator[tuple[str, ast.AST]]:
    """Field and node of the children; those of helpers without a place of their own count as children themselves."""
    for field, value in ast.iter_fields(node):
        for child in value if isinstance(value, list) else [value]:
            if not isinstance(child, ast.AST) or isinstance(child, CLOSED):
                continue
            if hasattr(child, "lineno") or isinstance(child, ast.comprehension):
                yield field, child
            else:
                yield from children(child)


def place(node: ast.AST, places: Places) -> tuple[int, int]:
    if isinstance(node, ast.comprehension):
        return places.node(node.target)[0], places.node((node.ifs or [node.iter])[-1])[1]
    return places.node(node)


def said(node: ast.AST) -> str | None:
    """The name that a node says: what it declares, reads, takes from an object, or calls."""
    for field in ("name", "id", "attr", "arg", "module"):
        value = getattr(node, field, None)
        if isinstance(value, str):
            return value
    return said(node.func) if isinstance(node, ast.Call) else None


def python_nodes(text: str, most: int = NODES) -> list[tuple]:
    """``node, last, parent, depth, kind, field, name, start, end`` of the tree of a Python source."""
    places, root = Places(text), parsed(text)
    out: list[list] = []
    todo: list[tuple] = [(root, None, 0, None)]
    while todo:
        node, parent, depth, field = todo.pop()
        if field is False:  # all below this one is done
            out[node][1] = len(out) - 1
            continue
        if len(out) >= most:
            raise TooManyNodes
        number = len(out)
        start, end = (0, len(text)) if node is root else place(node, places)
        out.append([number, number, parent, depth, type(node).__name__, field, said(node), start, end])
        todo.append((number, None, 0, False))
        below = sorted(children(node), key=lambda c: place(c[1], places))
        todo += [(child, number, depth + 1, f) for f, child in reversed(below)]
    return [tuple(x) for x in out]


def _rows(parts: Iterator[pd.DataFrame], provider: SyntaxProvider, most: int) -> Iterator[pd.DataFrame]:
    none = (None,) * (len(_COLUMNS) - 2)
    for part in parts:
        rows = []
        for path, text in zip(part["path"], part["text"]):
            try:
                rows += [(path, "ok", *n) for n in provider.nodes(text or "", most)]
            except SyntaxError:
                rows.append((path, "syntax-error", *none))
            except TooManyNodes:
                rows.append((path, "limit", *none))
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("node", "last", "parent", "depth", "start", "end")})


def node_table(sources: DataFrame, provider: SyntaxProvider, most: int = NODES) -> DataFrame:
    """``path, status, node, last, parent, depth, kind, field, name, start, end`` of the sources in languages of the
    provider; one row without a node for a source that can't be parsed (``syntax-error``) or is too large (``limit``).

    Null text counts as empty and is a tree of one node.  One pass without a shuffle.
    """
    spoken = sources.where(P.language(F.col("path")).isin(*sorted(provider.languages))).select("path", "text")
    return spoken.mapInPandas(partial(_rows, provider=provider, most=most), _SCHEMA)


def inside(nodes: DataFrame, inner: Column, outer: Column) -> DataFrame:
    """The nodes of ``inner`` that lie below a node of ``outer``: one sweep over the nodes of a source."""
    w = Window.partitionBy("path").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    wanted = nodes.where(inner | outer).withColumn("in_", inner).withColumn("reach_", F.max(F.when(outer, F.col("last"))).over(w))
    return wanted.where(F.col("in_") & (F.col("reach_") >= F.col("node"))).drop("in_", "reach_")


def nearest(nodes: DataFrame, inner: Column, outer: Column) -> DataFrame:
    """``path, node, around``: for each node of ``inner`` the innermost node of ``outer`` around it, if there is one."""
    points = nodes.where(inner).select("path", F.col("node").alias("at"))
    around = nodes.where(outer & (F.col("last") > F.col("node"))).select("path", F.col("node").cast("string").alias("name"), (F.col("node") + 1).alias("start"), (F.col("last") + 1).alias("end"))
    return smallest_enclosing(points, around).select("path", F.col("at").alias("node"), F.col("name").cast("long").alias("around"))


def calls_in_loops(nodes: DataFrame) -> DataFrame:
    """``path, node, name, start, end`` of the calls that are made again and again: below a loop."""
    return inside(nodes, F.col("kind") == "Call", F.col("kind").isin(*LOOPS)).select("path", "node", "name", "start", "end")


def enclosing_functions(nodes: DataFrame) -> DataFrame:
    """``path, node, name, function``: each call with the innermost function that it stands in."""
    found = nearest(nodes, F.col("kind") == "Call", F.col("kind").isin(*FUNCTIONS))
    calls = nodes.where("kind = 'Call'").select("path", "node", "name")
    names = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("node").alias("around"), F.coalesce("name", F.lit("lambda")).alias("function"))
    return calls.join(found, ["path", "node"]).join(names, ["path", "around"]).select("path", "node", "name", "function")
