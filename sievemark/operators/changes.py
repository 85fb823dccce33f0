"""Differences between two versions of sources: change sets, renames, changed lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_array
from ..session import cut


def change_set(base: DataFrame, target: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """``path, old_path, change`` between two trees (``path, text``); renames as ``old_path, new_path``."""
    a, b = base.select("path", F.col("text").alias("a")), target.select("path", F.col("text").alias("b"))
    change = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("deleted")).otherwise(F.lit("modified"))
    out = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))
    if renames is None:
        return out.select("path", F.lit(None).cast("string").alias("old_path"), "change")
    r = renames.select("old_path", "new_path")
    rest = out.join(r.select(F.col("old_path").alias("path")), "path", "left_anti").join(r.select(F.col("new_path").alias("path")), "path", "left_anti")
    return rest.select("path", F.lit(None).cast("string").alias("old_path"), "change").union(r.select("new_path", "old_path", F.lit("renamed")))


def _line_counts(sources: DataFrame) -> DataFrame:
    """``path, size, line, n, bytes``; a line is the digest of its text with its line feed, so that long lines travel short."""
    pieces = F.posexplode(line_array(F.col("text")))
    lines = sources.select("path", F.octet_length("text").cast("long").alias("size"), F.size(line_array(F.col("text"))).alias("k"), F.col("text").endswith("\n").alias("closed"), pieces.alias("i", "line"))
    whole = F.when((F.col("i") < F.col("k") - 1) | F.col("closed"), F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    return lines.select("path", "size", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("line"), F.octet_length(whole).cast("long").alias("bytes")).groupBy("path", "size", "line", "bytes").agg(F.count(F.lit(1)).alias("n"))


def _rarest(lines: DataFrame, often: DataFrame, least: int) -> DataFrame:
    """The rarest lines of each source, down to where the bytes that are left are too few for a pair."""
    w = Window.partitionBy("path").orderBy("often", "line").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("size") - F.coalesce(F.sum(F.col("n") * F.col("bytes")).over(w), F.lit(0))
    return lines.join(often, "line").withColumn("left", left).where(100 * F.col("left") >= least * F.col("size")).select("path", "size", "line")


def content_classes(sources: DataFrame) -> DataFrame:
    """``path, class_path, members, version`` of sources: those with equal texts are a class, named by its smallest path.

    Only paths and digests move.  A class with most of the sources is counted before the shuffle, and its rows are
    joined with one row, which the rule for skewed joins may split.
    """
    hashed = sources.select("path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("version"))
    first = hashed.groupBy("version").agg(F.min("path").alias("class_path"), F.count(F.lit(1)).alias("members"))
    return hashed.join(first, "version").select("path", "class_path", "members", "version")


def similarity(deleted: DataFrame, added: DataFrame, least: int = 50) -> DataFrame:
    """``old_path, new_path, score, old_members, new_members`` of the classes of equal texts that share at least
    ``least`` percent of their bytes in whole lines; a class goes by its smallest path (:func:`content_classes` has the
    members), so copies make no pairs among themselves.

    Pairs come from shared lines, never from a product of both sides.  Equal texts, empty ones too, score 100 before
    lines are looked at; others at most 99, and texts of which one is less than half as long score nothing.

    In an order of all lines that is the same for both sides, the first line that a pair shares has all shared bytes
    at or behind it, on either side.  So a pair with enough of them meets in the leading lines behind which at least
    ``least`` percent remain; with the rarest lines first, frequent ones seldom lead, and no pair is lost.
    """
    def side(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The classes, and the counted lines of one text of each; both are read several times."""
        classes = cut(content_classes(sources).where("path = class_path").select("class_path", "members", "version"))
        lines = cut(_line_counts(sources.join(classes.select(F.col("class_path").alias("path")), "path", "left_semi")))
        return classes, lines

    (c1, o), (c2, n) = side(deleted), side(added)
    often = o.select("line").union(n.select("line")).groupBy("line").agg(F.count(F.lit(1)).alias("often"))
    a = _rarest(o, often, least).select(F.col("path").alias("old_path"), F.col("size").alias("s1"), "line")
    b = _rarest(n, often, least).select(F.col("path").alias("new_path"), F.col("size").alias("s2"), "line")
    big, small = F.greatest("s1", "s2"), F.least("s1", "s2")
    met = a.join(b, "line").where(2 * small >= big).select("old_path", "new_path", "s1", "s2").distinct()
    mine = o.select(F.col("path").alias("old_path"), "line", F.col("n").alias("n1"), "bytes")
    theirs = n.select(F.col("path").alias("new_path"), "line", F.col("n").alias("n2"))
    j = met.join(mine, "old_path").join(theirs, ["new_path", "line"]).groupBy("old_path", "new_path", "s1", "s2").agg(F.sum(F.least("n1", "n2") * F.col("bytes")).alias("common"))
    near = j.where(100 * F.col("common") >= least * big).select("old_path", "new_path", F.least(F.lit(99), F.floor(100 * F.col("common") / big)).cast("long").alias("score")).where(F.col("score") >= least)
    old = c1.select(F.col("class_path").alias("old_path"), F.col("members").alias("old_members"), F.col("version").alias("v1"))
    new = c2.select(F.col("class_path").alias("new_path"), F.col("members").alias("new_members"), F.col("version").alias("v2"))
    equal = old.join(new, F.col("v1") == F.col("v2")).select("old_path", "new_path", F.lit(100).cast("long").alias("score"), "old_members", "new_members")
    other = near.join(old, "old_path").join(new, "new_path").where("v1 <> v2").select("old_path", "new_path", "score", "old_members", "new_members")
    return equal.union(other)


def judged_renames(scores: DataFrame) -> DataFrame:
    """``old_path, new_path, score, reason`` of the best pairs of classes: no reason where one source became one other,
    else why they stay additions and deletions.

    ``copies``: a class has several members, so which of them it was can't be told; ``several-targets`` and
    ``several-origins``: another is as good; ``better-elsewhere``: the best of one has a better one itself.
    """
    def best(key: str) -> DataFrame:
        top = scores.groupBy(key).agg(F.max("score").alias("top"))
        per = scores.join(top, key).where("score = top").groupBy(key).agg(F.max("score").alias(f"{key}_top"), F.count(F.lit(1)).alias(f"{key}_n"))
        return per

    j = scores.join(best("old_path"), "old_path").join(best("new_path"), "new_path")
    j = j.where((F.col("score") == F.col("old_path_top")) | (F.col("score") == F.col("new_path_top")))
    reason = (
        F.when((F.col("score") < F.col("old_path_top")) | (F.col("score") < F.col("new_path_top")), F.lit("better-elsewhere"))
        .when((F.col("old_members") > 1) | (F.col("new_members") > 1), F.lit("copies"))
        .when(F.col("old_path_n") > 1, F.lit("several-targets")).when(F.col("new_path_n") > 1, F.lit("several-origins"))
    )
    return j.select("old_path", "new_path", "score", reason.alias("reason"))


def rename_pairs(scores: DataFrame) -> DataFrame:
    """Pairs that are each other's only best; ambiguous ones stay additions and deletions."""
    return judged_renames(scores).where("reason IS NULL").select("old_path", "new_path", "score")


#: Steps that the comparison of two versions may take.
STEPS = 2_000_000


class StepsSpent(Exception):
    """Two versions differ in more than the steps allowed can tell."""


class _Comparison:
    """A shortest edit script in space that grows with the lines alone.

    Paths are followed from both ends at once until they meet; the stretch of equal lines where they do divides the
    comparison into two smaller ones.  Only how far each diagonal reaches is kept, for the parts in turn.
    """

    def __init__(self, old: list[str], new: list[str], steps: int):
        self.old, self.new, self.left = old, new, steps
        self.gone: list[int] = []
        self.come: list[int] = []
        todo = [(0, len(old), 0, len(new))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            while a0 < a1 and b0 < b1 and old[a0] == new[b0]:
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and old[a1 - 1] == new[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
            if a0 == a1 or b0 == b1:
                self.gone += range(a0 + 1, a1 + 1)
                self.come += range(b0 + 1, b1 + 1)
            else:
                x, y, u, v = self._middle(a0, a1, b0, b1)
                todo += [(a0, x, b0, y), (u, a1, v, b1)]

    def _step(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise StepsSpent

    def _middle(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
        """Where the stretch in the middle of a shortest path begins and ends."""
        n, m = a1 - a0, b1 - b0
        delta = n - m
        ahead, back = {1: 0}, {1: 0}  # furthest lines of ``old`` by diagonal, from the start and from the end
        for d in range((n + m + 1) // 2 + 1):
            for k in range(-d, d + 1, 2):
                self._step()
                x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
                y = x - k
                at = x, y
                while x < n and y < m and self.old[a0 + x] == self.new[b0 + y]:
                    x, y = x + 1, y + 1
                ahead[k] = x
                if delta % 2 and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n:
                    return a0 + at[0], b0 + at[1], a0 + x, b0 + y
            for k in range(-d, d + 1, 2):
                self._step()
                x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
                y = x - k
                at = x, y
                while x < n and y < m and self.old[a1 - 1 - x] == self.new[b1 - 1 - y]:
                    x, y = x + 1, y + 1
                back[k] = x
                if not delta % 2 and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                    return a1 - x, b1 - y, a1 - at[0], b1 - at[1]
        raise AssertionError("no path")


def shortest_edit(old: list[str], new: list[str], steps: int = STEPS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Changed line ranges (from 1, inclusive) of a shortest edit script, on both sides; :class:`StepsSpent` if it is
    not found in so many steps."""
    c = _Comparison(old, new, steps)
    return _islands(c.gone), _islands(c.come)


def _islands(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def changed_lines(base: DataFrame, target: DataFrame, steps: int = STEPS) -> DataFrame:
    """``path, side, start_line, end_line`` of the lines that differ between versions of a path (``path, text``).

    A path whose comparison takes more than ``steps`` has one row with the side ``unknown`` and no lines.
    """
    a, b = base.select("path", F.col("text").alias("a")), target.select("path", F.col("text").alias("b"))
    pairs = a.join(b, "path").where(F.col("a") != F.col("b"))

    def diff(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, x, y in zip(part["path"], part["a"], part["b"]):
                try:
                    gone, come = shortest_edit(_feed_lines(x), _feed_lines(y), steps)
                except StepsSpent:
                    rows.append((path, "unknown", None, None))
                    continue
                rows += [(path, "old", s, e) for s, e in gone] + [(path, "new", s, e) for s, e in come]
            yield pd.DataFrame(rows, columns=["path", "side", "start_line", "end_line"]).astype({"start_line": "Int64", "end_line": "Int64"})

    return pairs.mapInPandas(diff, "path string, side string, start_line long, end_line long")


def _feed_lines(text: str) -> list[str]:
    """Lines with their line feeds; nothing stands behind a final one."""
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] else lines[:-1]
