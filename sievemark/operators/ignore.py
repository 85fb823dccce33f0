"""Ignore rules as a table: nested ignore files decide about paths that need not exist any more.

A rule belongs to the folder of its file.  A path is decided folder by folder from the top: each folder above it, and
then the path itself, is held against the rules of all folders above that, where the last match wins (deeper folders
and later lines come last).  What lies below an ignored folder stays ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex
from ..sources.workspace import PROTECTED

#: Names of ignore files; the rules of a later one win over those of an earlier one in the same folder.
NAMES = (".gitignore", ".ignore", ".rgignore")
PRIVATE = r"(^|/)(" + "|".join(re.escape(p) for p in PROTECTED) + r")(/|$)"
BROADCAST_BYTES = 8 << 20
_BELOW = "(?:/.*)?$"


def parse_rules(text: str) -> list[tuple[int, str, bool, bool]]:
    """``line, regex, folders_only, shown`` of an ignore file; ``regex`` is over paths relative to its folder."""
    out = []
    for i, line in enumerate(text.splitlines()):
        # White space at the end counts only behind a backslash.
        while line.endswith((" ", "\t", "\r")) and not line.endswith("\\ "):
            line = line[:-1]
        shown = line.startswith("!")
        body = line[1:] if shown else line
        folders_only = body.endswith("/")
        body = body.rstrip("/")
        if not body or line.startswith("#"):
            continue
        if body[0] == "\\" and body[1:2] in ("#", "!"):
            body = body[1:]
        if "/" in body and not body.startswith(("/", "**/")):
            body = "/" + body
        # Braces and a leading mark have no meaning in these files.
        regex = glob_regex(re.sub(r"[{}!]", lambda m: f"[{m[0]}]" if m[0] != "!" else m[0], body.replace("\\ ", " ")))
        out.append((i, regex[: -len(_BELOW)] + "$" if regex.endswith(_BELOW) else regex, folders_only, shown))
    return out


def rules(files: DataFrame) -> DataFrame:
    """``folder, rank, regex, folders_only, shown`` of the ignore files among ``path, text``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"]):
                folder, _, name = path.rpartition("/")
                rows += [(folder, NAMES.index(name) << 32 | line, *rule) for line, *rule in parse_rules(text or "")]
            yield pd.DataFrame(rows, columns=["folder", "rank", "regex", "folders_only", "shown"])

    names = F.element_at(F.split("path", "/"), -1)
    return files.where(names.isin(*NAMES)).select("path", "text").mapInPandas(run, "folder string, rank long, regex string, folders_only boolean, shown boolean")


def ignored(paths: DataFrame, table: DataFrame) -> DataFrame:
    """The paths (``path``) that the rules hide; private ones first, which no rule shows again.

    The rules of a folder are one row, and folders with rules are few, so they are joined to the paths where these lie
    if they are measured to fit, and by a shuffle otherwise.  Of paths, only as many rows as they have folders with
    rules arise.
    """
    per = table.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("rank", "regex", "folders_only", "shown"))).alias("rules"))
    size = table.agg(F.sum(F.octet_length("regex") + F.octet_length("folder") + 64)).first()[0] or 0
    per = F.broadcast(per) if size <= BROADCAST_BYTES else per
    parts = F.split("path", "/")
    n = F.size("parts")
    upto = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    each = paths.select("path").distinct().where(~F.col("path").rlike(PRIVATE)).withColumn("parts", parts)
    above = each.select("path", "parts", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), upto)).alias("depth", "folder"))
    met = above.join(per, "folder")
    # Every folder below the one with the rules, down to the path itself.
    entries = met.select("path", "depth", "rules", n.alias("n"), F.explode(F.transform(F.sequence(F.col("depth") + 1, n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("parts", F.col("depth") + 1, k - F.col("depth")), "/").alias("rel")))).alias("e"))
    hits = F.expr("filter(rules, r -> e.rel rlike r.regex AND (NOT r.folders_only OR e.k < n))")
    verdicts = entries.select("path", "depth", F.col("e.k").alias("k"), F.try_element_at(hits, F.lit(-1)).alias("last"))
    decided = verdicts.where("last IS NOT NULL").groupBy("path", "k").agg(F.max_by("last.shown", "depth").alias("shown"))
    by_rules = decided.where("NOT shown").select("path").distinct()
    return by_rules.union(paths.where(F.col("path").rlike(PRIVATE)).select("path").distinct())


def visible(historic: DataFrame, files: DataFrame) -> DataFrame:
    """Historic paths that today's ignore files do not hide; explicit globs come after this."""
    return historic.join(ignored(historic, rules(files)), "path", "left_anti")
