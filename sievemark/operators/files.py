"""File discovery and language inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# Which structural operators a language has, and who provides them.
CAPABILITIES = {
    "javascript": ("imports", "outline", "roles", "structure", "tests"),
    "typescript": ("imports", "outline", "roles", "structure", "tests"),
    "tsx": ("imports", "outline", "roles", "structure", "tests"),
    "go": ("roles", "structure"),
    "python": ("outline",),
}
#: What works here without a syntax provider.
BUILT_IN = {("python", "outline")}


def discover(sources: DataFrame, query: str, root: str = "", limit: int | None = None) -> DataFrame:
    """``path, score`` of the paths that answer the query, best first; scored relative to ``root``."""
    prefix = root.rstrip("/") + "/" if root else ""
    path = F.when(F.col("path").startswith(prefix) & (F.length("path") > len(prefix)), F.expr(f"substring(path, {len(prefix) + 1})")).otherwise(P.basename(F.col("path"))) if prefix else F.col("path")
    found = sources.select("path", P.file_score(path, query).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "path")
    return found if limit is None else found.limit(limit)


def languages(sources: DataFrame) -> DataFrame:
    """``language, sources``: counts of sources by language, without those of no known language."""
    return sources.select(P.language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("sources"))


def capabilities(sources: DataFrame, providers: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """``language, capability, available, sources`` for every known language, zero where it has no source."""
    spark = sources.sparkSession
    listed = {(name, c) for name, cs in CAPABILITIES.items() for c in cs}
    # A provider may have more than the list.
    rows = [(*pair, pair in BUILT_IN | providers) for pair in sorted(listed | providers)]
    known = spark.createDataFrame(rows, "language string, capability string, available boolean")
    return known.join(languages(sources), "language", "left").select("language", "capability", "available", F.coalesce("sources", F.lit(0)).alias("sources"))
