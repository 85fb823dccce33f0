"""Statistics of results: breakdowns with what was left out, profiles of scores, rollups of status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .budget import running_sum


def breakdown(counts: DataFrame, key: Column, weight: str = "match_lines", top: int = 5) -> DataFrame:
    """``key, sources, total, omitted``: the ``top`` keys by total, then by name, and how many more there are.

    The top is a bounded heap, not a sort of all keys.
    """
    g = counts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("sources"), F.sum(weight).cast("long").alias("total"))
    n = g.agg(F.count(F.lit(1)).alias("n_"))
    best = g.orderBy(F.desc("total"), "key").limit(top)
    return best.join(F.broadcast(n)).select("key", "sources", "total", F.greatest(F.col("n_") - top, F.lit(0)).alias("omitted"))


def by_type(counts: DataFrame, top: int = 5) -> DataFrame:
    return breakdown(counts, P.type_key(F.col("path")), top=top)


def by_directory(counts: DataFrame, top: int = 5) -> DataFrame:
    return breakdown(counts, P.directory(F.col("path")), top=top)


def top_files(counts: DataFrame, top: int = 8) -> DataFrame:
    return counts.select("path", "match_lines").orderBy(F.desc("match_lines"), "path").limit(top)


def totals(counts: DataFrame) -> DataFrame:
    """One row: matching lines, occurrences, sources and directories."""
    return counts.agg(
        F.coalesce(F.sum("match_lines"), F.lit(0)).cast("long").alias("match_lines"), F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("occurrences"),
        F.count(F.lit(1)).alias("sources"), F.count_distinct(P.directory(F.col("path"))).alias("directories"),
    )


def score_profile(scores: DataFrame, score: str = "score", *keys: str) -> DataFrame:
    """Count, top, second, median, minimum, spread and the margin between the first two.

    The median comes from counts by value in order, of which a running sum keeps one at a time, not from a buffer with
    all values of a group.
    """
    s = F.col(score)
    out = scores.groupBy(*keys).agg(F.count(s).alias("count"), F.max(s).alias("top"), F.min(s).alias("min"))
    out = _joined(out, median(scores, score, *keys), keys)
    second = second_largest(scores, score, *keys)
    j = _joined(out, second, keys)
    return j.select(*keys, "count", "top", "second", "median", "min", (F.col("top") - F.col("min")).alias("spread"), (F.col("top") - F.col("second")).alias("top_margin"))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "left") if keys else a.join(F.broadcast(b), F.lit(True), "left")


def median(scores: DataFrame, score: str, *keys: str) -> DataFrame:
    """``keys, median``: the middle score, or half way between the two middle ones; null scores don't count."""
    by_value = scores.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    total = by_value.groupBy(*keys).agg(F.sum("n_").alias("all_"))
    if keys:
        upto = F.sum("n_").over(Window.partitionBy(*keys).orderBy("v_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = by_value.withColumn("upto_", upto).join(total, list(keys))
    else:
        ranked = running_sum(by_value, "n_", ["v_"]).join(F.broadcast(total))
    low, high = F.floor((F.col("all_") + 1) / 2), F.floor(F.col("all_") / 2) + 1
    at = lambda k: F.max(F.when((F.col("upto_") >= k) & (F.col("upto_") - F.col("n_") < k), F.col("v_")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def second_largest(scores: DataFrame, score: str, *keys: str) -> DataFrame:
    """The second largest score (equal to the largest where that occurs twice; null for one score)."""
    by_value = scores.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n_"))
    top = by_value.groupBy(*keys).agg(F.max(F.struct(F.col(score), F.col("n_"))).alias("m_"))
    j = by_value.join(top, list(keys)) if keys else by_value.join(F.broadcast(top))
    below = F.max(F.when(F.col(score) < F.col("m_")[score], F.col(score)))
    return j.groupBy(*keys).agg(F.when(F.max("m_.n_") > 1, F.max(f"m_.{score}")).otherwise(below).alias("second"))


def worst_status(rows: DataFrame, status: str = "status", order: Sequence[str] = ("stale", "unknown", "current"), *keys: str) -> DataFrame:
    """The status that comes first in ``order``, by ``keys``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(status))
    return rows.groupBy(*keys).agg(F.element_at(F.array(*[F.lit(x) for x in order]), F.min(rank).cast("int")).alias(status))


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).count().orderBy(column)
