"""Algebra of half-open ranges ``key, start, end``."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Overlapping and touching ranges of a key as one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(key, "start", "end", reach.alias("r_"))
    island = F.sum((F.col("r_").isNull() | (F.col("start") > F.col("r_"))).cast("int")).over(upto)
    return marked.withColumn("i_", island).groupBy(key, "i_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i_")


def overlap_anti(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Ranges of ``left`` that overlap none of ``right`` under the same key.

    ``right`` is merged first.  Of disjoint ranges only the last that starts before a range ends can overlap it, so
    one sorted pass replaces a join by inequality.
    """
    r = merge(right, key).select(key, "start", "end", F.lit(0).alias("side_"))
    packed = left.select(key, "start", "end", F.lit(1).alias("side_"), F.struct(*left.columns).alias("s_"))
    both = packed.unionByName(r.withColumn("s_", F.lit(None).cast(packed.schema["s_"].dataType)))
    # A left range stands at its end, a right one at its start; at the same place the left one comes first.
    at = F.when(F.col("side_") == 1, F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy(key).orderBy("at_", F.desc("side_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("at_", at).withColumn("reach_", F.max(F.when(F.col("side_") == 0, F.col("end"))).over(w))
    free = seen.where("side_ = 1").where(F.col("reach_").isNull() | (F.col("reach_") <= F.col("start")))
    return free.select("s_.*")


def subtract(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """What of ``left`` (merged) is not covered by ``right``."""
    a, b = merge(left, key), merge(right, key)
    points = a.select(key, F.col("start").alias("p"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(a.select(key, "end", F.lit(-1), F.lit(0))).union(b.select(key, "start", F.lit(0), F.lit(1))).union(b.select(key, "end", F.lit(0), F.lit(-1)))
    per = points.groupBy(key, "p").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return _sweep(per, key, (F.col("cl") > 0) & (F.col("cr") == 0))


def intersect(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """What both ``left`` and ``right`` cover."""
    a, b = merge(left, key), merge(right, key)
    points = a.select(key, F.col("start").alias("p"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(a.select(key, "end", F.lit(-1), F.lit(0))).union(b.select(key, "start", F.lit(0), F.lit(1))).union(b.select(key, "end", F.lit(0), F.lit(-1)))
    per = points.groupBy(key, "p").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return _sweep(per, key, (F.col("cl") > 0) & (F.col("cr") > 0))


def _sweep(per: DataFrame, key: str, wanted) -> DataFrame:
    w = Window.partitionBy(key).orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = per.select(key, F.col("p").alias("start"), F.lead("p").over(w).alias("end"), F.sum("l").over(upto).alias("cl"), F.sum("r").over(upto).alias("cr"))
    return merge(pieces.where(wanted & F.col("end").isNotNull()).select(key, "start", "end"), key)


def greedy_dedupe(candidates: DataFrame, key: str = "path", rank: str = "rank") -> DataFrame:
    """In order of rank, each candidate that overlaps none already kept under its key.

    The order decides, so each key is a fold; keys are independent and rows stream through it sorted.
    """
    schema = candidates.schema
    names = candidates.columns

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, starts, ends = object(), [], []
        for part in parts:
            keep = np.zeros(len(part), bool)
            for i, (k, a, b) in enumerate(zip(part[key], part["start"], part["end"])):
                if k != now:
                    now, starts, ends = k, [], []
                at = bisect_left(starts, a)
                if (at < len(starts) and starts[at] < b) or (at and ends[at - 1] > a):
                    continue
                starts.insert(at, a)
                ends.insert(at, b)
                keep[i] = True
            yield part[keep][names]

    return candidates.repartition(key).sortWithinPartitions(key, rank, "start").mapInPandas(fold, schema)


def smallest_enclosing(points: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """For each point (``key, at``) the shortest range (``key, name, start, end``) that holds it; of equally short ones
    the first by start and name.

    A sweep over the sorted starts and points of a key holds the ranges that are open, shortest on top; those that have
    ended are taken off when they get there.  So its time grows with points and ranges, not with their product,
    and its memory with the ranges that are open at once.
    """
    p = points.select(key, F.col("at").cast("long").alias("at"), F.lit(1).alias("side_"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("end")).distinct()
    r = ranges.select(key, F.col("start").cast("long").alias("at"), F.lit(0).alias("side_"), "name", F.col("end").cast("long").alias("end")).where("end > at")
    kind = points.schema[key].dataType.simpleString()

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = object(), []
        for part in parts:
            rows = []
            for k, at, side, name, end in zip(part[key].tolist(), part["at"].tolist(), part["side_"].tolist(), part["name"].tolist(), part["end"].tolist()):
                if k != now:
                    now, open_ = k, []
                if side == 0:
                    heappush(open_, (int(end) - at, at, name is None, name))
                    continue
                while open_ and open_[0][0] + open_[0][1] <= at:
                    heappop(open_)
                if open_:
                    length, start, _, name = open_[0]
                    rows.append((k, at, name, start, start + length))
            yield pd.DataFrame(rows, columns=[key, "at", "name", "start", "end"])

    return p.unionByName(r).repartition(key).sortWithinPartitions(key, "at", "side_").mapInPandas(sweep, f"{key} {kind}, at long, name string, start long, end long")
