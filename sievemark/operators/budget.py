"""Bounded results.  Two rules, which must not be mixed: a prefix stops at the first row that doesn't fit; retention
skips such a row and goes on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def prefix(rows: DataFrame, size: str, budget: int, order: list[str], key: str | None = None) -> DataFrame:
    """Rows in order while their sizes sum to at most ``budget``, by ``key`` if given.

    Without a key the running sum goes through all rows in order; they are first summed by range partition, so that
    no task sees them all.
    """
    if key is not None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("upto_", F.sum(size).over(w)).where(F.col("upto_") <= budget).drop("upto_")
    return running_sum(rows, size, order).where(F.col("upto_") <= budget).drop("upto_", "part_")


def running_sum(rows: DataFrame, size: str, order: list[str | Column]) -> DataFrame:
    """``upto_``: the sum of ``size`` over a global order, in two passes over range partitions."""
    # The part of a row must not change between the passes, so it is settled once.
    dealt = cut(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    sums = dealt.groupBy("part_").agg(F.sum(size).alias("s_"))
    before = F.coalesce(F.sum("s_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("part_", before.alias("base_"))
    inner = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(base), "part_").withColumn("upto_", F.col("base_") + F.sum(size).over(inner)).drop("base_")


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``name``: the place of a row from 1 among those with its values of ``by``.

    Places in the order of all rows come from range partitions; from them the first place of each group is taken away.
    So a group with most of the rows is spread over tasks like the others.
    """
    placed = cut(running_sum(rows.withColumn("one_", F.lit(1)), "one_", [*by, *order]).drop("one_", "part_"))
    first = placed.groupBy(*by).agg(F.min("upto_").alias("first_"))
    keys = first.select(*[F.col(c).alias(f"g{i}_") for i, c in enumerate(by)], "first_")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"g{i}_")) for i, c in enumerate(by)])
    return placed.join(keys, same).withColumn(name, F.col("upto_") - F.col("first_") + 1).drop("upto_", "first_", *[f"g{i}_" for i in range(len(by))])


def page(rows: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in order, with ``ord`` (from 1)."""
    first = rows.orderBy(*order).limit((number + 1) * size)
    return first.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("ord") > number * size)


def retained(rows: DataFrame, size: str, order: list[str], key: str, max_bytes: int, max_rows: int) -> DataFrame:
    """Rows of each key in order that still fit; one that doesn't is skipped, and smaller ones behind it may follow."""
    schema = rows.schema

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, n = object(), 0, 0
        for part in parts:
            keep = []
            for k, s in zip(part[key], part[size]):
                if k != now:
                    now, used, n = k, 0, 0
                ok = n < max_rows and used + s <= max_bytes
                if ok:
                    used, n = used + s, n + 1
                keep.append(ok)
            yield part[pd.Series(keep, index=part.index, dtype=bool)]

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)
