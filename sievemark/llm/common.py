"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, release, remove, shared_dir

__all__ = ["BROADCAST_BYTES", "SPACE_CLASS", "WORD_PATTERN", "count_words", "cut", "measured", "one_space", "packed", "release", "remove", "shared_dir", "table", "unpacked"]

#: White space as the operators understand it: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty.

    The pattern only matches runs that are not already one space, so most gaps between words cost nothing.
    """
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def count_words(text: Column) -> Column:
    """Number of maximal runs without white space (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: A side of a join is broadcast if its names and numbers are known to take at most so many bytes.
BROADCAST_BYTES = 8 << 20


def measured(small: DataFrame, name: str) -> DataFrame:
    """A settled table of names, marked for broadcast if it is measured to fit.

    Then the other side does not move and a hot name stays spread; a larger table is joined by a shuffle, which the
    skew-join rule can split.
    """
    held = small.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row as one struct ``row_`` beside working columns, so that no input name can clash with them."""
    return df.select(F.struct(*[df[_quote(c)] for c in df.columns]).alias("row_"), *[c.alias(k) for k, c in extra.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` again from a frame made by :func:`packed`."""
    return df.select(*[F.col("row_").getField(c).alias(c) for c in like.columns])


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
