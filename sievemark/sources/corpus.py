"""Corpora as source tables: one row for each document with ``path`` and ``text`` (and what else a corpus has)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``path, text, doc_id, lang, source`` with paths ``source/lang/doc_id.txt``."""
    d = table(spark, root, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("path"), "text", "doc_id", "lang", "source")


def pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"), "page_id")


def conversations(spark: SparkSession, root: str) -> DataFrame:
    """One source for each conversation, one line for each turn."""
    turns = table(spark, root, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", F.translate("text", "\n", " ")).alias("line"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("t"))
    return ordered.select(F.concat(F.col("conv_id").cast("string"), F.lit(".chat")).alias("path"), F.array_join("t.line", "\n").alias("text"), "conv_id")


def content_hash(text: Column) -> Column:
    """SHA-256 of the bytes, the version of a source."""
    return F.sha2(text.cast("binary"), 256)


def admission(content: Column) -> Column:
    """Why a source can or can't be analysed as text: binary, unavailable, empty or admitted."""
    text = content.cast("string")
    return (
        F.when(content.isNull(), F.lit("unavailable"))
        .when(F.locate("00", F.regexp_replace(F.hex(content), "(..)", "$1 ")) > 0, F.lit("binary"))
        .when(~F.is_valid_utf8(text), F.lit("unavailable"))
        .when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit("empty"))
        .otherwise(F.lit("admitted"))
    )
