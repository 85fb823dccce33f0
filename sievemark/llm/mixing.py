"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides how often it is taken.  Sizes are summed by source and hash bucket; the bucket in which the
budget of a source runs out is split again, and only that one, until a single hash is left; then documents below the
threshold are taken by a filter.  Nothing is sorted but the at most ``2**BITS`` buckets of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, measured, packed, unpacked

#: Bits of the hash that one round of refinement settles; the hash has 60.
BITS = 12
_HASH_BITS = 60


def doc_hash(key: Column) -> Column:
    """60 bits of the SHA-256 of the id as text (null: empty text), the same on every engine."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """``source_, source_size, target`` from rows of ``source_, size``: shares by weight of the whole, no target above
    ``max_repeats`` times its source, the excess reshared by weight until none is.

    The weights repeat over the sources in the order of their names by code point, null last.  The rows handled in one
    place are sources, not documents.
    """
    s = sized.groupBy("source_").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    s = s.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source_").asc_nulls_last())))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("weight", F.element_at(w, F.pmod(F.col("rn") - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    # Sources that reach their cap first come first: with some of them at their caps the rest is shared by weight.
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select(
        "*", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "rn")).alias("place"), F.sum("source_size").over(every).cast("double").alias("total"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("cap_before"), (F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))).alias("weight_left"),
    )
    fits = (F.col("total") - F.col("cap_before")) * F.col("weight") <= F.col("cap") * F.col("weight_left")
    s = s.withColumn("free", F.min(F.when(fits, F.col("place"))).over(every))
    at_free = F.col("place") == F.col("free")
    s = s.withColumn("rest", F.max(F.when(at_free, F.col("total") - F.col("cap_before"))).over(every)).withColumn("rest_weight", F.max(F.when(at_free, F.col("weight_left"))).over(every))
    target = F.when(F.col("place") < F.col("free"), F.col("cap")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_weight"))
    return s.select("source_", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source_, source_size, target, whole, threshold``: every document is taken ``whole`` times, and once more if
    its hash is at most ``threshold``.

    So the thresholds of the first, second, ... copy are nested: all, all, ..., ``threshold``, none.  The threshold is
    where the running sum comes nearest to what the target leaves over whole copies.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole).withColumn("budget", F.when(size > 0, F.col("target") - F.col("whole") * size).otherwise(F.lit(0.0)))
    state = cut(state.withColumn("before", F.lit(0.0)).withColumn("prefix", F.lit(0).cast("long")))
    shift = _HASH_BITS
    while shift > 0:
        inside, shift = shift, shift - BITS
        level = sized.select("source_", "size", "h", F.shiftright("h", inside).alias("prefix_"), F.shiftright("h", shift).alias("bucket"))
        s = state.select(F.col("source_").alias("s_"), "budget", "before", "prefix")
        near = level if inside == _HASH_BITS else level.join(s.select("s_", "prefix"), F.col("source_").eqNullSafe(F.col("s_")) & (F.col("prefix_") == F.col("prefix"))).drop("s_", "prefix")
        hist = near.groupBy("source_", "bucket").agg(F.sum("size").cast("double").alias("sum_"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("source_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = hist.join(s, F.col("source_").eqNullSafe(F.col("s_"))).withColumn("upto", F.col("before") + F.sum("sum_").over(run))
        # The boundary is the first bucket with which the sum exceeds the budget.
        over = j.where("upto > budget").groupBy("source_").agg(F.min(F.struct("bucket", "upto", "sum_", "low", "high")).alias("x"))
        over = over.select(F.col("source_").alias("o_"), F.col("x.bucket").alias("bucket"), (F.col("x.upto") - F.col("x.sum_")).alias("b_"), F.col("x.upto").alias("upto"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
        state = state.drop("upto", "low", "high").join(over, F.col("source_").eqNullSafe(F.col("o_")), "left")
        state = cut(state.select("source_", "source_size", "target", "whole", "budget", F.coalesce("b_", "before").alias("before"), F.coalesce("bucket", F.lit(-1)).cast("long").alias("prefix"), "upto", "low", "high"))
        if state.where("low < high").isEmpty():
            break
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("before")
    # A source whose budget no bucket exceeds has no boundary: all of it is taken once more.
    edge = F.when(F.col("low").isNull(), F.lit((1 << _HASH_BITS) - 1)).when(nearer, F.col("low")).otherwise(F.col("low") - 1)
    return state.select("source_", "source_size", "target", "whole", edge.alias("threshold"))


def _times(docs: DataFrame, weights, max_repeats: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(docs.select(docs[id_col].alias("id_"), docs[source_col].cast("string").alias("source_"), count_words(docs[text_col]).alias("size"), doc_hash(docs[id_col]).alias("h")))
    return sized, cut(thresholds(sized, source_targets(sized, weights, max_repeats)))


def _by_source(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """``rows`` with the thresholds of their ``source_``."""
    edge = measured(edge.withColumnRenamed("source_", "s_"), "s_")
    return rows.join(edge, F.col("source_").eqNullSafe(F.col("s_")))


def _copies(max_repeats: int) -> Column:
    """How often a document is taken, never more than ``max_repeats`` times, also without words."""
    return F.least(F.col("whole") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0), F.lit(max_repeats))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row; ``taken`` counts repeats.

    Size is the number of words (null: 0).  Null sources are one source, the last.  Rows that repeat an id have one
    hash and are taken together; null ids have one hash.  An empty table gives an empty result; a table without words
    takes nothing.  Other columns are ignored.  The choice depends on ids alone, so reruns agree.
    """
    sized, edge = _times(docs, weights, max_repeats, id_col, text_col, source_col)
    j = _by_source(sized, edge)
    return j.select(F.col("id_").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies(max_repeats)).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeated rows included; all columns as they were."""
    _, edge = _times(docs, weights, max_repeats, id_col, text_col, source_col)
    rows = packed(docs, source_=docs[source_col].cast("string"), h=doc_hash(docs[id_col]))
    j = _by_source(rows, edge)
    return unpacked(j.select("row_", _copies(max_repeats).cast("int").alias("times")).where("times > 0").select("row_", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_")), docs)
