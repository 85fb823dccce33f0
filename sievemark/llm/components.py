"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, release


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node that has an edge to another one, and ``degree``, its
    edges in the star that a component has become.  The result is settled, so that :func:`release` deletes it.

    Each step keeps a linear number of edges and moves ids only; the minimum of a node's neighbours is aggregated
    before the shuffle, and brought back to them by a join that does not gather the edges of a node: minima that are
    counted to fit in ``BROADCAST_BYTES`` are broadcast, others are joined by a shuffle whose hot keys the skew-join rule can
    split.  So a node with very many edges does not meet them in one task, and few nodes take few exchanges.  Rounds grow
    with the logarithm of the component size.  Nulls and loops are ignored.
    """
    e = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    while True:
        low = cut(_lowest(e))
        nodes, rest = low.agg(F.count(F.lit(1)), F.count_if(F.expr("component < node AND degree > 1"))).first()
        # If all nodes with a smaller neighbour have no other one, every edge leads to the smallest node of its component.
        if not rest:
            release(e)
            return low
        few = nodes * 16 <= BROADCAST_BYTES
        old, e = e, cut(_small(_large(e, low, few), few))
        release(old, low)


def _lowest(e: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return low.select(F.col("u").alias("node"), F.least("u", "m").alias("component"), "degree")


def _brought(edges: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """``u, v, m``: the edges with the minimum of their ``u``.

    The rule that splits hot keys of a join wants both sides straight from an exchange of the join's own.  ``low``
    lies by ``u`` already, and would be joined where it was aggregated; dealt out evenly, its few rows are exchanged
    for the join like the edges.
    """
    if few:
        return edges.join(F.broadcast(low), "u").select("u", "v", "m")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.join(low.repartition(parts).hint("merge"), "u").select("u", "v", "m")


def _large(e: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    upward = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    step = _brought(upward, low.select(F.col("node").alias("u"), F.col("component").alias("m")), few).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Where the edges do not move in the small-star step, that one drops what repeats for both.
    return step if few else step.distinct()


def _small(e: DataFrame, few: bool) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    step = _brought(e, low, few).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
    return step.select("x.u", "x.v").where("u <> v").distinct()
