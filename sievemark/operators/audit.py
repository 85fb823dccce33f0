"""Closure of named literals, and validation of saved evidence against current sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EvidenceError
from ..functions import text as T
from ..functions.pattern import Pattern
from ..session import cut
from ..sources.corpus import content_hash


def audit(sources: DataFrame, literals: Mapping[str, str], complete: bool = True, ignore_case: bool | None = None) -> DataFrame:
    """``id, literal, matches, files, status`` for every named literal.

    ``matches`` counts matching lines.  A literal without one is ``absent_with_complete_coverage`` only if the scan was
    complete, otherwise ``unknown``.  All literals are counted in one pass; the shuffle carries one row a task.
    """
    if not 1 <= len(literals) <= 32 or any(not v or len(v.encode()) > 256 for v in literals.values()):
        raise EvidenceError("1 to 32 literals of at most 256 bytes are needed", "E_AUDIT_PATTERNS")
    ps = {k: Pattern(v, literal=True, ignore_case=ignore_case) for k, v in literals.items()}

    def lines_with(p: Pattern) -> Column:
        return F.when(T.may_match(F.col("text"), p), F.size(F.filter(T.line_array(F.col("text")), lambda line: T.matches(line, p)))).otherwise(0)

    hits = [lines_with(p) for p in ps.values()]
    per_source = sources.select(*[h.alias(f"m{i}") for i, h in enumerate(hits)])
    sums = per_source.agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(ps))], *[F.sum((F.col(f"m{i}") > 0).cast("long")).alias(f"f{i}") for i in range(len(ps))])
    rows = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(p.text).alias("literal"), F.coalesce(f"m{i}", F.lit(0)).cast("long").alias("matches"), F.coalesce(f"f{i}", F.lit(0)).cast("long").alias("files")) for i, (k, p) in enumerate(ps.items())])
    status = F.when(F.col("matches") > 0, F.lit("present")).otherwise(F.lit("absent_with_complete_coverage" if complete else "unknown"))
    return sums.select(F.explode(rows).alias("x")).select("x.*").withColumn("status", status)


def manifest(sources: DataFrame) -> DataFrame:
    """``path, version`` of the sources, settled: what they were when this was called, whatever becomes of them."""
    return cut(sources.select("path", content_hash(F.col("text")).alias("version")))


def staleness(saved: DataFrame, current: DataFrame) -> DataFrame:
    """``path, status, reason`` of a settled manifest against the sources (``path, text``) as they are now."""
    known = validate(saved, current.select("path", content_hash(F.col("text")).alias("version")))
    there = current.select(F.col("path").alias("p_")).distinct().withColumn("there_", F.lit(True))
    reason = F.when(F.col("status") == "current", F.lit(None).cast("string")).when(F.col("there_").isNull(), F.lit("the source is gone")).when(F.col("status") == "stale", F.lit("the source has changed")).otherwise(F.lit("a version of the source is unknown"))
    # A source without a saved version can't be told apart from what it was, gone or not.
    return known.join(there, known["path"] == there["p_"], "left").select("path", "status", reason.alias("reason"))


def closure(before: DataFrame, after: DataFrame, ignored: DataFrame | None = None, skipped: int = 0) -> bool:
    """Whether a scan between two inventories (``path, version``) was complete: nothing changed, ignored or skipped."""
    if skipped or (ignored is not None and not ignored.isEmpty()):
        return False
    return changed_files(before, after).isEmpty()


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` between two inventories (``path, version``): added, deleted or modified."""
    a, b = before.select("path", F.col("version").alias("v1")), after.select("path", F.col("version").alias("v2"))
    change = F.when(F.col("v1").isNull(), F.lit("added")).when(F.col("v2").isNull(), F.lit("deleted")).otherwise(F.lit("modified"))
    return a.join(b, "path", "full_outer").where(~F.col("v1").eqNullSafe(F.col("v2"))).select("path", change.alias("change"))


def ignored_files(every: DataFrame, admitted: DataFrame) -> DataFrame:
    return every.join(admitted.select("path"), "path", "left_anti")


#: A row's hash is summed as so many numbers of so many hexadecimal digits.
HASH_WORDS, HASH_DIGITS = 4, 15


def inventory_hash(inventory: DataFrame) -> DataFrame:
    """One row with a hash of the whole inventory (``path, version``), whatever its order.

    The hashes of the rows are taken apart into numbers, which are summed; sums are merged before the shuffle, so no
    task gathers hashes.  It tells whether an inventory has changed; it does not withstand someone who looks for two
    inventories with one hash.
    """
    row = F.sha2(F.concat_ws("\0", "path", F.coalesce("version", F.lit(""))), 256)
    word = lambda i: F.conv(F.substring("h", i * HASH_DIGITS + 1, HASH_DIGITS), 16, 10).cast("decimal(38,0)")
    sums = inventory.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(word(i)), F.lit(0).cast("decimal(38,0)")).alias(f"w{i}") for i in range(HASH_WORDS)])
    said = F.concat_ws(",", *[F.col(c).cast("string") for c in sums.columns])
    return sums.select(F.substring(F.sha2(said, 256), 1, 32).alias("inventory_hash"))


def validate(saved: DataFrame, current: DataFrame) -> DataFrame:
    """``path, status`` of saved sources (``path, version``): current, stale, or unknown without a known version."""
    c = current.select("path", F.col("version").alias("now"), F.lit(True).alias("there"))
    status = F.when(F.col("version").isNull() | (F.col("there") & F.col("now").isNull()), F.lit("unknown")).when(F.col("there").isNull() | (F.col("version") != F.col("now")), F.lit("stale")).otherwise(F.lit("current"))
    return saved.select("path", "version").join(c, "path", "left").select("path", status.alias("status"))


def validation_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(F.col("status") == "stale", 0).when(F.col("status") == "unknown", 1).otherwise(2), "path")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two scans gave the same rows, as often; told by counts of rows on each side in one pass."""
    both = a.withColumn("side_", F.lit(1)).unionByName(b.withColumn("side_", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("side_").alias("n_")).where("n_ <> 0").isEmpty()
