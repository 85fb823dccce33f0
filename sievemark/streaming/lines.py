"""Search over a stream of new sources: the same line filter, as an append-only query.

This is an extension; paging, audits and validation need settled sources and stay batch operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern
from ..operators.search import matching_lines


def watch(sources: DataFrame, pattern: Pattern) -> DataFrame:
    """``path, line_no, line, n`` of each source as it arrives; stateless, so any trigger and sink works."""
    return matching_lines(sources, pattern)


def counts_by_window(sources: DataFrame, pattern: Pattern, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Matching lines by event-time window; windows are dropped once they are later than the watermark."""
    found = matching_lines(sources.withWatermark(time, late), pattern, "path", time)
    return found.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("match_lines"))
