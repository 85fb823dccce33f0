"""Column expressions over lines of text.

Lines end at LF only.  Offsets count code points unless a name says bytes or utf16.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .pattern import Pattern

#: Display limit of one line, in UTF-16 units where text is ASCII.
LINE_CHARACTERS = 500
RANGE = StructType([StructField("start", LongType()), StructField("end", LongType())])


def line_array(text: Column) -> Column:
    """Lines of a text; the empty piece behind a final LF is no line."""
    pieces = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def lines(sources: DataFrame, *keys: str) -> DataFrame:
    """``keys, line_no, line``: one row for each line, numbered from 1."""
    keys = keys or ("path",)
    return sources.select(*keys, F.posexplode(line_array(F.col("text"))).alias("i", "line")).select(*keys, (F.col("i") + 1).alias("line_no"), "line")


@F.pandas_udf(ArrayType(LongType()))
def line_starts(text: pd.Series) -> pd.Series:
    """Where each line begins, in code points; a sum that runs along a row, which no array function does in linear time."""
    return text.map(lambda s: None if s is None else [0, *accumulate(len(line) + 1 for line in s.split("\n"))])


def placed_lines(sources: DataFrame, *keys: str) -> DataFrame:
    """:func:`lines` with ``at``, where each begins in its text."""
    keys = keys or ("path",)
    rows = sources.select(*keys, line_array(F.col("text")).alias("lines_"), line_starts("text").alias("starts_"))
    both = F.arrays_zip("lines_", F.slice("starts_", F.lit(1), F.size("lines_")).alias("starts_"))
    return rows.select(*keys, F.posexplode(both).alias("i", "x_")).select(*keys, (F.col("i") + 1).alias("line_no"), F.col("x_.lines_").alias("line"), F.col("x_.starts_").alias("at"))


def matches(line: Column, pattern: Pattern) -> Column:
    """Whether a line matches."""
    return line.contains(pattern.text) if pattern.plain else line.rlike(pattern.java)


def may_match(text: Column, pattern: Pattern) -> Column:
    """A cheap test that no text with a matching line fails; literals decide whole texts before lines are made."""
    return text.contains(pattern.text) if pattern.plain else F.lit(True)


def occurrence_count(line: Column, pattern: Pattern) -> Column:
    """Number of matches that don't overlap, as a long."""
    if pattern.plain:
        return ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(pattern.text), F.lit("")))) / F.lit(len(pattern.text.encode()))).cast("long")
    return F.regexp_count(line, F.lit(pattern.java)).cast("long")


def occurrences(line: Column, pattern: Pattern) -> Column:
    """Matches that don't overlap, as an array of half-open ranges.

    The gaps between matches and the matches themselves come from the same matcher, so running sums of their lengths
    are the offsets.  Patterns that can match the empty string need Python, and literals are found there in time that
    grows with the line only.
    """
    if pattern.may_be_empty:
        return _python_occurrences(pattern)(line)
    if pattern.plain:
        return _literal_occurrences(pattern.text)(line)
    gaps = F.split(line, pattern.java, -1)
    found = F.regexp_extract_all(line, F.lit(pattern.java), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(ArrayType(RANGE)).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["hit"])
        one = F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
        return F.struct(b.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _literal_occurrences(term: str):
    k = len(term)

    def found(line: str) -> list[dict]:
        out, at = [], line.find(term)
        while at >= 0:
            out.append({"start": at, "end": at + k})
            at = line.find(term, at + k)
        return out

    @F.pandas_udf(ArrayType(RANGE))
    def ranges(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else found(s))

    return ranges


def _python_occurrences(pattern: Pattern):
    java, flags = pattern.java, "(?i)" if pattern.insensitive else ""
    body = flags + java[java.index(")") + 1 :]

    @F.pandas_udf(ArrayType(RANGE))
    def ranges(column: pd.Series) -> pd.Series:
        import regex

        p = regex.compile(body)
        return column.map(lambda s: None if s is None else [{"start": m.start(), "end": m.end()} for m in p.finditer(s)])

    return ranges


def byte_offset(line: Column, at: Column) -> Column:
    """Bytes of UTF-8 before a code point of a line."""
    return F.octet_length(F.substring(line, F.lit(1), at.cast("int"))).cast("long")


def utf16_offset(line: Column, at: Column) -> Column:
    """UTF-16 units before a code point of a line, with carriage returns removed as displays do."""
    return (F.octet_length(F.encode(F.translate(F.substring(line, F.lit(1), at.cast("int")), "\r", ""), "UTF-16BE")) / 2).cast("long")


def line_start_bytes(text: Column, line_no: Column) -> Column:
    """Byte offset of a line in its text."""
    return F.octet_length(F.call_function("substring_index", text, F.lit("\n"), (line_no - 1).cast("int"))).cast("long") + F.when(line_no > 1, 1).otherwise(0)


def shown(line: Column) -> Column:
    """A line as displayed: without carriage returns."""
    return F.translate(line, "\r", "")


def excerpt(text: Column, focus_start: Column, focus_end: Column, limit: int = LINE_CHARACTERS) -> Column:
    """At most ``limit`` characters of a line around a focus, with an ellipsis where it was cut."""
    n = F.length(text)
    a = F.greatest(F.lit(0), F.least(focus_start, n))
    b = F.greatest(a, F.least(focus_end, n))
    room = F.floor((F.lit(limit) - (b - a)) / 2)
    start = F.when(b - a >= limit, F.least(a, n - limit)).otherwise(F.least(F.greatest(F.lit(0), a - room), n - limit)).cast("int")
    body = F.substring(text, start + 1, F.lit(limit))
    cut = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(start + limit < n, F.lit("…")).otherwise(F.lit("")))
    return F.when(n <= limit, text).otherwise(cut)
