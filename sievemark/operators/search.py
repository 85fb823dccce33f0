"""Content search over source tables: matching lines, summaries, several terms, restricted lines.

Every operator takes and returns DataFrames.  A literal first decides whole texts, so lines are only made of texts that
have it; lines that don't match never leave the scan stage.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import partial, reduce
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from ..errors import EvidenceError
from ..functions import text as T
from ..functions.batches import by_text
from ..functions.pattern import Pattern, escape


def matching_lines(sources: DataFrame, pattern: Pattern, *keys: str, ranges: bool = False, places: bool = False) -> DataFrame:
    """``keys, line_no, line, n`` (matches in the line) and, with ``ranges``, ``occurrences``; with ``places`` also
    ``at``, where the line begins in its text."""
    near = sources.where(T.may_match(F.col("text"), pattern))
    hit = (T.placed_lines if places else T.lines)(near, *keys).where(T.matches(F.col("line"), pattern))
    out = hit.withColumn("n", T.occurrence_count(F.col("line"), pattern))
    return out.withColumn("occurrences", T.occurrences(F.col("line"), pattern)) if ranges else out


def summary(sources: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """``keys, match_lines, occurrences``, one row for each source with a match.

    The lines of a source stay in its row, so nothing is shuffled to count them.
    """
    keys = keys or ("path",)
    near = sources.where(T.may_match(F.col("text"), pattern))
    hit = F.filter(T.line_array(F.col("text")), lambda line: T.matches(line, pattern))
    n = F.aggregate("hit_", F.lit(0).cast("long"), lambda a, line: a + T.occurrence_count(line, pattern))
    return near.select(*keys, hit.alias("hit_")).where(F.size("hit_") > 0).select(*keys, F.size("hit_").cast("long").alias("match_lines"), n.alias("occurrences"))


def ordered_summary(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Sources by matching lines, most first, then by path."""
    out = counts.orderBy(F.desc("match_lines"), "path")
    return out if limit is None else out.limit(limit)


def first_match(found: DataFrame, *keys: str) -> DataFrame:
    """The first matching line of each source."""
    keys = keys or ("path",)
    return found.groupBy(*keys).agg(F.min_by(F.struct("line_no", "line"), "line_no").alias("m")).select(*keys, "m.line_no", "m.line")


def context_windows(found: DataFrame, total_lines: Column | None = None, context: int = 2, *keys: str) -> DataFrame:
    """The lines around each match that belong to it: the nearest match owns a line, the earlier one on a tie."""
    keys = keys or ("path",)
    if not 0 <= context <= 20:
        raise EvidenceError("context is 0 to 20 lines", "E_CONTEXT")
    w = Window.partitionBy(*keys).orderBy("line_no")
    line, prev, nxt = F.col("line_no"), F.lag("line_no").over(w), F.lead("line_no").over(w)
    start = F.greatest(F.lit(1), line - context, F.coalesce(F.floor((prev + line) / 2) + 1, F.lit(1)))
    end = F.least(line + context, F.coalesce(F.floor((line + nxt) / 2), line + context))
    if total_lines is not None:
        end = F.least(end, total_lines)
    return found.select(*keys, "line_no", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))


def _hit_numbers(sources: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """``keys, lines_, hits_``: the lines of the sources with a match, and the numbers of those that match, in order."""
    near = sources.where(T.may_match(F.col("text"), pattern)).select(*keys, T.line_array(F.col("text")).alias("lines_"))
    hits = F.filter(F.transform("lines_", lambda line, i: F.when(T.matches(line, pattern), i + 1)), lambda n: n.isNotNull())
    return near.select(*keys, "lines_", hits.alias("hits_")).where(F.size("hits_") > 0)


def first_match_of(sources: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """:func:`first_match` of the sources themselves; a source stays in its row, so nothing is shuffled."""
    keys = keys or ("path",)
    first = F.element_at("hits_", 1)
    return _hit_numbers(sources, pattern, *keys).select(*keys, first.alias("line_no"), F.element_at("lines_", first).alias("line"))


def context_windows_of(sources: DataFrame, pattern: Pattern, context: int = 2, *keys: str) -> DataFrame:
    """:func:`context_windows` of the sources themselves, cut off at their ends; nothing is shuffled."""
    keys = keys or ("path",)
    if not 0 <= context <= 20:
        raise EvidenceError("context is 0 to 20 lines", "E_CONTEXT")
    found = _hit_numbers(sources, pattern, *keys)
    # Three arrays side by side: the match before, the match, the match behind.
    none = F.array(F.lit(None).cast("int"))
    n = F.size("hits_")
    rows = F.arrays_zip(F.concat(none, F.slice("hits_", F.lit(1), n - 1)).alias("p"), F.col("hits_").alias("line"), F.concat(F.slice("hits_", F.lit(2), n), none).alias("q"))
    x = found.select(*keys, F.size("lines_").alias("k"), F.explode(rows).alias("x")).select(*keys, "k", F.col("x.p").alias("p"), F.col("x.line").alias("line_no"), F.col("x.q").alias("q"))
    line = F.col("line_no")
    start = F.greatest(F.lit(1), line - context, F.coalesce(F.floor((F.col("p") + line) / 2) + 1, F.lit(1)))
    end = F.least(line + context, F.coalesce(F.floor((line + F.col("q")) / 2), line + context), F.col("k"))
    return x.select(*keys, "line_no", start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))


def checked_terms(terms: Sequence[str], low: int = 2, high: int = 3) -> list[str]:
    """The terms, if they are as many as allowed, different, and each a short line."""
    if not low <= len(terms) <= high or len(set(terms)) != len(terms):
        raise EvidenceError(f"{low} to {high} different terms are needed", "E_TERMS")
    if any(not t or len(t.encode()) > 256 or "\n" in t or "\0" in t for t in terms):
        raise EvidenceError("a term is one line of 1 to 256 bytes", "E_TERMS")
    return list(terms)


def _has_any(column: str, terms: list[str]) -> Column:
    """Few terms are searched as they are; many as one alternation, so that the text is read once."""
    if len(terms) > 8:
        return F.col(column).rlike("|".join(escape(t) for t in terms))
    return reduce(Column.__or__, [F.col(column).contains(t) for t in terms])


#: Occurrences that a worker hands back at a time.
OCCURRENCES_AT_A_TIME = 1 << 15


def _found(texts: list[str], terms: list[str], by_line: bool):
    """``(row, term index, line, start, where the line begins)`` of each occurrence."""
    for r, text in enumerate(texts):
        begins = [0, *accumulate(len(line) + 1 for line in text.split("\n"))] if by_line else [0]
        for i, term in enumerate(terms):
            at = text.find(term)
            while at >= 0:
                line = bisect_right(begins, at)
                yield r, i, line, at - begins[line - 1], begins[line - 1]
                at = text.find(term, at + len(term))


def _occurring(batches, terms: list[str], by_line: bool, places: bool):
    """Some texts and some occurrences at a time: what a worker holds grows with neither."""
    sizes, words = np.array([len(t) for t in terms]), pa.array(terms, pa.string())
    for batch in batches:
        names = batch.schema.names[:-1]
        for part in by_text(batch, len(names)):
            found = _found(part.column(len(names)).to_pylist(), terms, by_line)
            while some := list(islice(found, OCCURRENCES_AT_A_TIME)):
                row, index, number, start, place = np.array(some, np.int64).T
                keys = [part.column(k).take(pa.array(row)) for k in range(len(names))]
                out = [*keys, pa.array(index.astype(np.int32)), words.take(pa.array(index)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(start + sizes[index])]
                more = [pa.array(place)] if places else []
                yield pa.RecordBatch.from_arrays(out + more, names=[*names, "term_index", "term", "line_no", "start", "end", "at"][: len(out + more)])


def any_of(sources: DataFrame, terms: Sequence[str], *keys: str, by_line: bool = True, places: bool = False) -> DataFrame:
    """``keys, term_index, term, line_no, start, end`` for each occurrence of each term, case-sensitive; with ``places``
    also ``at``, where its line begins in the text.

    Offsets count from the start of the line, or without ``by_line`` from the start of the text (and ``line_no`` is 1).
    Occurrences of one term don't overlap; those of different terms may.  One pass reads the text for all terms, in time
    that grows with the text and the occurrences.
    """
    terms, keys = checked_terms(terms, 2, 64), keys or ("path",)
    near = sources.where(_has_any("text", terms)).select(*keys, "text")
    schema = near.drop("text").schema
    for name, kind in (("term_index", IntegerType()), ("term", StringType()), ("line_no", IntegerType()), ("start", LongType()), ("end", LongType()), *([("at", LongType())] if places else [])):
        schema = schema.add(name, kind)
    return near.mapInArrow(partial(_occurring, terms=terms, by_line=by_line, places=places), schema)


def term_counts(sources: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``term_index, term, occurrences, sources`` for every term, zero where there is none, in the order given.

    A source adds its counts in its own row; the shuffle carries one row for each term and task.
    """
    terms = checked_terms(terms, 2, 64)
    count = lambda t: ((F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(t), F.lit("")))) / F.lit(len(t.encode()))).cast("long")
    sums = sources.agg(*[F.sum(count(t)).alias(f"n{i}") for i, t in enumerate(terms)], *[F.sum((count(t) > 0).cast("long")).alias(f"s{i}") for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(i).alias("term_index"), F.lit(t).alias("term"), F.coalesce(f"n{i}", F.lit(0)).alias("occurrences"), F.coalesce(f"s{i}", F.lit(0)).alias("sources")) for i, t in enumerate(terms)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def all_of(sources: DataFrame, terms: Sequence[str], *keys: str) -> DataFrame:
    """``keys`` of the sources that have all terms, case-sensitive; a filter, without a join."""
    terms, keys = checked_terms(terms, 2, 3), keys or ("path",)
    out = sources
    for t in terms:
        out = out.where(F.col("text").contains(t))
    return out.select(*keys)


def all_of_within(occurrences: DataFrame, scopes: DataFrame, n_terms: int) -> DataFrame:
    """``path, scope`` for scopes (``path, scope, start, end``) that hold all terms of ``any_of`` style occurrences.

    One sweep over the starts of a source, from behind: of each term only the occurrence that ends first among those
    that begin no earlier can decide.
    """
    first = [F.when(F.col("term_index") == i, F.col("end")) for i in range(n_terms)]
    o = occurrences.select("path", "start", "end", "term_index", F.lit(None).cast("string").alias("scope"))
    both = o.unionByName(scopes.select("path", "start", "end", F.lit(None).cast("int").alias("term_index"), "scope"))
    # At the same place the occurrences come first, so that a scope sees them.
    w = Window.partitionBy("path").orderBy(F.desc("start"), F.col("term_index").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("path", "scope", "end", "term_index", *[F.min(f).over(w).alias(f"e{i}_") for i, f in enumerate(first)])
    return seen.where(F.col("term_index").isNull() & reduce(Column.__and__, [F.col(f"e{i}_") <= F.col("end") for i in range(n_terms)])).select("path", "scope").distinct()


def in_changed_lines(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Matching lines that lie in a changed range (``path, start_line, end_line``, inclusive) of their source."""
    ranges = changes.groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("ranges_"))
    j = found.join(ranges, "path")
    return j.where(F.exists("ranges_", lambda r: (F.col("line_no") >= r["start_line"]) & (F.col("line_no") <= r["end_line"]))).drop("ranges_")


def with_role(occurrences: DataFrame, roles: DataFrame, wanted: Sequence[str], *apart: str) -> DataFrame:
    """Occurrences that lie wholly inside an interval of a wanted role (``path, role, start, end``), each range once, or
    once for each of what ``apart`` names.

    One sweep over the starts of a source: an interval that begins no later and ends no earlier exists if the furthest
    end so far is far enough.  An empty occurrence must begin before that end.
    """
    r = roles.where(F.col("role").isin(*wanted)).select("path", "start", "end", F.lit(0).alias("side_"))
    packed = occurrences.dropDuplicates(["path", "start", "end", *apart]).select("path", "start", "end", F.lit(1).alias("side_"), F.struct(*occurrences.columns).alias("o_"))
    both = packed.unionByName(r.withColumn("o_", F.lit(None).cast(packed.schema["o_"].dataType)))
    w = Window.partitionBy("path").orderBy("start", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = both.withColumn("reach_", F.max(F.when(F.col("side_") == 0, F.col("end"))).over(w))
    return reach.where("side_ = 1 AND reach_ >= end AND reach_ > start").select("o_.*")


def modified_between(rows: DataFrame, column: str, after: object = None, before: object = None, keep_unknown: bool = False) -> DataFrame:
    """``after <= time < before``.  Unknown times stay in content search and go in file search."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & (F.col(column) >= F.lit(after))
    if before is not None:
        ok = ok & (F.col(column) < F.lit(before))
    return rows.where(F.coalesce(ok, F.lit(keep_unknown)) if after is not None or before is not None else F.lit(True))


def merged_versions(parts: DataFrame) -> DataFrame:
    """Rows of ``path, version, ...`` from several scans without the paths that had different versions."""
    good = parts.groupBy("path").agg(F.count_distinct("version").alias("k")).where("k = 1").select("path")
    return parts.join(good, "path", "left_semi")


def stable(found: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches of the sources (``path, size, mtime_ms, ctime_ms``) that are the same before and after a scan."""
    a = after.select("path", *[F.col(c).alias(f"{c}_2") for c in ("size", "mtime_ms", "ctime_ms")])
    same = before.join(a, "path").where((F.col("size") == F.col("size_2")) & (F.col("mtime_ms") == F.col("mtime_ms_2")) & (F.col("ctime_ms").isNull() | F.col("ctime_ms_2").isNull() | (F.col("ctime_ms") == F.col("ctime_ms_2"))))
    return found.join(same.select("path"), "path", "left_semi")


def scope_expanded(sources: DataFrame, pattern: Pattern, under: str, strict: bool = False) -> tuple[DataFrame, bool]:
    """Matches below a path, or everywhere if there are none and the scope isn't strict; and whether it expanded."""
    prefix = under.rstrip("/") + "/"
    near = matching_lines(sources.where((F.col("path") == under) | F.col("path").startswith(prefix)), pattern)
    if strict or not near.isEmpty():
        return near, False
    return matching_lines(sources, pattern), True


def preview_windows(found: DataFrame, per_source: int = 2, before: int = 3, height: int = 7) -> DataFrame:
    """``path, start_line, end_line``: windows around the first matches of a source that don't overlap.

    The choice is greedy, a fold over the sorted lines of one source.
    """
    lines = found.groupBy("path").agg(F.array_sort(F.collect_set("line_no")).alias("l"))
    none = F.array().cast("array<bigint>")

    def step(acc: Column, line: Column) -> Column:
        start = F.greatest(F.lit(1), line - before).cast("long")
        free = (F.size(acc) < per_source) & ((F.size(acc) == 0) | (start > F.try_element_at(acc, F.lit(-1)) + (height - 1)))
        return F.when(free, F.concat(acc, F.array(start))).otherwise(acc)

    starts = F.aggregate(F.col("l").cast("array<bigint>"), none, step)
    return lines.select("path", F.explode(starts).alias("start_line")).select("path", "start_line", (F.col("start_line") + height - 1).alias("end_line"))


def in_text(found: DataFrame, *more: str) -> DataFrame:
    """``path, start, end`` (and ``more``) of each occurrence of lines that were found with their places, counted from
    the start of the text.  The scan has told where lines begin, so nothing is read or joined again."""
    each = found.select("path", *more, "at", F.explode("occurrences").alias("o_"))
    return each.select("path", *more, (F.col("o_.start") + F.col("at")).alias("start"), (F.col("o_.end") + F.col("at")).alias("end"))


def only_inside(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines (``path, line_no, n, occurrences, at, ...``) with those of their occurrences alone that lie wholly inside a
    range (``path, start, end`` in the text); lines that have none go."""
    each = found.select("path", "line_no", "at", F.explode("occurrences").alias("x_")).select("path", "line_no", "x_", (F.col("x_.start") + F.col("at")).alias("start"), (F.col("x_.end") + F.col("at")).alias("end"))
    hit = with_role(each, ranges.select("path", F.lit("").alias("role"), "start", "end"), [""])
    kept = hit.groupBy(F.col("path").alias("p_"), F.col("line_no").alias("l_")).agg(F.sort_array(F.collect_list("x_")).alias("x_"))
    j = found.join(kept, (F.col("path") == F.col("p_")) & (F.col("line_no") == F.col("l_")))
    return j.select(*[F.size("x_").cast("long").alias(c) if c == "n" else F.col("x_").alias(c) if c == "occurrences" else F.col(c) for c in found.columns])


def byte_matches(contents: DataFrame, literal: bytes, *keys: str) -> DataFrame:
    """``keys, start, end`` in bytes of each occurrence of fixed bytes in a binary column ``content``, whatever its
    encoding; each is checked against the bytes it stands for."""
    keys = keys or ("path",)
    # In ISO-8859-1 a byte is a character, so offsets of the text are those of the bytes.
    near = contents.select(*keys, "content", F.decode("content", "ISO-8859-1").alias("text"))
    p = Pattern(literal.decode("ISO-8859-1"), literal=True)
    hit = near.where(T.matches(F.col("text"), p)).select(*keys, "content", F.explode(T.occurrences(F.col("text"), p)).alias("r"))
    same = F.substring("content", (F.col("r.start") + 1).cast("int"), F.lit(len(literal))) == F.lit(bytearray(literal))
    return hit.where(same).select(*keys, "r.start", "r.end")
