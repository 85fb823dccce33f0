"""Host-level quality rules.

Base rules fail single documents.  Failures are counted by host and the rates are shrunk with a beta prior fitted to
all hosts (method of moments), so that a host with few documents is judged mostly by the rate that is usual.  Hosts
whose shrunken rate is too high are rejected, and the verdict is joined back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, measured
from .vectext import U64, Chunk, chunks, mix, windows, word_hashes, words

MIN_WORDS = 10
#: Percent of a document's words that may lie in repeated windows.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected above this shrunken rate of failures.
MAX_HOST_RATE = 0.5
#: The prior weighs at most so many documents.
MAX_STRENGTH = 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT = np.ones(256, bool)  # bytes that begin a code point and are not white space
_CODE_POINT[0x80:0xC0] = False
_CODE_POINT[[0x20, *range(0x09, 0x0E)]] = False


def _per_row(mask: np.ndarray, chunk: Chunk) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]


def _again(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each (row, hash) occurs."""
    key = mix(h ^ mix(row.astype(U64) + U64(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse]


def _duplicate_lines(chunk: Chunk, word_starts: np.ndarray) -> np.ndarray:
    ends = np.union1d(np.flatnonzero(chunk.data == 10), chunk.offsets[1:])
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts + ((starts < len(chunk.data)) & (chunk.data[np.minimum(starts, len(chunk.data) - 1)] == 10) & (starts < ends))
    # A line feed that begins a row is the end of an empty line; what follows it starts one byte later as well.
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    key = np.unique(mix(word_hashes(chunk.data, starts, ends) ^ mix(row.astype(U64) + U64(1))), return_index=True)[1]
    return np.bincount(row, minlength=chunk.rows) - np.bincount(row[key], minlength=chunk.rows)


def _repeat_words(chunk: Chunk, w, h: np.ndarray) -> np.ndarray:
    if len(h) < WINDOW:
        return np.zeros(chunk.rows, np.int64)
    at = np.flatnonzero(w.doc[: len(h) - WINDOW + 1] == w.doc[WINDOW - 1 :])
    twice = at[_again(w.doc[at], windows(h, WINDOW)[at]) > 1]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    return np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=chunk.rows)


_BASE = "id_ long, host_ string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _base(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for chunk in chunks(batch.column(2)):
            w = words(chunk)
            if len(chunk.data):
                h = word_hashes(chunk.data, w.starts, w.ends)
                found = (w.counts, _per_row(_CODE_POINT[chunk.data], chunk), _per_row(_SYMBOL[chunk.data], chunk), _duplicate_lines(chunk, w.starts), _repeat_words(chunk, w, h))
            else:
                found = (np.zeros(chunk.rows, np.int64),) * 5
            for column, values in zip(out, found):
                column.append(values)
        whole = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole], names=["id_", "host_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def base_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_, host_``, the five counts, and ``base_failed`` for every row, in one pass over whole texts."""
    rows = docs.select(docs[id_col].cast("long"), docs[host_col].cast("string"), docs[text_col])
    counted = rows.mapInArrow(_base, _BASE)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_rates(base: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, rate, host_failed`` with the shrunken rate; null hosts are no host.

    Counts are aggregated before the shuffle; the prior is two numbers, fitted on one row for each host.
    """
    hosts = base.where("host_ IS NOT NULL").groupBy(F.col("host_").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(p), F.var_pop(p)).first()
    mean, spread = mean or 0.0, spread or 0.0
    # Moments of a beta distribution; with (almost) equal rates or with one host the prior weighs as much as it may.
    room = mean * (1 - mean)
    strength = min(room / spread - 1, MAX_STRENGTH) if spread > 1e-6 and room > spread else MAX_STRENGTH
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > MAX_HOST_RATE).alias("host_failed"))


def host_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate`` by row.

    A null text has no words and so fails.  A null host is no host: its documents are kept by the base rules alone,
    and ``host_rate`` is null.  Rows that repeat count each; other columns are ignored; an empty table gives an empty
    result.  Words, windows and lines are compared by 64-bit hashes inside one document.
    """
    base = cut(base_rules(docs, host_col, id_col, text_col))
    verdict = measured(cut(host_rates(base).select("host", "rate", "host_failed")), "host")
    j = base.join(verdict, base["host_"] == verdict["host"], "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return j.select(F.col("id_").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("rate").alias("host_rate"))
