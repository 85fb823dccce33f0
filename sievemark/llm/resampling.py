"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of all text, give each document the
logarithm of an importance weight.  Adding Gumbel noise and keeping the largest sums draws documents without
replacement in proportion to their weights.  The noise comes from the id, so reruns agree.  The k-th largest sum is
found by histograms that split only the bucket it lies in; nothing is sorted.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectext import LOWER, U64, Chunk, chunks, keys, mix, windows, word_hashes, words

BUCKETS = 1 << 14
#: The target model is fitted on at most so many labelled documents, those with the smallest hashes of their ids.
TARGET_ROWS = 20_000
SMOOTHING = 0.5
_SEEDS = keys(3, 31)


def ngrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words; A-Z in lower case."""
    if not len(chunk.data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chunk.data = LOWER[chunk.data]
    w = words(chunk)
    h = word_hashes(chunk.data, w.starts, w.ends)
    at = np.flatnonzero(w.doc[:-1] == w.doc[1:])
    pairs = windows(h, 2)[at] if len(h) > 1 else np.empty(0, U64)
    bucket = np.concatenate((mix(h ^ _SEEDS[0]), mix(pairs ^ _SEEDS[1]))) >> U64(50)
    return np.concatenate((w.doc, w.doc[at])), bucket.astype(np.int64)


def _count(batches):
    total, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flags = np.asarray(batch.column(1))
        for chunk in chunks(batch.column(0)):
            row, bucket = ngrams(chunk)
            total += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[flags[chunk.first : chunk.first + chunk.rows][row]], minlength=BUCKETS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total), pa.array(target)], names=["bucket", "total", "target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all).

    The counts of all text cover every document; each task adds up its own before the shuffle, and the driver gets
    ``BUCKETS`` rows.
    """
    ids = target_ids.select(F.col(id_col).cast("long").alias("t_")).where("t_ IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("t_"), "t_").limit(target_rows)
    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].alias("text_")).join(F.broadcast(ids), F.col("id_") == F.col("t_"), "left")
    counted = rows.select("text_", F.col("t_").isNotNull().alias("is_target")).mapInArrow(_count, "bucket long, total long, target long")
    total, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("target").alias("target")).collect():
        total[r["bucket"]], target[r["bucket"]] = r["total"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)  # nothing is known of the target: all weights are 1
    smooth = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return smooth(target) - smooth(total)


def _weigh(batches, ratios: np.ndarray):
    for batch in batches:
        sums = []
        for chunk in chunks(batch.column(1)):
            row, bucket = ngrams(chunk)
            sums.append(np.bincount(row, ratios[bucket], chunk.rows))
        weight = np.concatenate(sums) if sums else np.empty(0)
        noise = -np.log(-np.log((np.asarray(batch.column(2)).astype(np.float64) + 0.5) / 2.0**52))
        key = weight + noise
        bits = key.view(np.int64)
        rank = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))  # in the order of the keys
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(rank)], names=["id_", "log_weight", "gumbel_key", "rank_"])


def noise_bits(key: Column, seed: int) -> Column:
    """52 bits of a hash of the id and the seed."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("long")


def kth_largest(rows: DataFrame, rank: str, k: int) -> int | None:
    """The k-th largest 64-bit value, from histograms of 12 bits a round (at most 4096 counts reach the driver)."""
    if k <= 0:
        return None
    inside, shift = None, 64
    while shift > 0:
        shift = max(0, shift - 12)
        part = rows if inside is None else rows.where(F.shiftright(rank, inside[0]) == F.lit(inside[1]))
        hist = part.groupBy(F.shiftright(rank, shift).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("low"), F.max(rank).alias("high")).collect()
        for r in sorted(hist, key=lambda r: -r["b"]):
            if r["n"] >= k:
                if r["low"] == r["high"]:
                    return r["low"]
                inside = (shift, r["b"])
                break
            k -= r["n"]
        else:
            return min((r["low"] for r in hist), default=None)
    return inside[1]


def resample(docs: DataFrame, target_ids: DataFrame, share: float, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` for every row; ``kept`` marks the ``share`` of the rows with the
    largest keys.

    A null or empty text has no n-grams and so weight 1 (logarithm 0).  Rows that repeat an id and a text have one key
    and are kept together, also where that exceeds the share.  Without target documents all weights are 1 and the
    draw is uniform.  An empty table gives an empty result; other columns are ignored.
    """
    ratios = log_ratios(docs, target_ids, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].alias("text_"), noise_bits(docs[id_col], seed).alias("noise_"))
    scored = cut(rows.mapInArrow(partial(_weigh, ratios=ratios), "id_ long, log_weight double, gumbel_key double, rank_ long"))
    edge = kth_largest(scored, "rank_", round(share * scored.count()))
    kept = F.lit(False) if edge is None else F.col("rank_") >= F.lit(edge)
    return scored.select(F.col("id_").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"))


def target_share(labels: DataFrame, quality_col: str = "quality") -> float:
    """The share of good ones among labelled rows (without labels: all)."""
    r = labels.agg(F.avg((F.col(quality_col) == 1).cast("double"))).first()[0]
    return 1.0 if r is None else float(r)
