"""Semantic ranking: passages, windows, scores, and the combination with exact search."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CapabilityError
from ..functions.batches import by_text
from ..session import cut, release
from .budget import running_sum
from .ranges import greedy_dedupe, overlap_anti

PASSAGE_CHARACTERS, PASSAGE_OVERLAP = 1000, 160
#: Passages that a worker hands back at a time.
PASSAGES_AT_A_TIME = 1024


class Encoder(Protocol):
    """Vectors of texts.  No model comes with the engine; without an encoder semantic modes are unavailable.

    An encoder that reads only so many tokens has ``window_tokens`` and says with ``spans`` where the tokens of a text
    lie; longer passages are embedded in windows then.  ``encode`` gets the role apart and puts it before the text itself;
    what that takes of a window is ``role_tokens``.
    """

    dimension: int
    version: str

    def encode(self, texts: list[str], role: str) -> np.ndarray: ...


@lru_cache(1 << 17)
def _trigram(t: str) -> int:
    return int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")


class HashingEncoder:
    """A deterministic encoder for tests: hashed character trigrams.  It says nothing about meaning."""

    role_tokens = 0

    def __init__(self, dimension: int = 64, window_tokens: int | None = None):
        self.dimension, self.version, self.window_tokens = dimension, f"hashing-{dimension}", window_tokens

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Words stand for tokens here."""
        return [m.span() for m in re.finditer(r"\S+", text)]

    def encode(self, texts: list[str], role: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            t = f" {text.lower()} "
            h = np.fromiter(map(_trigram, map("".join, zip(t, t[1:], t[2:]))), np.uint64)
            at = (h % np.uint64(self.dimension)).astype(np.int64)
            row += np.bincount(at, np.where(h >> np.uint64(63), 1, -1), self.dimension)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def required(encoder: Encoder | None) -> Encoder:
    if encoder is None:
        raise CapabilityError("semantic search needs an encoder; none is configured", recovery="choose-capability")
    return encoder


def passage_bounds(text: str, size: int = PASSAGE_CHARACTERS, overlap: int = PASSAGE_OVERLAP) -> list[tuple[int, int]]:
    """Half-open passages of about ``size`` characters that end after a line feed in their second half if they can,
    and overlap by ``overlap``; the last reaches the end."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            feed = text.rfind("\n", at, end + 1)
            if feed > at + size // 2:
                end = feed + 1
        out.append((at, end))
        if end >= n:
            break
        at = max(at + 1, end - overlap)
    return out


def passages(sources: DataFrame, key: str = "path", size: int = PASSAGE_CHARACTERS, overlap: int = PASSAGE_OVERLAP, texts: bool = True) -> DataFrame:
    """``key, start, end, line`` and, with ``texts``, ``text``; where a passage begins depends on the one before, so Arrow
    batches do it, some texts and some passages at a time."""
    kind = sources.schema[key].dataType.simpleString()
    names = [key, "start", "end", "line", "text"][: 4 + texts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_text(batch, 1):
                rows, starts, ends, lines, found = [], [], [], [], []

                def made() -> pa.RecordBatch:
                    columns = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, ends, lines))]
                    return pa.RecordBatch.from_arrays([*columns, *([pa.array(found, pa.string())] if texts else [])], names=names)

                for row, t in enumerate(part.column(1).to_pylist()):
                    before, line = 0, 1
                    for a, b in passage_bounds(t or "", size, overlap):
                        line += t.count("\n", before, a)
                        before = a
                        rows.append(row)
                        starts.append(a)
                        ends.append(b)
                        lines.append(line)
                        if texts:
                            found.append(t[a:b])
                        if len(rows) >= PASSAGES_AT_A_TIME:
                            yield made()
                            rows, starts, ends, lines, found = [], [], [], [], []
                yield made()

    return sources.select(key, "text").mapInArrow(cut, f"{key} {kind}, start long, end long, line long" + ", text string" * texts)


def cache_key(text: Column, role: str, version: str = "") -> Column:
    """Content address of an embedding: of the encoder's version, the role and the text."""
    return F.sha2(F.concat(F.lit(f"{version}\0{role}\0" if version else role + "\0"), text), 256)


def window_bounds(text: str, encoder: Encoder, overlap: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of a passage that the encoder can read as a whole; all of it if it may be of any length.

    Windows overlap by a quarter, or by ``overlap`` tokens, and leave no character out: each begins where its first token
    does (the first at the start) and reaches to the token behind its last one.
    """
    most = getattr(encoder, "window_tokens", None)
    if most is None:
        return [(0, len(text))]
    spans = encoder.spans(text)
    size = max(1, most - getattr(encoder, "role_tokens", 0))
    if len(spans) <= size:
        return [(0, len(text))]
    tokens = token_windows(len(spans), size, size // 4 if overlap is None else overlap)
    return [(spans[a][0] if a else 0, spans[b][0] if b < len(spans) else len(text)) for a, b in tokens]


def windows(passages: DataFrame, encoder: Encoder, *keys: str) -> DataFrame:
    """``keys, window, text``: the windows of passages (``keys, text``); one pass without a shuffle."""
    kinds = ", ".join(f"`{k}` {passages.schema[k].dataType.simpleString()}" for k in keys)

    def cut_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*k, i, t[a:b]) for *k, t in part.itertuples(index=False) for i, (a, b) in enumerate(window_bounds(t, encoder))]
            yield pd.DataFrame(rows, columns=[*keys, "window", "text"])

    return passages.select(*keys, "text").mapInPandas(cut_up, f"{kinds}, window int, text string")


def embed(texts: DataFrame, encoder: Encoder, role: str = "passage", batch: int = 64) -> DataFrame:
    """``key, embedding`` of ``key, text``; each different key once, longest first within a batch of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.iloc[np.argsort(-part["text"].str.len().to_numpy(), kind="stable")]
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                vectors = encoder.encode(some["text"].tolist(), role)
                yield pd.DataFrame({"key": some["key"].to_numpy(), "embedding": [v.astype(np.float32) for v in vectors]})

    return texts.select("key", "text").dropDuplicates(["key"]).mapInPandas(run, "key string, embedding array<float>")


class EmbeddingCache:
    """Embeddings by content address, in a folder of any file system that Spark writes.

    Vectors are written to a folder of their own, and count from when a mark with its name exists: a write that is
    broken off, or made twice by a task that is tried again, leaves nothing that is read.  Two runs may write the same
    key; its vectors are equal, and one is taken.  ``prune`` writes what stays as one new folder, whose mark says which
    folders it stands for.  The driver sees the names of folders only.
    """

    _ROWS = "key string, embedding array<float>"

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _files(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def folders(self, kind: str) -> list[str]:
        """Folders of vectors or of uses that count: those with a mark, less those that another one stands for."""
        fs, path = self._files()
        marks = path(f"{self.root}/marks")
        names = [s.getPath().getName() for s in fs.listStatus(marks)] if fs.exists(marks) else []
        gone: set[str] = set()
        for name in names:
            if name.endswith(".instead"):
                lines = [r[0] for r in self.spark.read.text(f"{self.root}/marks/{name}").collect()]
                gone |= {x for x in lines if x}
        live = {n.removesuffix(".instead") for n in names}
        return sorted(n for n in live - gone if n.startswith(kind))

    def _commit(self, rows: DataFrame, kind: str, instead: list[str] | None = None) -> None:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        fs, path = self._files()
        if instead is None:
            fs.create(path(f"{self.root}/marks/{name}"), False).close()
            return
        # Written beside and renamed, so that a mark is there with all it says or not at all.
        beside = path(f"{self.root}/{name}.mark")
        out = fs.create(beside, False)
        out.write(bytearray(("\n".join(instead) + "\n").encode()))
        out.close()
        fs.rename(beside, path(f"{self.root}/marks/{name}.instead"))

    def vectors(self) -> DataFrame:
        """``key, embedding``; a key once."""
        found = [f"{self.root}/{n}" for n in self.folders("vectors")]
        if not found:
            return self.spark.createDataFrame([], self._ROWS)
        return self.spark.read.schema(self._ROWS).parquet(*found).dropDuplicates(["key"])

    def embedded(self, texts: DataFrame, encoder: Encoder, role: str = "passage") -> DataFrame:
        """``key, embedding`` of ``key, text``: what is missing is embedded and kept, then all is read from the cache."""
        every = cut(texts.dropDuplicates(["key"]))
        missing = cut(every.join(self.vectors().select("key"), "key", "left_anti"))
        if not missing.isEmpty():
            self._commit(embed(missing, encoder, role), "vectors")
        now = int(self.clock() * 1000)
        self._commit(every.select("key", F.lit(now).cast("long").alias("used_ms")), "uses")
        out = cut(self.vectors().join(every.select("key"), "key", "left_semi"))
        release(every, missing)
        return out

    def prune(self, max_bytes: int) -> None:
        """Keep the vectors used last, in at most ``max_bytes``."""
        vectors, uses = self.folders("vectors"), self.folders("uses")
        if not vectors:
            return
        used = self.spark.read.schema("key string, used_ms long").parquet(*[f"{self.root}/{n}" for n in uses]) if uses else self.spark.createDataFrame([], "key string, used_ms long")
        last = used.groupBy("key").agg(F.max("used_ms").alias("used_ms"))
        rows = self.vectors().join(last, "key", "left").withColumn("used_ms", F.coalesce("used_ms", F.lit(0).cast("long")))
        kept = cut(prune_cache(rows, max_bytes))
        self._commit(kept.select("key", "embedding"), "vectors", vectors)
        self._commit(kept.select("key", "used_ms"), "uses", uses)
        release(kept)
        # Readers that listed the old folders may still be at work; what no mark counts goes with the next pruning.
        fs, path = self._files()
        live = set(self.folders("vectors")) | set(self.folders("uses"))
        for status in fs.listStatus(path(self.root)):
            name = status.getPath().getName()
            if name.startswith(("vectors-", "uses-")) and name not in live | set(vectors) | set(uses) and not name.endswith(".mark") and self._old(status):
                fs.delete(status.getPath(), True)

    def _old(self, status) -> bool:
        """Whether a folder that no mark counts is no write that is still going on."""
        return self.clock() * 1000 - status.getModificationTime() > 3_600_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, in the order of the elements."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """``score`` beside the columns of ``vectors``; the query is a literal, so nothing is joined or shuffled."""
    return vectors.withColumn("score", dot(F.col(column), F.array(*[F.lit(float(x)) for x in query])))


def top_k(scored: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), *ties).limit(k)


def passage_scores(windows: DataFrame, *keys: str) -> DataFrame:
    """The best window of each passage."""
    return windows.groupBy(*keys).agg(F.max("score").alias("score"))


def mean_pool(windows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """``key, embedding``: the normalised sum of the windows of a key, in the order of positions."""
    parts = windows.select(key, F.posexplode(column).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    v = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("n_", norm).select(key, F.transform("v", lambda x: F.when(F.col("n_") > 0, x / F.col("n_")).otherwise(x)).alias("embedding"))


def ranking_score(score: Column, length: Column) -> Column:
    """The score less up to 0.02 for passages shorter than 500 characters."""
    return score - 0.02 * (1 - F.sqrt(F.least(length / 500.0, F.lit(1.0))))


def with_ranking_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("ranking_score", ranking_score(F.col("score"), F.col("end") - F.col("start")))


def rank(scored: DataFrame) -> DataFrame:
    """Passages by ranking score, then path and line."""
    return with_ranking_score(scored).orderBy(F.desc("ranking_score"), "path", "line")


def concept(sources: DataFrame, query: str, encoder: Encoder | None, limit: int | None = 50_000, cache: EmbeddingCache | None = None) -> DataFrame:
    """``path, start, end, line, text, score, ranking_score`` of the passages nearest to a query; without a limit of all, in no order.

    A passage that is longer than the encoder reads scores as its best window.  Each different window is embedded once;
    with a cache, only those that no run has embedded before.
    """
    encoder = required(encoder)
    p = passages(sources)
    q = encoder.encode([query], "query")[0].tolist()
    keyed = windows(p, encoder, "path", "start", "end").withColumn("key", cache_key(F.col("text"), "passage", encoder.version))
    texts = keyed.select("key", "text")
    vectors = embed(texts, encoder) if cache is None else cache.embedded(texts, encoder)
    best = passage_scores(cosine(keyed.select("path", "start", "end", "key").join(vectors, "key"), q), "path", "start", "end")
    scored = p.join(best, ["path", "start", "end"]).select("path", "start", "end", "line", "text", "score")
    return with_ranking_score(scored) if limit is None else rank(scored).limit(limit)


def hybrid(literal: DataFrame, ranked: DataFrame, limit: int = 3) -> DataFrame:
    """``tier, path, start, end, score``: exact ranges first, then the best concepts that overlap none of them.

    literal: ``path, start, end``; ranked: ``path, start, end, ranking_score``.  Concepts that overlap a better one
    under their path go as well.
    """
    free = overlap_anti(ranked.select("path", "start", "end", "ranking_score", (-F.col("ranking_score")).alias("rank")), literal.select("path", "start", "end"))
    best = greedy_dedupe(free).orderBy(F.desc("ranking_score"), "path", "start").limit(limit)
    exact = literal.select(F.lit(0).alias("tier"), "path", "start", "end", F.lit(None).cast("double").alias("score"))
    return exact.union(best.select(F.lit(1), "path", "start", "end", "ranking_score"))


def close_ranks(ranked: DataFrame, margin: float = 0.01) -> bool:
    """Whether the first two results are too close to tell apart."""
    two = [r[0] for r in ranked.orderBy(F.desc("ranking_score")).select("ranking_score").limit(2).collect()]
    return len(two) == 2 and two[0] - two[1] < margin


class Judge(Protocol):
    """Class and probability of candidates; off unless one is given."""

    classes: tuple[str, ...]

    def judge(self, query: str, texts: list[str]) -> list[tuple[str, float]]: ...


def judged_order(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Rows (``pos, class, probability``; null class: not judged) in their new order.

    The places of judged rows are filled by class, probability and place; the others stay where they are.
    """
    priority = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    judged = rows.where("class IS NOT NULL")
    # Running sums of ones number the rows by range partitions, so that no task sees them all.
    ones = judged.withColumn("one_", F.lit(1)).withColumn("first_", priority)
    places = running_sum(ones, "one_", ["pos"]).select("upto_", F.col("pos").alias("new_pos"))
    order = running_sum(ones, "one_", ["first_", F.desc("probability"), "pos"]).select("upto_", *rows.columns)
    return order.join(places, "upto_").drop("upto_").unionByName(rows.where("class IS NULL").withColumn("new_pos", F.col("pos")))


WINDOW_TOKENS, WINDOW_OVERLAP = 256, 64
JUDGE_CANDIDATES, JUDGE_BYTES = 8, 64 << 10


def token_windows(tokens: int, size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> list[tuple[int, int]]:
    """Half-open windows over the tokens of a passage that overlap; an encoder's vector of a passage is its best one."""
    step = size - overlap
    return [(a, min(tokens, a + size)) for a in range(0, max(1, tokens - overlap), step)] if tokens else []


def prune_cache(cache: DataFrame, max_bytes: int, used: str = "used_ms") -> DataFrame:
    """Cached vectors (``key, embedding, used_ms``) without those unused longest, in at most ``max_bytes``."""
    sized = cache.withColumn("bytes_", F.size("embedding") * 4 + F.length("key")).withColumn("age_", -F.col(used))
    return running_sum(sized, "bytes_", ["age_", "key"]).where(F.col("upto_") <= max_bytes).select(*cache.columns)


def judge_batches(texts: list[str], most: int = JUDGE_CANDIDATES, max_bytes: int = JUDGE_BYTES) -> list[list[int]]:
    """Candidates in groups of bounded number and size; one that is too large alone is in none."""
    out: list[list[int]] = []
    used = 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if n > max_bytes:
            continue
        if not out or len(out[-1]) == most or used + n > max_bytes:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out


def judge_candidates(judge: Judge, query: str, texts: list[str], retries: int = 1) -> tuple[list[tuple[str, float] | None], bool]:
    """Verdicts of the candidates (None: not judged), and whether all were.

    It works on the few rows of a page.  A batch that fails is halved, a single candidate is tried again; no candidate
    is ever dropped.
    """
    out: list[tuple[str, float] | None] = [None] * len(texts)
    todo = [(b, retries) for b in judge_batches(texts)]
    while todo:
        batch, left = todo.pop()
        try:
            found = judge.judge(query, [texts[i] for i in batch])
            if len(found) != len(batch) or any(c not in judge.classes or not 0 <= p <= 1 for c, p in found):
                raise ValueError("malformed verdicts")
            for i, v in zip(batch, found):
                out[i] = v
        except Exception:  # noqa: BLE001
            if len(batch) > 1:
                half = len(batch) // 2
                todo += [(batch[:half], left), (batch[half:], left)]
            elif left:
                todo.append((batch, left - 1))
    return out, all(v is not None for v in out)


def preview(both: DataFrame, literal: int = 3, most: int = 30) -> DataFrame:
    """Of combined results (``tier, ord``) the first exact ones and all concepts."""
    return both.where((F.col("tier") == 1) | (F.col("ord") <= literal)).orderBy("ord").limit(most)
