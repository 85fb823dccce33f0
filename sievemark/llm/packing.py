"""Packing token sequences with a grouping genetic algorithm on islands.

Documents are tokenised and cut; the pieces shorter than a sequence go to shards of bounded size.  Each shard is
evolved on several islands.  A packing is a grouping of pieces into bins; crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold their pieces a second time, and best-fits the pieces that this
displaces.  Between epochs the best packing of each island migrates to the next island of its shard.  An island that
has reached the lower bound (total length over capacity, rounded up) stops.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SHARD_PIECES = 16384
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 8


@lru_cache(1)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _marks(path: str) -> tuple[str, ...]:
    """The strings that the file makes tokens of their own wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


#: A run of white space (Unicode's) that the matcher of tiktoken would need a deep stack for.
_LONG_GAP = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class BpeTokenizer:
    """Ids of a ``tokenizers`` file, special tokens in a text included (``add_special_tokens=False`` adds none).

    With ``ranks`` (the same vocabulary as tiktoken ranks) they are computed by tiktoken, which gives the same ids
    several times as fast: for texts without special tokens, and with very long white space taken out first, as its
    matcher fails there.  ``pattern`` must be one of those that end a word where white space begins, and give the last
    character of white space to the word behind it.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.ranks, self.pattern = path, ranks, pattern

    def __call__(self, text: str) -> list[int]:
        if not self.ranks or any(mark in text for mark in _marks(self.path)):
            return _tokenizer(self.path).encode(text, add_special_tokens=False).ids
        coder = _encoding(self.ranks, self.pattern)
        out, at = [], 0
        for gap in _LONG_GAP.finditer(text) if len(text) >= 4096 else ():
            # The run without its last character is one piece of its own; at the end of the text, all of it is.
            stop = gap.end() - (gap.end() < len(text))
            out += coder.encode_ordinary(text[at : gap.start()])
            out += coder._core_bpe.encode_single_piece(text[gap.start() : stop].encode())
            at = stop
        return out + coder.encode_ordinary(text[at:]) if at else coder.encode_ordinary(text)


def default_tokenizer() -> BpeTokenizer:
    import public_tokenizers as P

    return BpeTokenizer(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


# Cutting into pieces


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: only the first may be shorter than ``capacity``."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


_PIECES = "id_ long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, tokenizer: BpeTokenizer, capacity: int, end_id: int, with_ids: bool):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*tokenizer(text or ""), end_id], "<u4")
            for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                part = ids[start : start + length]
                for column, value in zip(out, (doc, k, start, length, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None)):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        n = 6 if with_ids else 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds)], names=["id_", "piece", "start", "length", "ids_crc32", "ids"][:n])


def token_pieces(docs: DataFrame, tokenizer: BpeTokenizer | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_, piece, start, length, ids_crc32`` (and ``ids``) for each piece of each document."""
    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    run = partial(_pieces, tokenizer=tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id, with_ids=with_ids)
    return rows.mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


# The genetic algorithm, on the lengths of one shard


def best_fit(order, sizes, room: list[int], capacity: int) -> dict[int, int]:
    """Put pieces into the fullest open bin that takes them; ``room`` (free space by bin) grows by new bins."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            free[r].append(b)
            mask |= 1 << r
    put = {}
    for i in order:
        size = sizes[i]
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        put[i] = b
        r -= size
        room[b] = r
        if r > 0:
            free[r].append(b)
            mask |= 1 << r
    return put


class Packing:
    """``bin_of`` for each piece, and the load of each bin."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray):
        _, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.bins = int(self.bin_of.max()) + 1 if len(bin_of) else 0
        self.load = np.bincount(self.bin_of, sizes, self.bins).astype(np.int64)

    def fitness(self, capacity: int) -> tuple[int, float]:
        return self.bins, -float(((self.load / capacity) ** 2).mean()) if self.bins else 0.0


def _exchanged(bin_of: np.ndarray, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Put loose pieces, largest first, in place of smaller ones where a bin gets fuller by it; the pieces that are
    loose then.  ``bin_of`` is changed.  Each exchange fills a bin by at least one more, so there is an end."""
    held = np.ones(len(bin_of), bool)
    held[loose] = False
    room = capacity - np.bincount(bin_of[held], sizes[held], int(bin_of.max()) + 1).astype(np.int64)
    # Full bins take no part, and stay full.
    near = np.flatnonzero(held & (room[bin_of] > 0))
    bins, size = bin_of[near], sizes[near]
    spare = room[bins]
    todo = sorted(loose.tolist(), key=lambda i: -sizes[i])
    out, k = [], 0
    while k < len(todo):
        i = todo[k]
        k += 1
        gain = sizes[i] - size
        gain[gain > spare] = 0
        j = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[j] <= 0:
            out.append(i)
            continue
        todo.append(int(near[j]))
        bin_of[i] = bins[j]
        spare[bins == bins[j]] -= gain[j]
        near[j], size[j] = i, sizes[i]
    return np.array(out, np.int64)


def _refill(bin_of: np.ndarray, loose: np.ndarray, sizes: np.ndarray, size_list: list[int], capacity: int, rng) -> Packing:
    """Best-fit the loose pieces, largest first, into the other bins; first they take the place of smaller pieces in
    bins that this fills better, which leaves smaller pieces to fit."""
    bin_of = bin_of.copy()
    if 0 < len(loose) < len(bin_of):
        loose = _exchanged(bin_of, loose, sizes, capacity)
    held = np.ones(len(bin_of), bool)
    held[loose] = False
    used, again = np.unique(bin_of[held], return_inverse=True)
    bin_of[held] = again
    room = (capacity - np.bincount(again, sizes[held], len(used)).astype(np.int64)).tolist()
    jitter = rng.random(len(loose)) * rng.choice([0.0, 0.0, 3.0])
    order = loose[np.argsort(-(sizes[loose] + jitter), kind="stable")].tolist()
    put = best_fit(order, size_list, room, capacity)
    bin_of[list(put)] = list(put.values())
    return Packing(bin_of, sizes)


def crossover(a: Packing, b: Packing, sizes: np.ndarray, size_list: list[int], capacity: int, rng) -> Packing:
    """``a`` with some of the best-filled bins of ``b`` injected whole."""
    want = max(1, int(b.bins * rng.uniform(0.1, 0.5)))
    full = np.argsort(-b.load + rng.random(b.bins), kind="stable")[: 2 * want]
    chosen = np.zeros(b.bins, bool)
    chosen[rng.choice(full, min(want, len(full)), replace=False)] = True
    injected = chosen[b.bin_of]
    doomed = np.zeros(a.bins, bool)
    doomed[a.bin_of[injected]] = True
    child = np.where(injected, a.bins + b.bin_of, a.bin_of)
    loose = np.flatnonzero(doomed[a.bin_of] & ~injected)
    return mutate(_refill(child, loose, sizes, size_list, capacity, rng), sizes, size_list, capacity, rng)


def mutate(p: Packing, sizes: np.ndarray, size_list: list[int], capacity: int, rng) -> Packing:
    """Dissolve the worst-filled bin and a few others."""
    gone = np.zeros(p.bins, bool)
    gone[np.argmin(p.load)] = True
    gone[rng.integers(0, p.bins, min(p.bins, 3 + p.bins // 50))] = True
    return _refill(p.bin_of, np.flatnonzero(gone[p.bin_of]), sizes, size_list, capacity, rng)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The bin of each piece after some generations; ``elites`` are packings to begin with."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    rng, size_list = np.random.default_rng(seed), sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    pool = [Packing(e, sizes) for e in elites]
    every = np.arange(n)
    if not pool:
        pool.append(_refill(np.zeros(n, np.int64), every, sizes, size_list, capacity, np.random.default_rng(0)))

    def best() -> Packing:
        return min(pool, key=lambda p: p.fitness(capacity))

    if best().bins > least:
        while len(pool) < population:
            order = np.argsort(-(sizes * rng.uniform(0.9, 1.1, n)), kind="stable")
            put = best_fit(order.tolist(), size_list, [], capacity)
            start = np.empty(n, np.int64)
            start[list(put)] = list(put.values())
            pool.append(Packing(start, sizes))
    for _ in range(generations):
        if best().bins <= least:
            break
        ranked = sorted(pool, key=lambda p: p.fitness(capacity))
        children = []
        for k in range(max(1, population // 2)):
            a, b = ranked[0] if k == 0 else ranked[rng.integers(len(ranked))], ranked[rng.integers(len(ranked))]
            children.append(crossover(a, b, sizes, size_list, capacity, rng))
        pool = sorted(ranked + children, key=lambda p: p.fitness(capacity))[:population]
    return best().bin_of


# Shards, islands and migration


def _shards(batches, capacity: int):
    names = ["shard", "id_", "piece", "start", "length", "ids_crc32"]
    me, made, held = TaskContext.get().partitionId(), 0, []

    def row(t: pa.Table):
        nonlocal made
        out = pa.RecordBatch.from_arrays(
            [pa.array([me << 24 | made], pa.int64()), *(pa.array([t.column(c).combine_chunks().to_pylist()], pa.list_(t.schema.field(c).type)) for c in range(5))], names=names
        )
        made += 1
        return out

    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        while count >= SHARD_PIECES * 5 // 4:
            t = pa.Table.from_batches(held)
            yield row(t.slice(0, SHARD_PIECES))
            rest = t.slice(SHARD_PIECES)
            held, count = rest.to_batches(), len(rest)
    if count:
        yield row(pa.Table.from_batches(held))


def _generations(pieces: int) -> int:
    """A small shard is searched for longer: a generation takes time in proportion to its pieces."""
    return min(100, GENERATIONS * max(1, SHARD_PIECES // (2 * max(1, pieces))))


def _evolve(batches, capacity: int, epoch: int):
    for batch in batches:
        for shard, island, lengths, *old in zip(*(c.to_pylist() for c in batch.columns)):
            sizes = np.array([x for x in lengths if x < capacity], np.int64)
            elites = [np.array(e, np.int64) for e in old if e is not None]
            bin_of = evolve(sizes, capacity, hash((shard, island, epoch)) & 0xFFFFFFFF, elites, generations=_generations(len(sizes)))
            packing = Packing(bin_of, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([packing.bins], pa.int64()), pa.array([-packing.fitness(capacity)[1]], pa.float64()), pa.array([packing.bin_of.tolist()], pa.list_(pa.int32()))],
                names=["shard", "island", "bins", "fill", "elite"],
            )


_ISLAND = "shard long, island int, bins long, fill double, elite array<int>"


def _places(batches, capacity: int):
    for batch in batches:
        for shard, ids, piece, start, length, crc, elite in zip(*(c.to_pylist() for c in batch.columns)):
            sizes = np.array(length, np.int64)
            bin_of = np.empty(len(sizes), np.int64)
            part = sizes < capacity
            bin_of[part] = elite
            used = int(bin_of[part].max()) + 1 if part.any() else 0
            bin_of[~part] = used + np.arange(int((~part).sum()))
            order = np.argsort(bin_of, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.concatenate(([True], np.diff(bin_of[order]) != 0))
            offset = np.empty(len(sizes), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array((shard << 16) + bin_of), pa.array(offset)],
                names=["id_", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def pack(pieces: DataFrame, capacity: int = 1024, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``sequence_id, offset`` beside the columns ``id_, piece, start, length, ids_crc32`` of ``pieces``."""
    pieces = cut(pieces)
    n = pieces.count()
    shards = max(1, round(n / SHARD_PIECES))
    listed = "shard long, id_ array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"
    # Dealt round-robin: shards of even size whatever the keys.  A task makes several shards where there are many.
    held = cut(pieces.repartition(min(shards, 20_000)).mapInArrow(partial(_shards, capacity=capacity), listed))
    isles = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "length").repartition("shard", "island")
    state = cut(isles.mapInArrow(partial(_evolve, capacity=capacity, epoch=0), _ISLAND))
    for epoch in range(1, epochs):
        # The elite of an island travels to the next one; a shard has a row for each island.
        came = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("came"))
        own = state.select("shard", "island", "elite").join(came, ["shard", "island"])
        state = cut(isles.join(own, ["shard", "island"]).select("shard", "island", "length", "elite", "came").mapInArrow(partial(_evolve, capacity=capacity, epoch=epoch), _ISLAND))
    best = state.groupBy("shard").agg(F.min_by("elite", F.struct("bins", -F.col("fill"), "island")).alias("elite"))
    placed = held.join(best, "shard").select("shard", "id_", "piece", "start", "length", "ids_crc32", "elite")
    return placed.mapInArrow(partial(_places, capacity=capacity), _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: BpeTokenizer | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    A null text counts as empty and is one piece with the end id alone.  Rows that repeat an id, or have a null id,
    are packed each on its own.  An empty table gives an empty result; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, False, id_col, text_col), capacity).withColumnRenamed("id_", id_col)
