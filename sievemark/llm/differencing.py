"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut: full windows first, what is left into pieces of at most a quarter window.  Full
windows stand alone.  The other pieces are dealt to shards, and each shard is split into ``k`` windows of nearly equal
length: of all partial partitions the two with the largest imbalance are merged, the largest part of one with the
smallest of the other, until one is left.  ``k`` begins where the pieces would just fit and rises while a window
exceeds the capacity.

A window whose length is a power of two needs no padding.  So what ``k`` full windows would leave over is taken out
in pieces of a quarter window, each a window of its own; padding is then what separates the fullest window from the
mean.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cut, release

SHARD_PIECES = 4096


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _model(path: str):
    return _tokenizer(path).model


@lru_cache(1)
def _marks(path: str) -> re.Pattern:
    """Finds the strings that the file makes tokens of their own wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return re.compile("|".join(re.escape(t["content"]) for t in json.load(f).get("added_tokens", ())) or "(?!)")


@lru_cache(1)
def _known(path: str) -> tuple[dict[bytes, bytes], dict[str, bytes]]:
    """What a worker remembers: ids of stretches between white space, and of the words in them."""
    return {}, {}


#: Stretches of ASCII and of the letters of Latin-1: there lower case, composition and letters are beyond doubt.
_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The words of such a stretch in lower case, as the tokenizer file splits them.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: The letters that stand for the bytes of these letters in UTF-8: a byte that prints (U+00A1 and above, but not U+00AD)
#: stands for itself, the others are counted on from U+0100, where 33 below U+0080 come first.
_BYTES = {n: chr(n) if 0xA1 <= n != 0xAD else chr(0x100 + 34 + n - 0x80) if n <= 0xA0 else chr(0x100 + 67) for n in range(0x7F + 1, 0x100)}


class WordTokenizer:
    """Ids of a ``tokenizers`` file whose words never reach over white space, which it drops (that of
    :func:`default_tokenizer` is the kind), so that stretches between white space can be looked up: each is encoded
    once and remembered.  A plain one is split into words here and its words are merged by the model of the file, which
    takes a third of the time; all others go through the whole tokenizer.  Tests hold both against each other."""

    #: Stretches and words that a worker remembers (then all are forgotten), and their longest length.
    REMEMBERED = 600_000
    LONGEST = 64

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        known, words = _known(self.path)
        # Splits at space and U+0009 to U+000D alone; other white space stays inside a stretch, for the tokenizer.
        stretches = text.encode().split()
        try:
            return b"".join(map(known.__getitem__, stretches))
        except KeyError:
            pass
        if len(known) > self.REMEMBERED:
            known.clear()
        if len(words) > self.REMEMBERED:
            words.clear()
        rare: dict[bytes, bytes] = {}
        model, marks = _model(self.path), _marks(self.path)
        for w in set(stretches):
            if w not in known:
                (known if len(w) <= self.LONGEST else rare)[w] = self._encoded(w.decode(), words, model, marks)
        return b"".join([known[w] if w in known else rare[w] for w in stretches])

    def _encoded(self, stretch: str, words: dict[str, bytes], model, marks: re.Pattern) -> bytes:
        if not _PLAIN.fullmatch(stretch) or marks.search(stretch):
            return array("I", _tokenizer(self.path).encode(stretch, add_special_tokens=False).ids).tobytes()
        out = []
        for word in _WORD.findall(stretch.lower()):
            ids = words.get(word)
            if ids is None:
                merged = model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))
                ids = array("I", [t.id for t in merged]).tobytes()
                if len(word) <= self.LONGEST:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)


def default_tokenizer() -> WordTokenizer:
    import public_tokenizers as P

    return WordTokenizer(P.path("word_bpe_49k.json"))


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids."""
    full = total - total % capacity
    part = max(1, capacity // 4)
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(part, total - s)) for s in range(full, total, part)]


_PIECES = "id_ long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = ["id_", "start", "length", "ids_crc32", "doc_tokens"]


def _pieces(batches, tokenizer: WordTokenizer, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        out: list[list] = [[] for _ in _NAMES]
        texts = pc.fill_null(batch.column(1), "").to_pylist()
        for doc, ids in zip(batch.column(0).to_pylist(), map(tokenizer, texts)):
            ids += end
            total = len(ids) // 4
            for start, length in cut_points(total, capacity):
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                for column, value in zip(out, (doc, start, length, crc, total)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_NAMES)


def token_pieces(docs: DataFrame, tokenizer: WordTokenizer | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_, start, length, ids_crc32, doc_tokens`` for each piece of each document."""
    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    return rows.mapInArrow(partial(_pieces, tokenizer=tokenizer or default_tokenizer(), capacity=capacity, end_id=end_id), _PIECES)


# Differencing


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of ``sizes`` (all positive) in at most ``k`` groups of nearly equal sums.

    A partial partition has its nonempty parts by rising sum; parts that it does not list are empty.  Its imbalance
    is the largest sum less the smallest.
    """
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        *_, sums, parts = heapq.heappop(heap)
        *_, other, others = heapq.heappop(heap)
        if len(sums) < len(other):
            sums, parts, other, others = other, others, sums, parts
        meet = max(0, len(sums) + len(other) - k)
        if len(other) == 1:
            # One piece goes to the smallest part, or to an empty one.
            s, part = other[0] + (sums.pop(0) if meet else 0), others[0] + (parts.pop(0) if meet else [])
            at = bisect_right(sums, s)
            sums.insert(at, s)
            parts.insert(at, part)
        else:
            # The largest parts of one go to the smallest of the other; those that find an empty part stay as they are.
            for j in range(meet):
                sums[meet - 1 - j] += other[j]
                parts[meet - 1 - j] = parts[meet - 1 - j] + others[j]
            sums, parts = sums + other[meet:], parts + others[meet:]
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, parts = [sums[j] for j in order], [parts[j] for j in order]
        imbalance = sums[-1] - (sums[0] if len(sums) == k else 0)
        heapq.heappush(heap, (-imbalance, made, sums, parts))
        made += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The indices of ``sizes`` in windows of at most ``capacity``; full pieces stand alone, and so do pieces of a
    quarter window (if that is a power of two) that would begin another window for too little."""
    alone = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    quarter = max(1, capacity // 4)
    spare = [i for i in rest if sizes[i] == quarter][:3] if quarter & (quarter - 1) == 0 else []
    total = sum(sizes[i] for i in rest)
    room = 0  # that the windows must leave, in all
    while rest:
        # How many pieces stand alone, so that the windows of the others leave the least room that is enough.
        left, out = min((-(total - n * quarter + room) % capacity, n) for n in range(len(spare) + 1))
        kept = [i for i in rest if i not in spare[:out]]
        k = -(-(total - out * quarter + room) // capacity)
        groups = difference([sizes[i] for i in kept], k)
        over = max((sum(sizes[kept[j]] for j in g) for g in groups), default=0) - capacity
        if over <= 0:
            return alone + [[i] for i in spare[:out]] + [[kept[j] for j in g] for g in groups]
        room += left + max(1, over * k // 2)
    return alone


def _places(batches, capacity: int):
    me, made, held, count = TaskContext.get().partitionId(), 0, [], 0

    def placed(t: pa.Table):
        nonlocal made
        length = t.column(2).to_pylist()
        groups = windows(length, capacity)
        sequence, offset = [0] * len(length), [0] * len(length)
        for w, group in enumerate(groups):
            at = 0
            for i in group:
                sequence[i], offset[i] = (me << 32) + made + w, at
                at += length[i]
        made += len(groups)
        t = t.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return t.combine_chunks().to_batches()

    for batch in batches:
        held.append(batch)
        count += len(batch)
        while count >= SHARD_PIECES * 5 // 4:
            t = pa.Table.from_batches(held)
            yield from placed(t.slice(0, SHARD_PIECES))
            rest = t.slice(SHARD_PIECES)
            held, count = rest.to_batches(), len(rest)
    if count:
        yield from placed(pa.Table.from_batches(held))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``sequence_id, offset`` beside the columns of :func:`token_pieces`."""
    held = cut(pieces)
    # Dealt round-robin: shards of even size whatever the documents.  A task makes several shards where there are many.
    shards = max(1, round(held.count() / SHARD_PIECES))
    out = cut(held.repartition(min(shards, 20_000)).mapInArrow(partial(_places, capacity=capacity), _PIECES + ", sequence_id long, offset long"))
    release(held)
    return out


def pack_documents(docs: DataFrame, tokenizer: WordTokenizer | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece of each document.

    A null text counts as empty and is one piece with the end id alone.  Rows that repeat an id, or have a null id,
    are packed each on its own.  An empty table gives an empty result; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity).withColumnRenamed("id_", id_col)
