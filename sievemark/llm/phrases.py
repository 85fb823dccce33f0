"""Phrase collocations by generalised suffix automata of shards.

Texts are cut into pieces at punctuation and line ends; the words of one language, some documents at a time, are a
shard of bounded size.  A shard has an automaton of its pieces (:class:`SuffixAutomaton`) with bounded depth, whose
states enumerate substrings with the number of their end positions; these counts are added over all shards.

A frequent phrase has only frequent words and frequent shorter phrases in it.  So words are counted first, then pairs of
frequent words, then three words made of two frequent pairs, and the rest over what is left by then: nothing that could be
frequent is lost, however few of it a shard holds, and rare phrases are not counted for longer ones.  What is frequent comes back
to the shards as Bloom filters of fixed size, whatever the corpus; they can let rare ones through, which costs work and
changes no result.

To find the pairs and three words that may be frequent it is enough to count the buckets that their hashes fall in: a task adds
up those of its shards and hands them on sorted, as differences, some two bytes for each.  What falls in full buckets is
then counted under its text, added up in the task that found it and again over all tasks.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, remove, shared_dir
from .vectext import LOWER, U64, keys, mix, word_hashes

#: Words of a shard, about.
SHARD_WORDS = 500_000
#: Bytes of text that are taken apart at a time; a longer piece is taken whole.
SLICE_BYTES = 1 << 20
SALTS = 64
#: Bits of a filter as a power of two (8 MiB), and of the slices that tasks make of it.
FILTER_BITS, SLICE_BITS = 26, 17
#: Documents that a task takes at a time, of what takes ``BATCH_BYTES`` or somewhat more.
BATCH_DOCUMENTS, BATCH_BYTES = 1000, 2 << 20
#: Shards of a row group; a reader holds one, decoded.
GROUP_SHARDS = 4
#: Buckets as a power of two, and those of a part; of phrases, parts.
BUCKET_BITS, PART_BITS, PHRASE_PART_BITS = 28, 20, 8
#: Counts that a task adds up before it hands them on.
HELD_COUNTS = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_ODD = keys(1, 31)[0] | U64(1)


# Words and shards


def slices(data: np.ndarray):
    """Parts of about ``SLICE_BYTES`` that end where a piece ends."""
    a = 0
    while a < len(data):
        b = a + SLICE_BYTES
        while b < len(data):
            ends = np.flatnonzero(_BREAK[data[b : b + SLICE_BYTES]])
            if len(ends):
                b += int(ends[0])
                break
            b += SLICE_BYTES
        yield data[a:b]
        a = b


def joined(texts: pa.Array):
    """Some consecutive texts at a time, about ``SLICE_BYTES`` in all, as one: between texts a piece ends."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield "\n".join(texts.slice(a, b - a).to_pylist()).encode()
        a = b


def piece_words(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some text (A-Z in lower case), and which of them begin a piece."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[::2], flips[1::2]
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    begins = np.ones(len(starts), bool)
    begins[1:] = piece[1:] != piece[:-1]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])]), begins


_SHARD = "shard long, lang string, words array<string>, n array<long>, numbers binary"
_SHARD_NAMES = ["shard", "lang", "words", "n", "numbers"]


def _shard_row(shard: int, lang: str, words: pa.Array, n: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([lang]), one(words.cast(pa.string())), one(pa.array(n, pa.int64())), pa.array([numbers.astype(np.int32).tobytes()], pa.binary())], names=_SHARD_NAMES)


def _shards(batches, shard_words: int):
    held: dict[str, list[tuple[pa.DictionaryArray, np.ndarray]]] = {}
    me, made, count = TaskContext.get().partitionId(), 0, 0

    def rows():
        nonlocal made
        for lang, parts in held.items():
            coded = pa.chunked_array([words for words, _ in parts]).unify_dictionaries()
            codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
            begins = np.concatenate([b for _, b in parts])
            # Numbers from 1; a 0 stands before each piece.
            numbers = np.zeros(len(codes) + int(begins.sum()), np.int32)
            numbers[np.arange(len(codes)) + np.cumsum(begins)] = codes + 1
            words = coded.chunks[-1].dictionary
            yield _shard_row((me << 32) + made, lang, words, np.bincount(codes, minlength=len(words)), numbers)
            made += 1

    for batch in batches:
        langs = batch.column(1)
        for lang in langs.unique().to_pylist():
            for text in joined(batch.column(0).filter(pc.equal(langs, lang))):
                for part in slices(np.frombuffer(text, np.uint8)):
                    words, begins = piece_words(part)
                    if len(words):
                        held.setdefault(lang, []).append((words.dictionary_encode(), begins))
                        count += len(words)
                    if count >= shard_words:
                        yield from rows()
                        held, count = {}, 0
    yield from rows()


def without_rare(numbers: np.ndarray, kept: np.ndarray, size: int) -> np.ndarray:
    """The kept words under their new numbers from 1, in runs of two and more that a 0 ends."""
    new = np.zeros(size + 1, np.int32)
    new[kept + 1] = np.arange(1, len(kept) + 1)
    numbers = np.concatenate(([0], new[numbers], [0])).astype(np.int32)
    numbers[1:-1][(numbers[:-2] == 0) & (numbers[2:] == 0)] = 0
    return numbers[1:][(numbers[1:] > 0) | (numbers[:-1] > 0)]


# Filters


def places(hashes: np.ndarray) -> np.ndarray:
    """Two bits of a filter for each hash."""
    h = mix(hashes)
    return np.stack((h >> U64(64 - FILTER_BITS), h & U64((1 << FILTER_BITS) - 1))).astype(np.int64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes)
    return ((bits[at >> 3] >> (at & 7)) & 1).all(axis=0)


def _positions(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(places(batch.column(0).to_numpy().astype(U64)).ravel())], names=["place"])


def _bits(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column(1).to_numpy()
        for part in np.unique(at >> SLICE_BITS).tolist():
            bits = held.setdefault(part, np.zeros(1 << SLICE_BITS - 3, np.uint8))
            own = at[at >> SLICE_BITS == part] & ((1 << SLICE_BITS) - 1)
            np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["part", "bits"])


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of a table of one column of hashes; slices of it are made by tasks, and put together here."""
    at = hashes.mapInArrow(_positions, "place long").select(F.shiftright("place", SLICE_BITS).alias("part"), "place").repartition("part")
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    width = 1 << SLICE_BITS - 3
    for row in at.mapInArrow(_bits, "part long, bits binary").toLocalIterator():
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return out


# Hashes


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    texts = words.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    salt = word_hashes(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))[0]
    return word_hashes(np.frombuffer(texts.buffers()[2], np.uint8), offsets[:-1], offsets[1:]) ^ salt


def _hashed(batches):
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            words = batch.column(1).filter(pc.equal(batch.column(0), lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(_hashes(words, lang).astype(np.int64))], names=["lang", "word", "hash"])


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


def _frequent(batches, filters: dict):
    """``lang, words, hashes, numbers`` of each shard without the words that their filter tells to be rare."""
    for batch in batches:
        for i in range(len(batch)):
            lang, words = batch.column(1)[i].as_py(), batch.column(2)[i].values
            h = _hashes(words, lang)
            kept = np.flatnonzero(may_hold(filters[1].value, h))
            numbers = without_rare(np.frombuffer(batch.column(3)[i].as_buffer(), np.int32), kept, len(words))
            if len(numbers):
                yield lang, words.take(pa.array(kept)), h[kept], numbers


# Automata


class SuffixAutomaton:
    """The substrings of up to ``depth`` words of some pieces, as states of a suffix automaton.

    It is built by length, over all places at once.  A substring of length ``m`` is its transition (``head``, the substring
    without its last word, and that word) and its ``tail``, the substring without its first word, to which a step of a suffix
    link leads.  Substrings with the same end positions are one state: a substring and its tail are, if they occur
    equally often.  ``count``, ``longest``, ``shortest`` and ``link`` (-1 at the root) are those of the states.
    """

    def __init__(self, numbers: np.ndarray, hashes: np.ndarray, depth: int, may=lambda m, hashes: np.ones(len(hashes), bool)):
        """``hashes`` are those of the words; ``may`` says of hashes of substrings of ``m`` words which to go on with."""
        size = len(hashes)
        words = np.flatnonzero(numbers > 0)
        # node[p] is the number, by length, of the substring that begins at place p, or -1.
        node = np.full(len(numbers) + 1, -1, np.int64)
        node[words] = numbers[words] - 1
        self.head, self.tail, self.last = [None], [None], [np.arange(size)]
        self.hashes, self._found = [hashes], [np.bincount(node[words], minlength=size)]
        places = words
        for m in range(2, depth + 1):
            places = places[node[places + 1] >= 0]
            wide = max(1, len(self.last[-1]))
            kinds, kind = np.unique(node[places] * wide + node[places + 1], return_inverse=True)
            head, tail = kinds // wide, kinds % wide
            last = self.last[-1][tail]
            h = pair_hashes(self.hashes[-1][head], hashes[last])
            good = may(m, h)
            number = np.cumsum(good) - 1
            for name, values in (("head", head), ("tail", tail), ("last", last), ("hashes", h)):
                getattr(self, name).append(values[good])
            places, kind = places[good[kind]], kind[good[kind]]
            self._found.append(np.bincount(number[kind], minlength=int(good.sum())))
            node[:] = -1
            node[places] = number[kind]
        self._states(depth)

    def _states(self, depth: int) -> None:
        state = [np.full(len(f), -1, np.int64) for f in self._found]
        longest, shortest, count, made = [], [], [], 0
        for m in range(depth, 0, -1):
            own = np.flatnonzero(state[m - 1] < 0)
            state[m - 1][own] = made + np.arange(len(own))
            made += len(own)
            longest.append(np.full(len(own), m))
            shortest.append(np.full(len(own), m))
            count.append(self._found[m - 1][own])
            if m > 1:
                # A tail with as many end positions belongs to the state of the longer substring.
                same = self._found[m - 1] == self._found[m - 2][self.tail[m - 1]]
                state[m - 2][self.tail[m - 1][same]] = state[m - 1][same]
        self.state, self.longest, self.count = state, np.concatenate(longest), np.concatenate(count)
        self.shortest, self.link = np.concatenate(shortest), np.full(made, -1, np.int64)
        for m in range(depth, 1, -1):
            self.shortest[state[m - 1]] = np.minimum(self.shortest[state[m - 1]], m)
            leaves = state[m - 2][self.tail[m - 1]] != state[m - 1]
            self.link[state[m - 1][leaves]] = state[m - 2][self.tail[m - 1][leaves]]
        self.shortest[state[0]] = 1

    def substrings(self, words: pa.Array, least: int = 2):
        """``(length, texts, counts)`` of all substrings of ``least`` words and more, by length."""
        texts = words
        for m in range(2, len(self.state) + 1):
            texts = pc.binary_join_element_wise(texts.take(pa.array(self.head[m - 1])), words.take(pa.array(self.last[m - 1])), pa.scalar(" ", texts.type))
            if m >= least:
                yield m, texts, self.count[self.state[m - 1]]


def _may(filters: dict):
    return lambda m, hashes: may_hold(filters[m].value, buckets(hashes)) if m in filters else np.ones(len(hashes), bool)


# Buckets


def buckets(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U64(64 - BUCKET_BITS)


def encoded(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places in a part, and what is counted there; :func:`decoded` gives them back."""
    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()
    return pa.compress(planes(np.diff(at, prepend=0), "<u4") + planes(n, "<i8"), codec="zstd", asbytes=True)


def decoded(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=12 * size, codec="zstd"), np.uint8)
    values = lambda x, kind: np.ascontiguousarray(x.reshape(-1, size).T).view(kind).ravel()
    return np.cumsum(values(raw[: 4 * size], "<u4"), dtype=np.int64), values(raw[4 * size :], "<i8")


def _bucket_counts(batches, filters: dict, m: int, least: int):
    """``part, size, counts``: what the buckets of the substrings of ``m`` words get from a task whose parts may be
    frequent; more than ``least`` counts as ``least``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows():
        at, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at, n = at[first], np.minimum(np.add.reduceat(n, first), least)
        parts, begins = np.unique(at >> PART_BITS, return_index=True)
        ends = np.append(begins[1:], len(at))
        counts = [encoded(at[a:b] & ((1 << PART_BITS) - 1), n[a:b]) for a, b in zip(begins, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(ends - begins), pa.array(counts, pa.binary())], names=["part", "size", "counts"])

    size = 0
    for _, _, h, numbers in _frequent(batches, filters):
        a = SuffixAutomaton(numbers, h, m, _may(filters))
        if len(a.hashes[-1]):
            held.append((buckets(a.hashes[-1]).astype(np.int64), a.count[a.state[-1]].astype(np.int64)))
            size += len(held[-1][0])
        if size >= HELD_COUNTS:
            yield from rows()
            held, size = [], 0
    if held:
        yield from rows()


def _full(batches, least: int):
    """The buckets that get ``least`` and more, from the counts of all tasks sorted by part."""
    now, sums = None, np.zeros(1 << PART_BITS, np.int64)

    def row():
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums >= least) + (now << PART_BITS))], names=["bucket"])

    for batch in batches:
        for part, size, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    yield row()
                now = part
                sums[:] = 0
            at, n = decoded(size, counts)
            sums[at] += n
    if now is not None:
        yield row()


# Phrases


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["part", "phrase", "m"], use_threads=False).aggregate([("n", "sum")])
    return sums.rename_columns(["part", "phrase", "m", "n"])


_PARTS = "lang string, part long, phrases array<string>, m array<int>, n array<long>"


def _phrases(batches, filters: dict, depth: int):
    """The counts of a task, a row for the phrases of a language whose hashes begin alike."""
    held: dict[str, list[pa.Table]] = {}

    def rows():
        for lang, tables in held.items():
            sums = _added(tables).sort_by("part").combine_chunks()
            parts, begins = np.unique(sums["part"].to_numpy(), return_index=True)
            ends = pa.array(np.append(begins, len(sums)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(sums[c].chunks)) for c in ("phrase", "m", "n")]
            for a in range(0, len(parts), 16):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts[a : a + 16]), pa.string()), pa.array(parts[a : a + 16]), *(x.slice(a, 16) for x in lists)], names=["lang", "part", "phrases", "m", "n"])

    size = 0
    for lang, words, h, numbers in _frequent(batches, filters):
        automaton = SuffixAutomaton(numbers, h, depth, _may(filters))
        for m, texts, n in automaton.substrings(words):
            if len(n):
                part = (automaton.hashes[m - 1] >> U64(64 - PHRASE_PART_BITS)).astype(np.int64)
                held.setdefault(lang, []).append(pa.table({"part": part, "phrase": texts, "m": pa.array(np.full(len(n), m, np.int32)), "n": pa.array(n, pa.int64())}))
                size += len(n)
        if size >= HELD_COUNTS:
            # What is left once they are added up decides.
            held = {lang: [_added(tables)] for lang, tables in held.items()}
            size = sum(len(tables[0]) for tables in held.values())
            if 2 * size >= HELD_COUNTS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _summed(batches, least: int):
    """``lang, phrase, m, a`` of the phrases that occur ``least`` times, from the rows of all tasks sorted by language and part."""
    now, held, size = None, [], 0

    def rows():
        sums = _added(held)
        sums = sums.filter(pc.greater_equal(sums["n"], least))
        sums = sums.add_column(0, "lang", pa.array([now[0]] * len(sums), pa.string()))
        yield from sums.select(["lang", "phrase", "m", "n"]).rename_columns(["lang", "phrase", "m", "a"]).to_batches(10_000)

    for batch in batches:
        for i in range(len(batch)):
            own = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if own != now:
                if held:
                    yield from rows()
                now, held, size = own, [], 0
            phrases, m, n = (batch.column(c)[i].values for c in range(2, 5))
            held.append(pa.table({"part": np.full(len(n), own[1], np.int64), "phrase": phrases, "m": m, "n": n}))
            size += len(n)
            if size >= HELD_COUNTS:
                held = [_added(held)]
                size = len(held[0]) // 2
    if held:
        yield from rows()


# Over all shards


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int):
    """Arrow batches of so many rows, or of somewhat more than ``size`` bytes, for what is computed meanwhile."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def frequent_phrases(docs: DataFrame, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, m, a`` of all phrases of 1 to ``depth`` words that occur ``least`` times, and ``lang, total``: the
    words of each language.  Both are settled."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(docs[lang_col], F.lit("und")).alias("lang"))
    with batches_of(spark, BATCH_DOCUMENTS, BATCH_BYTES):
        made = rows.mapInArrow(partial(_shards, shard_words=shard_words), _SHARD)
        made.write.option("compression", "zstd").option("parquet.block.row.count.limit", str(GROUP_SHARDS)).parquet(base)
        shards = spark.read.schema(_SHARD).parquet(base)
        coded = shards.select("shard", "lang", "words", "numbers")

        totals = cut(shards.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)).alias("total")))
        counted = shards.select("lang", F.explode(F.arrays_zip("words", "n")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.n").alias("n"))
        words = cut(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
        hashed = words.select("lang", "phrase").mapInArrow(_hashed, "lang string, word string, hash long")
        filters = {1: spark.sparkContext.broadcast(bloom(hashed.select("hash")))}
        for m in range(2, min(3, depth) + 1):
            of_tasks = coded.mapInArrow(partial(_bucket_counts, filters=dict(filters), m=m, least=least), "part long, size long, counts binary")
            full = of_tasks.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_full, least=least), "bucket long")
            filters[m] = spark.sparkContext.broadcast(bloom(full))
        every = words.select("lang", "phrase", F.lit(1).alias("m"), "a")
        if depth > 1:
            found = coded.mapInArrow(partial(_phrases, filters=filters, depth=depth), _PARTS).repartition("lang", "part").sortWithinPartitions("lang", "part")
            every = every.union(found.mapInArrow(partial(_summed, least=least), "lang string, phrase string, m int, a long"))
        phrases = cut(every)
    release(words)
    remove(spark, base)
    for held in filters.values():
        held.destroy()
    return phrases, totals


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A candidate has 2 to ``depth`` words and occurs ``least`` times at least.  Its score is that of the weakest cut into two
    parts, floor(1000 * a * n / (l * r)); of equally weak ones the first counts.  It is dropped if a longer candidate that
    contains it occurs in ``percent`` per cent of its places or more.  Counts never rise from a phrase to one that
    contains it, so the longer ones by one word decide: those whose suffix link leads to it, and their mirror
    image, those that go on from it.

    A null text counts as empty, a null language as ``und``.  Every row counts, repeated ones too.  An empty table, or
    one without frequent phrases, gives an empty result; other columns are ignored.
    """
    phrases, totals = frequent_phrases(docs, least, depth, lang_col, text_col, shard_words)
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    candidates = phrases.where("m > 1").withColumn("w", F.split("phrase", " "))
    longer = candidates.where("m > 2").select("lang", F.explode(F.array(part(F.lit(2), F.col("m") - 1), part(F.lit(1), F.col("m") - 1))).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(percent) * F.col("a")))

    cuts = kept.select("lang", "phrase", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    of = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    counted = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    counted = counted.join(totals.withColumnRenamed("total", "n"), "lang")
    scored = counted.withColumn("score", F.expr("CAST((1000BD * CAST(a AS DECIMAL(38,0)) * n) div (CAST(l AS DECIMAL(38,0)) * r) AS LONG)"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Best of each part of a language first, so that a large language is not one task.
    some = weakest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = cut(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    release(phrases, totals)
    return out
