"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after each run of white space became one space.  Length and content hash deal the
texts to partitions; there full byte strings go into a compressed radix trie whose terminal nodes hold the smallest
identifier, so that equality is decided on bytes, never on a hash.  The same trie runs before the shuffle, which
leaves one row for each text and input partition however many copies there are.  A trie that outgrows its budget
spills its largest subtree to the task's scratch space and goes on; spilled subtrees are then merged one by one.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, one_space, packed, unpacked

#: Bytes of keys and nodes that a trie may hold in one task.
TRIE_BYTES = 64 << 20
_NODE_BYTES = 400
_BATCH = 2000


class _Node:
    __slots__ = ("kids", "label", "value", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value, self.spill = label, {}, None, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def _merge(x, y):
    """Values are (smallest id or None, rows with that id, rows)."""
    if x is None:
        return y
    if y[0] is None or (x[0] is not None and x[0] < y[0]):
        low, many = x[0], x[1] + (y[1] if x[0] == y[0] else 0)
    elif x[0] is None or y[0] < x[0]:
        low, many = y[0], y[1]
    else:
        low, many = x[0], x[1] + y[1]
    return low, many, x[2] + y[2]


class PatriciaTrie:
    """Byte strings with merged values in a compressed radix trie of bounded memory."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held, self.spilled = _Node(b""), budget, 0, []

    def insert(self, key: bytes, value: tuple) -> None:
        node, at, end = self.root, 0, len(key)
        while True:
            if node.spill is not None:
                pickle.dump((key, value), node.spill)
                return
            if at == end:
                node.value = _merge(node.value, value)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = _Node(key[at:])
                leaf.value = value
                node.kids[key[at]] = leaf
                self.held += end - at + _NODE_BYTES
                break
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            n = _shared(kid.label, key, at)
            fork = _Node(kid.label[:n])
            kid.label = kid.label[n:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            self.held += _NODE_BYTES
            node, at = fork, at + n
        if self.held > self.budget:
            self._spill()

    @staticmethod
    def _below(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None:
                yield prefix, node.value
            stack += [(k, prefix + k.label) for k in node.kids.values()]

    @staticmethod
    def _weight(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + _NODE_BYTES
            stack += n.kids.values()
        return total

    def _spill(self) -> None:
        """Move the heaviest subtrees under the first fork out, until half of the budget is free."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.value is None:
            (kid,) = node.kids.values()
            if kid.spill is not None:
                return
            node, prefix = kid, prefix + kid.label
        for weight, first in sorted(((self._weight(k), b) for b, k in node.kids.items() if k.spill is None), reverse=True):
            if self.held <= self.budget // 2:
                break
            kid = node.kids[first]
            if not kid.kids:
                continue  # a single text does not shrink
            kid.spill = tempfile.TemporaryFile()
            for entry in self._below(kid, prefix + kid.label):
                pickle.dump(entry, kid.spill)
            self.spilled.append(kid.spill)
            # From here on whatever starts like this subtree goes to its file.
            kid.kids, kid.value, kid.label = {}, None, kid.label[:1]
            self.held -= weight

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """All texts with their merged values; empties the trie."""
        yield from self._below(self.root, b"")
        self.root, self.held = _Node(b""), 0
        files, self.spilled = self.spilled, []
        for f in files:
            f.seek(0)
            part = PatriciaTrie(self.budget)
            while True:
                try:
                    key, value = pickle.load(f)
                except EOFError:
                    break
                part.insert(key, value)
            f.close()
            yield from part.items()


_LOCAL = "len_ long, hash_ long, body_ binary, low_ long, many_ long, n_ long"
_OWNERS = "sha_ string, keep_ long, many_ long, n_ long"


def _local(batches):
    """Merge copies inside one input partition; a full trie is handed on and begun anew."""
    schema = pa.schema([("len_", pa.int64()), ("hash_", pa.int64()), ("body_", pa.binary()), ("low_", pa.int64()), ("many_", pa.int64()), ("n_", pa.int64())])

    def flush(trie, hashes):
        rows = []
        for key, (low, many, n) in trie.items():
            rows.append((len(key), hashes[key], key, low, many, n))
            if len(rows) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    trie, hashes = PatriciaTrie(1 << 60), {}
    for batch in batches:
        for doc, h, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            hashes.setdefault(key, h)
            trie.insert(key, (doc, 1, 1))
            if trie.held > TRIE_BYTES // 2:
                yield from flush(trie, hashes)
                trie, hashes = PatriciaTrie(1 << 60), {}
    yield from flush(trie, hashes)


def _owners(batches):
    schema = pa.schema([("sha_", pa.string()), ("keep_", pa.int64()), ("many_", pa.int64()), ("n_", pa.int64())])
    trie = PatriciaTrie()
    for batch in batches:
        for key, low, many, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            trie.insert(key, (low, many, n))
    rows = []
    for key, (low, many, n) in trie.items():
        rows.append((hashlib.sha256(key).hexdigest(), low, many, n))
        if len(rows) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text: ``sha_`` (SHA-256 of the normalised text), ``keep_`` (smallest id),
    ``many_`` (rows with that id) and ``n_`` (rows)."""
    body = docs.select(docs[id_col].cast("long").alias("id_"), one_space(docs[text_col]).alias("t_"))
    local = body.select("id_", F.xxhash64("t_").alias("hash_"), F.col("t_").cast("binary").alias("body_")).mapInArrow(_local, _LOCAL)
    dealt = local.repartition("len_", "hash_").select("body_", "low_", "many_", "n_")
    return dealt.mapInArrow(_owners, _OWNERS)


def text_sha(text: Column) -> Column:
    return F.sha2(one_space(text), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A verdict for every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  Null ids are larger than all others; in a group that has only null ids ``keep_id``
    is null and its rows are kept.  Rows that repeat both the smallest id and the text are all marked as kept
    (:func:`drop_exact_duplicates` leaves one).  An empty table gives an empty result; other columns are ignored.

    The join back on the text's SHA-256 moves ids and digests only; its hot keys are left to the skew-join rule,
    which can split them because nothing above the join needs them together.
    """
    owners = text_owners(docs, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id_"), text_sha(docs[text_col]).alias("text_sha256"))
    joined = rows.join(owners, rows["text_sha256"] == owners["sha_"])
    return joined.select(
        F.col("id_").alias(id_col), F.col("keep_").alias("keep_id"), F.col("n_").alias("group_size"),
        F.col("id_").eqNullSafe(F.col("keep_")).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the smallest id; all columns as they were."""
    owners = cut(text_owners(docs, id_col, text_col))
    rows = packed(docs, id_=docs[id_col].cast("long"), key_=text_sha(docs[text_col]))
    kept = rows.join(owners, rows["key_"] == owners["sha_"]).where(F.col("id_").eqNullSafe(F.col("keep_")))
    if not owners.where("many_ > 1").isEmpty():
        # Rows that repeat an id with its text are rare; only then is there a second shuffle.
        kept = kept.dropDuplicates(["id_", "key_"])
    return unpacked(kept, docs)
