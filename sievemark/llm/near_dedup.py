"""MinHash near-deduplication by a signature-coordinate inverted join.

Texts with the same shingle set are one class.  A class has a signature of ``COORDINATES`` minima and is posted under
each coordinate-value pair.  Two classes that match in at least ``matches`` coordinates must meet among the rarest
``COORDINATES - matches + 1`` pairs of each, when all order their pairs by the same frequencies: only these are
joined (prefix), and of those only pairs that a second class has at all.  Inside a group of classes that meet, the
collisions of the remaining coordinates are not merged but looked up for candidates alone, and candidates that are
already connected are skipped.  Every link is confirmed on full shingle sets; only a spanning forest leaves a task, so
groups of copies are not expanded into pairs.  A large group is dealt over tasks in blocks: first each class meets the one
class that leads most of its lists, which connects copies; what is still apart then has its collisions counted on
signatures, block by block, and full sets move only for members that have a candidate there.

``matches`` lies five standard deviations under the mean of a pair at the threshold: such a pair is missed with a
chance of a few in a million.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, packed, release, unpacked
from .components import components
from .vectext import LOWER, U64, chunks, keys, mix, windows, word_hashes, words

COORDINATES = 64
#: Shingles and members that a group of candidates may have in a task; larger groups are dealt in blocks of that size.
GROUP_SHINGLES = 2_000_000
GROUP_MEMBERS = 512
#: Members of a group up to which all blocks of it meet by signatures; in a larger one those of each list do.
WHOLE_GROUP = 1 << 16
_MULTIPLIERS = keys(COORDINATES, 7) | U64(1)


def matches_needed(percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


def shingle_sets(column: pa.Array, size: int):
    """For each row the sorted distinct hashes of its ``size``-word shingles (A-Z in lower case)."""
    for chunk in chunks(column):
        chunk.data = LOWER[chunk.data]
        w = words(chunk)
        h = word_hashes(chunk.data, w.starts, w.ends)
        s = windows(h, size)
        for r in range(chunk.rows):
            a, b = w.first[r], w.first[r + 1]
            n = b - a
            if n >= size:
                yield np.unique(s[a : b - size + 1])
            elif n:
                yield windows(h[a:b], int(n)) ^ U64(int(n))
            else:
                yield np.empty(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    """``COORDINATES`` minima, 32 bits each, with the coordinate in the bits above: int64."""
    if len(s) < 256:
        low = (s[:, None] * _MULTIPLIERS[None, :]).min(axis=0)
    else:
        low = np.array([(s * a).min() for a in _MULTIPLIERS], U64)
    return ((low >> U64(32)) | (np.arange(COORDINATES, dtype=U64) << U64(32))).astype(np.int64)


_FEATURES = "id_ long, n_ long, hi_ long, lo_ long, sig_ array<long>"


def _features(batches, size: int):
    fold = keys(1, 99)[0]
    for batch in batches:
        ids, n, hi, lo, sigs = batch.column(0), [], [], [], []
        for s in shingle_sets(batch.column(1), size):
            n.append(len(s))
            m = mix(s ^ fold)
            hi.append(int(np.add.reduce(s).astype(np.int64)) if len(s) else 0)
            lo.append(int(np.add.reduce(m).astype(np.int64)) if len(s) else 0)
            sigs.append(signature(s) if len(s) else None)
        flat = [x for x in sigs if x is not None]
        ends = np.cumsum([0] + [COORDINATES if x is not None else 0 for x in sigs]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], names=["id_", "n_", "hi_", "lo_", "sig_"])


def _sets(batches, size: int):
    for batch in batches:
        out = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["class_", "set_"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * union, on sorted distinct hashes."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum()) if len(b) else 0
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class _Overlaps:
    """Exact numbers of shingles that one set shares with every other of a group, from the members of each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, self.shingle = np.unique(every, return_inverse=True)
        order = np.argsort(self.shingle, kind="stable")
        self.members = owner[order].astype(np.int32)
        self.many = np.bincount(self.shingle)
        self.first = np.cumsum(self.many) - self.many
        self.ends = np.concatenate(([0], np.cumsum(self.sizes)))

    def shared(self, i: int) -> np.ndarray:
        own = self.shingle[self.ends[i] : self.ends[i + 1]]
        many = self.many[own]
        at = np.arange(int(many.sum())) + np.repeat(self.first[own] - (np.cumsum(many) - many), many)
        return np.bincount(self.members[at], minlength=len(self.sizes))


class _Forest:
    """Groups of members; a merge renames the smaller one."""

    def __init__(self, label: np.ndarray):
        _, self.label = np.unique(label, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(self.label))[:-1])

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]), key=lambda g: len(self.members[g]))
        if a != b:
            self.label[self.members[a]] = b
            self.members[b] = np.concatenate((self.members[b], self.members[a]))
            self.members[a] = self.members[a][:0]


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, smallest connected member) for the members that confirmed links connect.

    side: with two different values only pairs of different sides are compared.  known: members with equal values are
    connected already; they are not compared, and are told only where they meet others.
    """
    m, need = len(ids), matches_needed(percent)
    if m == 2 and known is None:
        return [(int(max(ids)), int(min(ids)))] if ids[0] != ids[1] and similar(sets[0], sets[1], percent) else []
    two_sided = len(np.unique(side)) > 1
    sig = np.stack([signature(s) for s in sets])
    tokens, inverse, count = np.unique(sig, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(sig.shape)
    shared = count[inverse] > 1
    order = np.lexsort((inverse, count[inverse]), axis=1)
    lists: dict[int, list[int]] = {}
    forest = _Forest(np.arange(m) if known is None else known)
    label, joined = forest.label, []
    overlaps = _Overlaps(sets)
    for i in np.argsort(ids, kind="stable"):
        n_prefix = int(shared[i].sum()) - need + 1
        if n_prefix <= 0:
            continue
        row = order[i][COORDINATES - int(shared[i].sum()) :][:n_prefix]
        prefix = inverse[i][row].tolist()
        met = [lists[t] for t in prefix if t in lists]
        if met:
            cand = np.unique(np.concatenate([np.fromiter(x, np.int64, len(x)) for x in met]))
            cand = cand[label[cand] != label[i]]
            if two_sided:
                cand = cand[side[cand] != side[i]]
            cand = cand[(sig[cand] == sig[i]).sum(axis=1) >= need]
            if len(cand):
                shared_ = overlaps.shared(i)[cand]
                for c in cand[100 * shared_ >= percent * (overlaps.sizes[i] + overlaps.sizes[cand] - shared_)]:
                    if label[c] != label[i]:
                        joined += [int(i), int(c)]
                        forest.join(i, c)
        for t in prefix:
            lists.setdefault(t, []).append(i)
    low: dict[int, int] = {}
    for i in set(joined):
        low[label[i]] = min(int(ids[i]), low.get(label[i], int(ids[i])))
    return sorted({(int(ids[i]), low[label[i]]) for i in joined if int(ids[i]) != low[label[i]]})


_UNIT = ["kind", "unit_", "block_", "other_"]


def _verify(batches, percent: int):
    key, ids, sets, side, known = None, [], [], [], []

    def done():
        if key[0] >= 2 and len(set(side)) < 2:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        links = spanning_links(np.array(ids), [np.frombuffer(s, U64) for s in sets], np.array(side), percent, np.array(known) if key[0] >= 2 else None)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    for batch in batches:
        for *k, own, group, cid, s in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if k != key:
                if len(ids) > 1:
                    yield done()
                key, ids, sets, side, known = k, [], [], [], []
            ids.append(cid)
            sets.append(s)
            side.append(own)
            known.append(group)
    if len(ids) > 1:
        yield done()


def _sketches(batches):
    """The last byte of each coordinate: two that match in the coordinate match in it."""
    for batch in batches:
        sigs = batch.column(1).flatten().to_numpy().reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in (sigs & 0xFF).astype(np.uint8)], pa.binary())], names=["c_", "sketch_"])


def _candidates(batches, percent: int):
    """The members of each unit that match one of the other side, and are apart from it, in enough coordinates."""
    need = matches_needed(percent)
    names = [*_UNIT, "own_", "known_", "class_"]
    key, rows, sigs = None, [], []

    def done():
        sig, own, known = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, COORDINATES), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        left, right = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
        met = np.zeros(len(rows), bool)
        for i in right:
            hits = (sig[left] == sig[i]).sum(axis=1) >= need
            hits &= known[left] != known[i]
            met[left[hits]] = True
            met[i] = hits.any()
        kept = [rows[i] for i in np.flatnonzero(met)]
        kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], k) for c, k in enumerate(kinds)], names=names)

    for batch in batches:
        for *row, sig in zip(*(batch.column(c).to_pylist() for c in range(8))):
            if row[:4] != key:
                if rows:
                    yield done()
                key, rows, sigs = row[:4], [], []
            rows.append(row)
            sigs.append(sig)
    if rows:
        yield done()


def _compared(units: DataFrame, body: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: the confirmed links inside each unit (``kind, unit_, block_, other_``) of rows ``class_, own_,
    known_``; settled."""
    ids = cut(units.select(F.col("class_").alias("w_")).distinct())
    # Ids only, and measured: texts move when there are too many of them.
    wanted = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
    texts = body.join(wanted, body["id_"] == wanted["w_"], "left_semi").select(F.col("id_").alias("class_"), "text_")
    # An id with several texts has several sets; each is compared, under that id.
    sets = texts.mapInArrow(partial(_sets, size=size), "class_ long, set_ binary")
    dealt = units.join(sets, "class_").repartition(*_UNIT).select(*_UNIT, "own_", "known_", "class_", "set_")
    found = cut(dealt.sortWithinPartitions(*_UNIT).mapInArrow(partial(_verify, percent=percent), "a long, b long"))
    release(ids)
    return found


def _blocks(members: Column, shingles: Column, group_members: int, group_shingles: int) -> Column:
    return F.greatest(F.ceil(members / F.lit(group_members)), F.ceil(shingles / F.lit(group_shingles)), F.lit(1)).cast("long")


def _block(of: str, blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), F.col(blocks))


def _links(postings: DataFrame, classes: DataFrame, body: DataFrame, size: int, percent: int, group_members: int, group_shingles: int, whole_group: int) -> DataFrame:
    """``a, b``: links that connect all classes that similar pairs connect.

    A group is a component of the graph of classes and posted pairs; a small one is compared in one task.  Of a large
    one the lists of its pairs are taken in two steps.  First each class is compared with one other, the smallest class of
    most of its lists, in blocks with the others that have the same: a group of copies is connected by this, however large
    it is, and every set moves once.  Then, in groups with classes that are still apart, those outside of the largest
    connected part are held against all others, block by block, by sketches of their signatures; sets follow for those
    that match.
    """
    lead = postings.groupBy("token").agg(F.min("class_").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1")
    met = cut(postings.join(lead, "token").select("token", "class_", "lead"))
    coarse = components(met, "class_", "lead")
    sized = coarse.join(classes.select("class_", "n_"), coarse["node"] == classes["class_"]).select("class_", "component", "n_")
    total = sized.groupBy("component").agg(F.sum("n_").alias("shingles"), F.count(F.lit(1)).alias("members"))
    member = cut(sized.join(total, "component").select("class_", "n_", "component", F.col("members").alias("size_"), ((F.col("shingles") > group_shingles) | (F.col("members") > group_members)).alias("large")))
    release(coarse)
    none = F.lit(None).cast("long")
    small = member.where("NOT large").select("class_", F.lit(0).alias("kind"), F.col("component").alias("unit_"), F.lit(0).cast("long").alias("block_"), F.lit(0).cast("long").alias("other_"), F.lit(0).alias("own_"), none.alias("known_"))
    large = member.where("large").select("class_", "n_")
    if large.isEmpty():
        found = _compared(small, body, size, percent)
        release(met, member)
        return found
    big = cut(met.join(large, "class_"))

    led = big.where("class_ <> lead").groupBy("class_", "n_", "lead").agg(F.count(F.lit(1)).alias("lists"))
    star = cut(led.groupBy("class_", "n_").agg(F.min_by("lead", F.struct(-F.col("lists"), F.col("lead"))).alias("lead")))
    release(big)
    per = star.groupBy("lead").agg(F.count(F.lit(1)).alias("m"), F.sum("n_").alias("s")).select(F.col("lead").alias("l_"), _blocks(F.col("m"), F.col("s"), group_members, group_shingles).alias("blocks"))
    per = cut(per)
    of_star = lambda c, block: [c.alias("class_"), F.lit(1).alias("kind"), F.col("lead").alias("unit_"), block.alias("block_"), F.lit(0).cast("long").alias("other_"), F.lit(0).alias("own_"), none.alias("known_")]
    spread = star.join(per, star["lead"] == per["l_"]).select(*of_star(F.col("class_"), _block("class_", "blocks", 1)))
    heads = per.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("lead", F.col("l_")).select(*of_star(F.col("l_"), F.col("block")))
    first = _compared(small.union(spread).union(heads), body, size, percent)
    release(star, per)

    so_far = components(first, "a", "b")
    placed = member.where("large").join(so_far.select("node", F.col("component").alias("c_")), F.col("class_") == F.col("node"), "left")
    placed = cut(placed.select("class_", "n_", F.coalesce("c_", "class_").alias("known_"), F.col("component").alias("group_"), "size_"))
    # All blocks of a group meet, each class once; of a very large group those of each list, in which a class is often.
    of_group = placed.where(F.col("size_") <= whole_group).select(F.lit(2).alias("kind"), F.col("group_").alias("unit"), "class_", "n_", "known_")
    of_list = met.join(placed.where(F.col("size_") > whole_group), "class_").select(F.lit(3).alias("kind"), F.col("token").alias("unit"), "class_", "n_", "known_")
    known = of_group.union(of_list)
    parts = known.groupBy("kind", "unit", "known_").agg(F.count(F.lit(1)).alias("m"), F.sum("n_").alias("s"))
    lists = parts.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "known_")).alias("main")).where("parts > 1")
    lists = cut(lists.select(
        F.col("kind").alias("k_"), F.col("unit").alias("t_"), F.col("main.known_").alias("main"), _blocks(F.col("m"), F.col("s"), group_members, group_shingles).alias("blocks"),
        _blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s"), group_members, group_shingles).alias("others"),
    ))
    result = first
    if not lists.isEmpty():
        open_ = cut(known.join(lists, (known["kind"] == lists["k_"]) & (known["unit"] == lists["t_"])))
        rows = lambda block, other, own: [F.col("class_"), F.col("kind"), F.col("unit").alias("unit_"), block.alias("block_"), other.alias("other_"), F.lit(own).alias("own_"), F.col("known_")]
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        all_ = open_.withColumn("o", every("others")).select(*rows(_block("class_", "blocks", 2), F.col("o"), 0))
        rest = open_.where("known_ <> main").withColumn("b", every("blocks")).select(*rows(F.col("b"), _block("class_", "others", 3), 1))
        # Only sketches meet all others.
        sketches = classes.select("class_", "sig_").mapInArrow(_sketches, "c_ long, sketch_ binary")
        sides = all_.union(rest).join(sketches, F.col("class_") == F.col("c_")).select(*_UNIT, "own_", "known_", "class_", "sketch_")
        kind = "kind int, unit_ long, block_ long, other_ long, own_ int, known_ long, class_ long"
        near = cut(sides.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(partial(_candidates, percent=percent), kind))
        second = _compared(near, body, size, percent)
        release(near, open_)
        # ``a`` and ``b`` of the second step connect what the first has connected.
        result = first.union(second)
    release(met, member, so_far, placed, lists)
    return result


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    group_shingles: int = GROUP_SHINGLES, group_members: int = GROUP_MEMBERS, whole_group: int = WHOLE_GROUP,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when 100 * shared >= percent * united distinct shingles; ``component_id`` is the smallest id
    that links reach.  A text with fewer words than a shingle has its whole sequence of words as one; one without
    words, or null, has none and is linked with nothing.  Rows with a null id take part through their text only:
    ``component_id`` is that of the texts they equal, or null.  Rows that repeat an id are judged alike.  An empty
    table gives an empty result; other columns are ignored.
    """
    need = matches_needed(percent)
    body = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].alias("text_"))
    feats = cut(body.mapInArrow(partial(_features, size=shingle), _FEATURES))
    classes = cut(feats.where("n_ > 0 AND id_ IS NOT NULL").groupBy("hi_", "lo_", "n_").agg(F.min("id_").alias("class_"), F.first("sig_").alias("sig_")))

    posted = classes.select("class_", F.explode("sig_").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = posted.join(shared, "token").groupBy("class_").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("l"))
    prefix = ranked.where(F.size("l") >= need).select("class_", F.explode(F.slice("l", F.lit(1), F.size("l") - need + 1)).alias("x"))
    postings = cut(prefix.select("class_", F.col("x.token").alias("token")))

    links = _links(postings, classes, body, shingle, percent, group_members, group_shingles, whole_group)
    label = components(links, "a", "b")

    mine = feats.join(classes.select("hi_", "lo_", "n_", "class_"), ["hi_", "lo_", "n_"], "left")
    all_rows = mine.join(label, mine["class_"] == label["node"], "left")
    component = F.when(F.col("n_") > 0, F.coalesce("component", "class_")).otherwise(F.col("id_"))
    out = cut(all_rows.select(F.col("id_").alias(id_col), F.col("n_").alias("n_shingles"), component.alias("component_id"), F.col("id_").eqNullSafe(component).alias("kept")))
    release(feats, classes, postings, label)
    return out


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component.  Rows with a null id stay, and rows that
    repeat an id stay or go together.  All columns are as they were."""
    verdict = near_duplicates(docs, shingle, percent, id_col, text_col)
    gone = verdict.where(f"NOT kept AND `{id_col}` IS NOT NULL").select(F.col(id_col).alias("gone_")).distinct()
    rows = packed(docs, id_=docs[id_col].cast("long"))
    return unpacked(rows.join(gone, rows["id_"] == gone["gone_"], "left_anti"), docs)
