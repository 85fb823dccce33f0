"""Immutable results that are paged with cursors.

A snapshot is a checkpointed DataFrame with ``ord`` from 1; a page is a filter on it and never a new search.  Driver
memory holds handles only.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import CursorError
from ..operators.budget import running_sum
from ..session import cut, release

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
KINDS = ("matches", "summary", "analysis", "analysis-hybrid", "analysis-terms", "analysis-term-counts", "source")


def base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
        if not n:
            return out


@dataclass(frozen=True)
class Cursor:
    snapshot: str
    kind: str
    offset: int
    selection: str = ""

    def __str__(self) -> str:
        return ".".join([self.snapshot, self.kind, base36(self.offset), *([self.selection] if self.selection else [])])

    @classmethod
    def parse(cls, text: str) -> Cursor:
        parts = text.split(".")
        try:
            if len(parts) not in (3, 4) or parts[1] not in KINDS or str(uuid.UUID(parts[0])) != parts[0] or not parts[2]:
                raise ValueError
            return cls(parts[0], parts[1], int(parts[2], 36), *parts[3:])
        except ValueError:
            raise CursorError("the cursor is malformed", "E_CURSOR_MALFORMED") from None


def selection_key(paths: list[str]) -> str:
    """A short key of a choice of paths."""
    return hashlib.sha256("\0".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass
class Snapshot:
    id: str
    kind: str
    rows: DataFrame
    count: int
    facts: dict[str, Any]
    made: float
    used: float
    #: ``path, version`` of the sources that the rows come from, as the search read them.
    manifest: DataFrame | None = None
    selections: dict[str, list[str]] = field(default_factory=dict)


class SnapshotRegistry:
    """At most ``capacity`` snapshots, each for ``seconds`` after its last use; the one unused longest goes first."""

    def __init__(self, capacity: int = 20, seconds: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.seconds, self.clock = capacity, seconds, clock
        self._held: OrderedDict[str, Snapshot] = OrderedDict()
        self._gone: OrderedDict[str, None] = OrderedDict()

    def add(self, kind: str, rows: DataFrame, order: list[str], facts: dict[str, Any] | None = None, manifest: DataFrame | None = None) -> Snapshot:
        """Number the rows in order and settle them; ``manifest`` is settled already and belongs to the snapshot then.

        The numbers come from range partitions in two passes, not from one task that sorts all rows.
        """
        one = rows.withColumn("one_", F.lit(1))
        numbered = running_sum(one, "one_", order).withColumnRenamed("upto_", "ord").withColumn("ord", F.col("ord").cast("long")).drop("one_", "part_")
        settled = cut(numbered)
        now = self.clock()
        s = Snapshot(str(uuid.uuid4()), kind, settled, settled.count(), facts or {}, now, now, manifest)
        self._held[s.id] = s
        while len(self._held) > self.capacity:
            self._forget(next(iter(self._held)))
        return s

    def _forget(self, key: str) -> None:
        """Drop a snapshot and the files behind it."""
        gone = self._held.pop(key)
        release(gone.rows, *([gone.manifest] if gone.manifest is not None else []))
        self._gone[key] = None
        while len(self._gone) > 10 * self.capacity:
            self._gone.popitem(last=False)

    def note(self, key: str, facts: dict[str, Any]) -> None:
        """Keep something about a snapshot that is still held."""
        if key in self._held:
            self._held[key].facts |= facts

    def get(self, cursor: Cursor | str, kind: str | None = None) -> tuple[Snapshot, Cursor]:
        c = Cursor.parse(cursor) if isinstance(cursor, str) else cursor
        now = self.clock()
        for key in [k for k, s in self._held.items() if now - s.used > self.seconds]:
            self._forget(key)
        if c.snapshot in self._gone:
            raise CursorError("the snapshot has expired", "E_CURSOR_EXPIRED", recovery="retry")
        s = self._held.get(c.snapshot)
        if s is None:
            raise CursorError("there is no such snapshot", "E_CURSOR_NOT_FOUND")
        if s.kind != c.kind or (kind is not None and c.kind != kind):
            raise CursorError(f"the cursor is of kind {c.kind}", "E_CURSOR_KIND")
        if not 0 <= c.offset <= s.count:
            raise CursorError("the cursor lies outside the result", "E_CURSOR_OFFSET")
        if c.selection and c.selection not in s.selections:
            raise CursorError("the cursor's selection is unknown", "E_CURSOR_OPTIONS")
        s.used = now
        self._held.move_to_end(c.snapshot)
        return s, c

    def page(self, cursor: Cursor | str, items: int, max_bytes: int | None = None, size: str | None = None) -> tuple[list[Row], Cursor | None]:
        """At most ``items`` rows from the cursor, and the cursor of the next ones.

        With ``max_bytes`` a page ends before the row whose ``size`` does not fit; the first row always does.
        """
        s, c = self.get(cursor)
        rows = s.rows
        if c.selection:
            rows = rows.where(F.col("path").isin(*s.selections[c.selection]))
            rows = rows.withColumn("ord", F.row_number().over(Window.orderBy("ord")).cast("long"))
        near = rows.where((F.col("ord") > c.offset) & (F.col("ord") <= c.offset + items + 1)).orderBy("ord").collect()
        out, used = [], 0
        for r in near[:items]:
            used += r[size] if size else 0
            if out and max_bytes is not None and used > max_bytes:
                break
            out.append(r)
        more = len(out) < len(near)
        return out, Cursor(s.id, s.kind, c.offset + len(out), c.selection) if more else None

    def select(self, snapshot: Snapshot, paths: list[str]) -> Cursor:
        """A cursor over the rows of at most 20 paths."""
        if not 1 <= len(paths) <= 20:
            raise CursorError("1 to 20 paths can be selected", "E_CURSOR_OPTIONS")
        key = selection_key(paths)
        snapshot.selections[key] = list(paths)
        return Cursor(snapshot.id, snapshot.kind, 0, key)
