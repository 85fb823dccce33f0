"""The engine: one entry point for flat requests over a table of sources.

A result says what was found, retained and returned, whether its coverage is complete and if not why, and how to go on.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CapabilityError, CursorError, EvidenceError
from ..functions import paths as P
from ..functions import text as T
from ..functions.pattern import Pattern
from ..functions.redaction import redact, redaction_count
from ..operators import access as AC
from ..operators import audit as A
from ..operators import files as FI
from ..operators import modules as MO
from ..operators import search as S
from ..operators import semantic as M
from ..operators import stats as ST
from ..operators import structure as X
from ..operators import syntax as SX
from ..operators.changes import changed_lines
from ..operators.budget import prefix
from ..session import cut, release
from ..sources.corpus import content_hash
from .contract import Limits, Request, context_tier, page_room, parse, summary_room
from .operations import Operations
from .snapshots import Cursor, SnapshotRegistry


@dataclass
class Result:
    kind: str
    unit: str
    rows: list[dict]
    counts: dict[str, int] = field(default_factory=dict)
    partial: bool = False
    reasons: list[str] = field(default_factory=list)
    coverage: dict[str, str] = field(default_factory=dict)
    cursor: str | None = None
    next_request: dict | None = None
    facts: dict[str, Any] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "partial" if self.partial else "complete"


@dataclass
class Session:
    """Counts of what a session asked for; continuations are not queries."""

    queries: int = 0
    complete: int = 0
    partial: int = 0
    continued: int = 0
    failed: int = 0


class Engine:
    """``sources``: ``path, text`` and optionally ``mtime_ms`` and ``ignored``, as a table or as a function that reads it.

    A function is called for each request, so that a search sees what a rewritten corpus holds now; a table stands for
    the files that it was made of.  ``current`` gives the sources as they are now, for validation and audits; by default it
    is the function.  ``base`` is an earlier version of the sources for ``changes``."""

    def __init__(
        self, sources: DataFrame | Callable[[], DataFrame], *, current: Callable[[], DataFrame] | None = None, base: DataFrame | None = None, encoder: M.Encoder | None = None, judge: M.Judge | None = None, syntax: SX.SyntaxProvider | None = None,
        facts: Mapping[str, DataFrame] | None = None, cache: M.EmbeddingCache | None = None, limits: Limits = Limits(), clock=None, partial_reasons: list[str] | None = None, remaining: float | None = None,
    ):
        self.read = sources if callable(sources) else lambda: sources
        self.sources = self.read()
        self.current, self.base = current or self.read, base
        self.encoder, self.judge, self.syntax, self.facts, self.limits = encoder, judge, syntax, facts, limits
        self.cache = cache
        self.reasons = partial_reasons or []
        #: The share of the reader's context that is left, if known; it bounds pages.
        self.remaining = remaining
        spark = self.sources.sparkSession
        timed = {"clock": clock} if clock else {}
        self.snapshots = SnapshotRegistry(limits.snapshots, limits.snapshot_seconds, **timed)
        self.operations = Operations(spark, **timed)
        self.session = Session()
        self._going_on: OrderedDict[str, tuple[str, AC.Continuations]] = OrderedDict()

    def search(self, raw: Mapping[str, Any]) -> Result:
        request = parse(raw, self.limits)
        if request.mode not in ("await", "cancel", "validate"):
            self.sources = self.read()
        going_on = request.get("cursor") is not None and request.mode in ("auto", "matches", "summary")
        if request.mode not in ("await", "cancel"):
            self.session.continued += going_on
            self.session.queries += not going_on
        try:
            out = self._dispatch(request)
        except Exception:
            self.session.failed += 1
            raise
        if not going_on and request.mode not in ("await", "cancel"):
            self.session.complete += not out.partial
            self.session.partial += out.partial
        return self._redacted(out) if request.get("redact", True) else out

    def start(self, raw: Mapping[str, Any], wait: float = 5.0) -> Result:
        """Run a request as an operation; a waiting result names the request that awaits it."""
        op = self.operations.start(lambda: self.search(raw))
        return self._operation(self.operations.wait(op.id, wait))

    def _operation(self, op) -> Result:
        if op.state == "complete":
            return op.result
        if op.state == "failed":
            raise op.error
        again = {"mode": "await", "operationId": op.id} if op.state == "running" else None
        return Result("operation", "operation", [{"id": op.id, "state": op.state}], partial=True, reasons=[f"the operation is {op.state}"], next_request=again)

    def _dispatch(self, r: Request) -> Result:
        if r.mode == "await":
            return self._operation(self.operations.wait(r.get("operationId")))
        if r.mode == "cancel":
            return self._operation(self.operations.cancel(r.get("operationId")))
        if r.mode in ("auto", "summary", "matches"):
            if r.get("cursor"):
                return self._page(r.get("cursor"), r)
            if r.get("anyOf"):
                return self._any_of(r)
            if r.get("allOf"):
                return self._all_of(r)
            return self._content(r)
        if r.mode in ("outline", "imports", "tests") and r.get("cursor"):
            r = self._chosen(r)
        return getattr(self, f"_{r.mode}")(r)

    def _chosen(self, r: Request) -> Request:
        """The request at the place of a saved match: ``matchIndex``, or the first one from the cursor."""
        s, c = self.snapshots.get(r.get("cursor"))
        index = r.get("matchIndex", c.offset + 1)
        found = s.rows.where(F.col("ord") == index).collect() if "path" in s.rows.columns else []
        if not found:
            raise EvidenceError(f"the saved result has no place {index}", "E_MATCH_INDEX")
        match = found[0].asDict()
        line = match.get("line_no", match.get("line"))
        more = {"line": line} if line is not None and r.get("line") is None and r.get("symbol") is None and r.mode != "tests" else {}
        return Request(r.mode, {**{k: v for k, v in r.fields.items() if k not in ("cursor", "matchIndex")}, "path": match["path"], **more})

    # Scope

    def _scoped(self, r: Request, path: bool = True) -> DataFrame:
        s = self.sources
        if "ignored" in s.columns and r.get("ignorePolicy") != "include":
            s = s.where(~F.coalesce("ignored", F.lit(False)))
        s = s.where(P.in_scope(F.col("path"), r.get("glob"), r.get("exclude"), r.get("hidden", True)))
        under = r.get("path")
        if path and under and under != ".":
            s = s.where((F.col("path") == under) | F.col("path").startswith(under.rstrip("/") + "/"))
        return s

    def _coverage(self, r: Request, out: Result) -> Result:
        """Ignored sources and those too large to read make a result partial; so does what the lister reported."""
        coverage = "complete"
        if "ignored" in self.sources.columns and r.get("ignorePolicy") != "include" and not self.sources.where("ignored").isEmpty():
            coverage = "policy-filtered"
            out.reasons.append("ignored sources were not searched")
        if self.reasons:
            coverage = "partial"
            out.reasons += self.reasons
        out.reasons = list(dict.fromkeys(out.reasons))
        out.coverage["filesystem"] = coverage
        out.partial |= coverage != "complete"
        if out.partial and "snapshot" in out.facts:
            self.snapshots.note(out.facts["snapshot"], {"stored_reasons": list(out.reasons) or ["the saved result is partial"]})
        return out

    def _timed(self, rows: DataFrame, r: Request, keep_unknown: bool) -> tuple[DataFrame, list[str]]:
        after, before = r.get("modifiedAfter"), r.get("modifiedBefore")
        if after is None and before is None:
            return rows, []
        if "mtime_ms" not in rows.columns:
            raise EvidenceError("these sources have no modification times", "E_MTIME")
        unknown = [] if rows.where("mtime_ms IS NULL").isEmpty() else ["some modification times are unknown"]
        return S.modified_between(rows, "mtime_ms", after, before, keep_unknown), unknown

    # Content search

    def _pattern(self, r: Request) -> Pattern:
        return Pattern(r.get("pattern"), bool(r.get("literal", False)), r.get("ignoreCase"), bool(r.get("wholeWord", False)))

    def _content(self, r: Request) -> Result:
        p = self._pattern(r)
        placed = r.get("changes") is not None or bool(r.get("roles"))

        def scan(sources: DataFrame) -> DataFrame:
            # The scan itself says which version of a source its matches come from.
            versioned = sources.select("path", "text", content_hash(F.col("text")).alias("version"))
            return cut(S.matching_lines(versioned, p, "path", "version", ranges=True, places=placed))

        scoped, unknown = self._timed(self._scoped(r), r, True)
        found = scan(scoped)
        expanded = False
        if r.get("path") and r.get("scope") != "strict" and found.isEmpty():
            scoped, unknown = self._timed(self._scoped(r, path=False), r, True)
            release(found)
            found = scan(scoped)
            expanded = not found.isEmpty()
        if r.get("changes") is not None:
            ranges, untold = self._changed_ranges(scoped)
            found = self._replaced(found, S.only_inside(found, ranges))
            unknown = unknown + untold
        if r.get("roles"):
            intervals, unparsed = self._roles(found, r, scoped)
            found = self._replaced(found, S.only_inside(found, intervals))
            unknown = unknown + unparsed
        total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("path")).first()
        a = F.element_at("occurrences", 1)
        shown = found.withColumn("excerpt", T.excerpt(T.shown(F.col("line")), a["start"], a["end"], self.limits.line_characters)).withColumn("size_", F.octet_length("excerpt") + F.octet_length("path") + 32)
        keep = shown.select("path", "line_no", "excerpt", "occurrences", "n", "size_")
        if total[0] > self.limits.retained_lines:
            keep = keep.orderBy("path", "line_no").limit(self.limits.retained_lines)
        manifest = cut(found.select("path", "version").distinct())
        snap = self.snapshots.add("matches", keep, ["path", "line_no"], {"pattern": p, "expanded": expanded}, manifest)
        counts = {"found": int(total[0]), "retained": snap.count, "occurrences": int(total[1]), "files": int(total[2])}
        facts = {"expanded_to_root": expanded, "snapshot": snap.id}
        reasons = list(unknown)
        if snap.count < total[0]:
            reasons.append("more lines match than are retained")
        out = Result("matches", "lines", [], counts, bool(reasons), reasons, facts=facts)
        first, after = self.snapshots.page(Cursor(snap.id, "matches", 0), r.get("limit", self.limits.page_matches), page_room(self.limits, self.remaining), "size_")
        tight = self.remaining is not None and context_tier(self.remaining)[0] != "full"
        if r.mode == "summary" or (r.mode == "auto" and r.get("limit") is None and (after is not None or (tight and snap.count > 0) or snap.count < total[0])):
            out.kind, out.unit = "summary", "files"
            per = found.groupBy("path").agg(F.count(F.lit(1)).alias("match_lines"), F.sum("n").alias("occurrences"))
            files = S.ordered_summary(per, self.limits.summary_files).collect()
            out.rows, room = [], summary_room(self.limits, self.remaining)
            for x in files:
                room -= len(x["path"].encode()) + 32
                if out.rows and room < 0:
                    break
                out.rows.append(x.asDict())
            out.facts |= {"by_type": [x.asDict() for x in ST.by_type(per).collect()], "by_directory": [x.asDict() for x in ST.by_directory(per).collect()]}
            out.cursor = str(Cursor(snap.id, "matches", 0)) if snap.count else None
        else:
            out.rows = self._with_context(first, scoped, r.get("context", 0))
            out.cursor = str(after) if after else None
        out.counts["returned"] = len(out.rows)
        release(found)
        return self._coverage(r, out)

    @staticmethod
    def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        """A settled table in place of the one that it was made of."""
        settled = cut(new)
        release(old)
        return settled

    def _with_context(self, rows, scoped: DataFrame, context: int) -> list[dict]:
        out = [{k: v for k, v in x.asDict(recursive=True).items() if k != "size_"} for x in rows]
        if not context or not out:
            return out
        page = scoped.sparkSession.createDataFrame([(x["path"], x["line_no"]) for x in out], "path string, line_no int")
        windows = S.context_windows(page, None, context)
        paths = sorted({x["path"] for x in out})
        lines = T.lines(scoped.where(F.col("path").isin(*paths)))
        j = windows.withColumnRenamed("line_no", "at").join(lines, "path").where((F.col("line_no") >= F.col("start_line")) & (F.col("line_no") <= F.col("end_line")))
        by: dict = {}
        for x in j.select("path", "at", "line_no", "line").orderBy("path", "line_no").collect():
            by.setdefault((x["path"], x["at"]), []).append((x["line_no"], x["line"]))
        for x in out:
            x["context"] = by.get((x["path"], x["line_no"]), [])
        return out

    def _page(self, cursor: str, r: Request) -> Result:
        c = Cursor.parse(cursor)
        if r.get("pattern") or r.get("glob"):
            raise EvidenceError("a cursor goes with its own request only", "E_CURSOR_OPTIONS")
        sized = c.kind == "matches"
        items = r.get("limit", self.limits.page_matches if sized else self.limits.page_items)
        terms = c.kind == "analysis-term-counts"
        room = page_room(self.limits, self.remaining) if sized else self.limits.term_bytes if terms else None
        rows, after = self.snapshots.page(c, 64 if terms else items, room, "size_" if sized or terms else None)
        s, _ = self.snapshots.get(c)
        out = [{k: v for k, v in x.asDict(recursive=True).items() if k != "size_"} for x in rows]
        return Result(c.kind, "lines" if sized else "items", out, {"retained": s.count, "returned": len(out)}, cursor=str(after) if after else None, facts={"snapshot": s.id})

    def _changed_ranges(self, scoped: DataFrame) -> tuple[DataFrame, list[str]]:
        """``path, start, end``: what has changed in the sources, as ranges of their texts, and what could not be told.

        Changed lines reach to the start of the next one, so an occurrence that goes on into an unchanged line is in
        none of them, nor is an empty one where that begins.  A last line without a line feed reaches one place further,
        so that an empty one at its end is in it.
        """
        if self.base is None:
            raise CapabilityError("there is no earlier version to compare with", "E_CHANGES")
        old, new = self.base.select("path", "text"), scoped.select("path", "text")
        every = cut(changed_lines(old, new, self.limits.diff_steps))
        unknown = every.where("side = 'unknown'").count()
        reasons = [f"the changes of {unknown} sources take too many steps to tell"] if unknown else []
        lines = every.where("side = 'new'").select("path", "start_line", "end_line")
        starts = new.join(lines.select("path").distinct(), "path", "left_semi").select("path", T.line_starts("text").alias("s_"))
        at = lambda line: F.element_at("s_", line.cast("int"))
        ranges = lines.join(starts, "path").select("path", at(F.col("start_line")).alias("start"), at(F.col("end_line") + 1).alias("end"))
        added = new.join(old.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("start"), (F.length("text") + F.when(F.col("text").endswith("\n"), 0).otherwise(1)).cast("long").alias("end"))
        return ranges.union(added), reasons

    def _roles(self, found: DataFrame, r: Request, scoped: DataFrame) -> tuple[DataFrame, list[str]]:
        """``path, start, end``: the intervals of some roles in the sources with matches, and what could not be told."""
        provider, wanted = X.required(self.syntax, "roles"), r.get("roles")
        if set(wanted) - set(SX.ROLES):
            raise EvidenceError(f"roles are {', '.join(SX.ROLES)}", "E_ROLES")
        near, more = self._first(scoped.join(found.select("path").distinct(), "path", "left_semi"), r)
        roles = cut(SX.facts(near, provider, "roles"))
        reasons = self._unparsed(roles) + more
        if not near.where(~F.coalesce(P.language(F.col("path")).isin(*sorted(provider.languages)), F.lit(False))).isEmpty():
            reasons.append("some sources with matches are in languages that the provider does not parse")
        return roles.where((F.col("status") == "ok") & F.col("name").isin(*wanted)).select("path", "start", "end"), reasons

    @staticmethod
    def _unparsed(facts: DataFrame) -> list[str]:
        n = facts.where("status <> 'ok'").count()
        return [f"{n} sources can't be parsed"] if n else []

    def _to_parse(self, r: Request) -> tuple[DataFrame, list[str]]:
        """The scoped sources that a provider may parse: the first ``maxFilesToParse`` by path, if that is given."""
        return self._first(self._scoped(r).where(P.language(F.col("path")).isin(*sorted(self.syntax.languages))), r)

    @staticmethod
    def _first(sources: DataFrame, r: Request) -> tuple[DataFrame, list[str]]:
        most = r.get("maxFilesToParse")
        if most is None:
            return sources, []
        # Ends of a bounded list of paths; a top-k, which no task sorts as a whole.
        ends = [x["path"] for x in sources.select("path").orderBy("path").limit(int(most) + 1).collect()]
        if len(ends) <= int(most):
            return sources, []
        return sources.where(F.col("path") <= ends[int(most) - 1]), ["more sources than maxFilesToParse are in scope"]

    def _any_of(self, r: Request) -> Result:
        """Occurrences of any term.  Counts of terms tell found and retained apart, and have pages of their own."""
        terms = r.get("anyOf")
        scoped, unknown = self._timed(self._scoped(r), r, True)
        versioned = scoped.select("path", "text", content_hash(F.col("text")).alias("version"))
        near = r.get("changes") is not None or bool(r.get("roles"))
        found = cut(S.any_of(versioned, terms, "path", "version", places=near))
        if near:
            found, reasons = self._near(found, r, scoped)
            unknown = unknown + reasons
        total, order = found.count(), ["term_index", "path", "line_no", "start"]
        # Kept in the order of terms, as they are listed, up to a number and a size of occurrences.
        kept = found
        if total > self.limits.retained_occurrences or total * 512 > self.limits.retained_bytes:
            sized = found.withColumn("size_", F.octet_length("path") + F.octet_length("term") + 64)
            kept = cut(prefix(sized.orderBy(*order).limit(self.limits.retained_occurrences), "size_", self.limits.retained_bytes, order).drop("size_"))
        manifest = cut(found.select("path", "version").distinct())
        snap = self.snapshots.add("analysis-terms", kept.drop("version"), order, None, manifest)
        retained = {x["term_index"]: x["n"] for x in kept.groupBy("term_index").agg(F.count(F.lit(1)).alias("n")).collect()}
        told = {x["term_index"]: (x["n"], x["s"]) for x in found.groupBy("term_index").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("s")).collect()}
        counts = [(i, t, told.get(i, (0, 0))[0], retained.get(i, 0), told.get(i, (0, 0))[1], len(t.encode()) + 64) for i, t in enumerate(terms)]
        inventory = scoped.sparkSession.createDataFrame(counts, "term_index int, term string, found long, retained long, sources long, size_ long")
        listed = self.snapshots.add("analysis-term-counts", inventory, ["term_index"])
        first, more = self.snapshots.page(Cursor(listed.id, listed.kind, 0), 64, self.limits.term_bytes, "size_")
        per = {x["term"]: (x["found"], x["sources"]) for x in first}
        rows, after = self.snapshots.page(Cursor(snap.id, snap.kind, 0), r.get("limit", self.limits.page_items))
        facts = {"term_counts": per, "retained_counts": {x["term"]: x["retained"] for x in first}, "snapshot": snap.id, "term_cursor": str(more) if more else None}
        reasons = unknown + (["more occurrences are found than retained"] if total > snap.count else [])
        release(found, *([kept] if kept is not found else []))
        out = Result("any-of", "occurrences", [x.asDict() for x in rows], {"found": total, "retained": snap.count, "returned": len(rows)}, bool(reasons), reasons, cursor=str(after) if after else None, facts=facts)
        return self._coverage(r, out)

    def _near(self, found: DataFrame, r: Request, scoped: DataFrame) -> tuple[DataFrame, list[str]]:
        """Occurrences of terms (with their places) that lie wholly in changed lines and in the roles asked for."""
        reasons: list[str] = []
        placed = found.withColumn("from_", F.col("start")).withColumn("to_", F.col("end")).withColumn("start", F.col("start") + F.col("at")).withColumn("end", F.col("end") + F.col("at"))
        inside = lambda rows, ranges: S.with_role(rows, ranges.select("path", F.lit("").alias("role"), "start", "end"), [""], "term_index")
        if r.get("changes") is not None:
            ranges, reasons = self._changed_ranges(scoped)
            placed = inside(placed, ranges)
        if r.get("roles"):
            intervals, more = self._roles(found, r, scoped)
            reasons = reasons + more
            placed = inside(placed, intervals)
        return self._replaced(found, placed.withColumn("start", F.col("from_")).withColumn("end", F.col("to_")).select(*[c for c in found.columns if c != "at"])), reasons

    def _all_of(self, r: Request) -> Result:
        if r.get("within") != "function":
            scoped, unknown = self._timed(self._scoped(r), r, True)
            versioned = scoped.select("path", "text", content_hash(F.col("text")).alias("version"))
            if r.get("changes") is not None or r.get("roles"):
                # A source has all terms if enough is left of each of them where it may stand.
                hits, more = self._near(cut(S.any_of(S.all_of(versioned, r.get("allOf"), "path", "version", "text"), r.get("allOf"), "path", "version", places=True)), r, scoped)
                found = cut(hits.groupBy("path", "version").agg(F.count_distinct("term_index").alias("k")).where(F.col("k") == len(r.get("allOf"))).drop("k"))
                release(hits)
                unknown = unknown + more
            else:
                found = cut(S.all_of(versioned, r.get("allOf"), "path", "version"))
            return self._syntax(r, self._analysis("all-of", "files", found.select("path"), ["path"], manifest=found), unknown)
        if r.get("changes") is not None or r.get("roles"):
            raise EvidenceError("allOf within functions takes neither changes nor roles", "E_SELECTOR", issues=["changes", "roles"])
        provider = X.required(self.syntax, "allOf within functions")
        near, reasons = self._to_parse(r)
        manifest = A.manifest(near)
        found = cut(SX.all_of_in_functions(near, provider, S.checked_terms(r.get("allOf"))))
        rows = found.where("status = 'ok'").select("path", F.col("name").alias("scope"), "start", "end")
        return self._syntax(r, self._analysis("all-of", "functions", rows, ["path", "start", "end"], manifest=manifest), reasons + self._unparsed(found))

    def _syntax(self, r: Request, out: Result, reasons: list[str]) -> Result:
        out.reasons += reasons
        out.partial |= bool(reasons)
        return self._coverage(r, out)

    def _analysis(self, kind: str, unit: str, rows: DataFrame, order: list[str], snap_kind: str = "analysis", manifest: DataFrame | None = None, **more: Any) -> Result:
        snap = self.snapshots.add(snap_kind, rows, order, None, manifest)
        first, after = self.snapshots.page(Cursor(snap.id, snap_kind, 0), self.limits.page_items)
        return Result(kind, unit, [x.asDict(recursive=True) for x in first], {"found": snap.count, "retained": snap.count, "returned": len(first)}, cursor=str(after) if after else None, facts={"snapshot": snap.id, **more})

    # The other modes

    def _files(self, r: Request) -> Result:
        rows, unknown = self._timed(self._scoped(r), r, False)
        found = FI.discover(rows, r.get("query"), r.get("path") or "")
        out = self._analysis("files", "files", found.withColumn("order_", -F.col("score")), ["order_", "path"])
        out.reasons += unknown
        out.partial |= bool(unknown)
        return self._coverage(r, out)

    def _audit(self, r: Request) -> Result:
        literals = {p["id"]: p["literal"] for p in r.get("patterns")}
        # Settled before the scan; what it is compared with is read behind it.
        before = A.manifest(self.sources)
        ignored = self.sources.where("ignored") if "ignored" in self.sources.columns and r.get("ignorePolicy") != "include" else None
        scoped = self._scoped(r)
        counted = cut(A.audit(scoped, literals, True))
        after = self.current().select("path", content_hash(F.col("text")).alias("version"))
        changed = [x["path"] for x in A.changed_files(before, after).orderBy("path").limit(self.limits.page_items).collect()]
        closed = not self.reasons and not changed and (ignored is None or ignored.isEmpty())
        release(before)
        rows = [x.asDict() for x in counted.orderBy("id").collect()]
        for x in rows:
            if not x["matches"] and not closed:
                x["status"] = "unknown"
            x["reproduction"] = {"mode": "matches", "pattern": x["literal"], "literal": True}
        out = Result("audit", "findings", rows, {"found": len(rows), "returned": len(rows)}, not closed, [] if closed else ["coverage is not complete, so absence can't be told"])
        out.facts["searched_sources"] = scoped.count()
        if changed:
            out.facts["changed_sources"] = changed
            out.reasons.append("sources changed during the scan")
        return self._coverage(r, out)

    def _concept(self, r: Request) -> Result:
        encoder, (scoped, reasons) = M.required(self.encoder), self._bounded(r)
        manifest = A.manifest(scoped)
        every = cut(M.concept(scoped, r.get("query"), encoder, None, self.cache))
        total, order = every.count(), ["order_", "path", "line"]
        ranked = every.withColumn("order_", -F.col("ranking_score"))
        if total > self.limits.retained_lines:
            ranked = ranked.orderBy(*order).limit(self.limits.retained_lines)
            reasons = reasons + ["more passages are ranked than retained"]
        out = self._analysis("concept", "evidence-items", ranked, order, manifest=manifest)
        out.counts["found"] = total
        profile = ST.score_profile(every, "score").first()
        out.facts["score_profile"] = profile.asDict() if profile else None
        release(every)
        return self._syntax(r, out, reasons)

    def _hybrid(self, r: Request) -> Result:
        encoder, (scoped, reasons) = M.required(self.encoder), self._bounded(r)
        p = Pattern(r.get("query"), literal=True, ignore_case=None)
        manifest = A.manifest(scoped)
        # Passages count from the start of the text, and so do these.
        placed = cut(S.in_text(S.matching_lines(scoped, p, ranges=True, places=True)))
        # All passages: those that overlap a better one go before the best are taken.
        ranked = cut(M.concept(scoped, r.get("query"), encoder, None, self.cache))
        # The sources must be the same after the ranking as before the scan; otherwise they changed meanwhile.
        if not A.changed_files(manifest, scoped.select("path", content_hash(F.col("text")).alias("version"))).isEmpty():
            raise EvidenceError("the sources changed during the search", "E_SOURCES_CHANGED", recovery="retry")
        both = M.hybrid(placed, ranked, r.get("conceptLimit", self.limits.concept_limit))
        snap = self.snapshots.add("analysis-hybrid", both.withColumn("order_", -F.coalesce("score", F.lit(0.0))), ["tier", "order_", "path", "start"], None, manifest)
        rows = [x.asDict() for x in M.preview(snap.rows, most=self.limits.page_items).collect()]
        counts = {"found": snap.count, "retained": snap.count, "returned": len(rows), "exact": placed.count()}
        out = Result("hybrid", "evidence-items", rows, counts, cursor=str(Cursor(snap.id, snap.kind, 0)) if snap.count > len(rows) else None, facts={"snapshot": snap.id, "close_ranks": M.close_ranks(ranked)})
        if self.judge is not None:
            self._judged(r, out, scoped)
        release(placed, ranked)
        return self._syntax(r, out, reasons)

    def _bounded(self, r: Request) -> tuple[DataFrame, list[str]]:
        """The scoped sources: the first ``maxFilesToParse`` by path, if that is given."""
        return self._first(self._scoped(r), r)

    def _judged(self, r: Request, out: Result, scoped: DataFrame) -> None:
        """Classes for the rows of the page; the order follows them, and nothing is removed."""
        paths = sorted({x["path"] for x in out.rows})
        texts = {x["path"]: x["text"] for x in scoped.where(F.col("path").isin(*paths)).select("path", "text").collect()} if paths else {}
        verdicts, whole = M.judge_candidates(self.judge, r.get("query"), [texts[x["path"]][x["start"] : x["end"]] for x in out.rows])
        places = [i for i, v in enumerate(verdicts) if v is not None]
        ranked = sorted(places, key=lambda i: (self.judge.classes.index(verdicts[i][0]), -verdicts[i][1], i))
        rows = list(out.rows)
        for place, i in zip(places, ranked):
            rows[place] = out.rows[i] | {"class": verdicts[i][0], "probability": verdicts[i][1]}
        out.rows = rows
        if not whole:
            out.partial = True
            out.reasons.append("some candidates were not judged")

    def _structure(self, r: Request) -> Result:
        provider = X.required(self.syntax, "structure search")
        near, reasons = self._to_parse(r)
        if near.isEmpty() and not self._scoped(r).isEmpty():
            raise CapabilityError("no source in scope is in a language that the provider parses", recovery="choose-capability")
        manifest = A.manifest(near)
        found = cut(SX.facts(near, provider, "structure", r.get("pattern")))
        placed = found.where("status = 'ok'").join(near.select("path", "text"), "path")
        before = F.substring("text", F.lit(1), F.col("start").cast("int"))
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        shown = F.substring("text", (F.col("start") + 1).cast("int"), F.least(F.col("end") - F.col("start"), F.lit(self.limits.line_characters)).cast("int"))
        rows = placed.select("path", line.alias("line"), "start", "end", shown.alias("excerpt"))
        return self._syntax(r, self._analysis("structure", "occurrences", rows, ["path", "start", "end"], manifest=manifest), reasons + self._unparsed(found))

    def _outline(self, r: Request) -> Result:
        path = r.get("path")
        if not path.lower().endswith((".py", ".pyi")):
            X.required(self.syntax, f"the outline of {path}")
            if "symbols" not in (self.facts or {}):
                raise CapabilityError(f"no provider outlines {path}", recovery="choose-capability")
            rows = self.facts["symbols"].where(F.col("path") == path)
            return self._analysis("outline", "symbols", rows, ["start_line"])
        one = self.sources.where(F.col("path") == path)
        if one.isEmpty():
            raise EvidenceError(f"there is no source {path!r}", "E_PATH_NOT_FOUND")
        rows = X.outline(one)
        if r.get("symbol"):
            rows = rows.where(F.col("name") == r.get("symbol"))
        if r.get("line"):
            rows = rows.where((F.col("start_line") <= r.get("line")) & (F.col("end_line") >= r.get("line")))
        return self._analysis("outline", "symbols", rows, ["start_line", "name"])

    def _given(self) -> bool:
        """Whether there are fact tables of another provider."""
        return bool(self.facts) and {"imports", "exports", "declarations"} <= set(self.facts)

    def _module_facts(self, r: Request) -> tuple[DataFrame, DataFrame, list[str]]:
        """The facts of the Python sources in scope, the sources, and what could not be told."""
        provider = X.required(self.syntax, "the module graph")
        if "imports" not in provider.offers:
            raise CapabilityError("the syntax provider tells no imports", recovery="choose-capability")
        if not r.get("path").lower().endswith((".py", ".pyi")):
            raise CapabilityError(f"no provider reads the imports of {r.get('path')}", recovery="choose-capability")
        sources, reasons = self._first(self._scoped(r, path=False), r)
        if sources.where(F.col("path") == r.get("path")).isEmpty():
            raise EvidenceError(f"there is no source {r.get('path')!r} in scope", "E_PATH_NOT_FOUND")
        facts = cut(MO.python_facts(sources))
        return facts, sources, reasons + self._unparsed(facts.select(F.when(F.col("fact") == "syntax-error", F.col("fact")).otherwise(F.lit("ok")).alias("status")))

    def _chosen_imports(self, r: Request) -> Column:
        """The bindings of a source, of a line of it, or of a name."""
        wanted = F.col("path") == r.get("path")
        if r.get("line") is not None:
            wanted = wanted & F.col("line").between(F.lit(-1), r.get("line")) & (F.col("end_line") >= r.get("line"))
        if r.get("symbol"):
            wanted = wanted & ((F.col("local") == r.get("symbol")) | (F.col("imported") == r.get("symbol")))
        return wanted

    def _imports(self, r: Request) -> Result:
        if self._given():
            rows, reasons = self._given_traces().where(F.col("path") == r.get("path")), []
            if r.get("line") is not None:
                raise CapabilityError("the fact tables of imports have no lines; choose a symbol", recovery="choose-capability")
            if r.get("symbol"):
                rows = rows.where((F.col("local") == r.get("symbol")) | (F.col("name") == r.get("symbol")))
            return self._syntax(r, self._analysis("imports", "evidence-items", rows, ["path", "local"]), reasons)
        facts, sources, reasons = self._module_facts(r)
        manifest = A.manifest(sources.where(F.col("path") == r.get("path")))
        rows = MO.python_traces(facts, sources.select("path"), self._chosen_imports(r))
        out = self._analysis("imports", "evidence-items", rows, ["path", "local"], manifest=manifest)
        release(facts)
        if not out.counts["found"]:
            reasons = reasons + ["there is no import at that place"]
        return self._syntax(r, out, reasons)

    def _given_traces(self) -> DataFrame:
        return X.trace_imports(self.facts["imports"], self.facts["exports"], self.facts["declarations"], self.sources.select("path"))

    def _tests(self, r: Request) -> Result:
        if self._given():
            changed = self.sources.where(F.col("path") == r.get("path")).select("path")
            rows = X.related_tests(self._given_traces(), changed).withColumn("order_", (~F.col("test_like")).cast("int"))
            return self._coverage(r, self._analysis("tests", "evidence-items", rows, ["order_", "test", "target"]))
        facts, sources, reasons = self._module_facts(r)
        manifest = A.manifest(sources.where((F.col("path") == r.get("path")) | F.col("path").rlike(MO.TEST_SOURCE)))
        traces = MO.python_traces(facts, sources.select("path"))
        if r.get("symbol"):
            # Only imports that end at that name, or at the module that has it.
            traces = traces.where((F.col("name") == r.get("symbol")) | (F.col("status") == "module"))
        rows = MO.related_tests(facts, traces, sources, r.get("path"))
        order = F.when(F.col("association") == "direct", 0).when(F.col("association") == "indirect", 1).otherwise(2)
        out = self._analysis("tests", "evidence-items", rows.withColumn("order_", order).withColumn("case_", F.coalesce("case", F.lit(""))), ["order_", "test", "case_"], manifest=manifest)
        release(facts)
        return self._syntax(r, out, reasons)

    def _source_page(self, c: Cursor) -> Result:
        """The next page of a block that did not fit; only offsets that were given out are taken."""
        if c.snapshot not in self._going_on:
            raise CursorError("there is no such source page", "E_CURSOR_NOT_FOUND")
        path, pages = self._going_on[c.snapshot]
        text, following = pages.page(c.offset)
        cursor = str(Cursor(c.snapshot, "source", following)) if following is not None else None
        return Result("inspect", "source blocks", [{"path": path, "start_character": c.offset, "text": text}], {"returned": 1}, cursor is not None, ["the page is full"] if cursor else [], cursor=cursor)

    def _inspect(self, r: Request) -> Result:
        if r.get("cursor") and (c := Cursor.parse(r.get("cursor"))).kind == "source":
            return self._source_page(c)
        targets = r.get("targets") or ([{"path": r.get("path"), "line": r.get("line", 1)}] if r.get("path") else None)
        if targets is None:
            s, c = self.snapshots.get(r.get("cursor"))
            wanted = r.get("matchIndices") or [r.get("matchIndex", c.offset + 1)]
            targets = [{"path": x["path"], "line": x["line_no"]} for x in s.rows.where(F.col("ord").isin(*wanted)).orderBy("ord").collect()]
        if not 1 <= len(targets) <= self.limits.inspect_targets:
            raise EvidenceError(f"1 to {self.limits.inspect_targets} targets can be inspected", "E_INSPECT_TARGETS")
        paths = sorted({t["path"] for t in targets})
        texts = {x["path"]: x["text"] for x in self.sources.where(F.col("path").isin(*paths)).select("path", "text").collect()}
        missing = [p for p in paths if p not in texts]
        if missing:
            raise EvidenceError(f"there is no source {missing[0]!r}", "E_PATH_NOT_FOUND")
        windows: dict[str, list[list[int]]] = {}
        for t in targets:
            a, b = self._window(t["path"], texts[t["path"]], int(t.get("line", 1)))
            windows.setdefault(t["path"], []).append([a, b])
        if len(targets) == 1:
            ((path, ((a, b),)),) = windows.items()
            block = "\n".join(texts[path].split("\n")[a - 1 : b])
            if len(block.encode()) > self.limits.page_bytes:
                key = str(uuid.uuid4())
                self._going_on[key] = (path, AC.Continuations(block, self.limits.page_bytes))
                while len(self._going_on) > self.limits.snapshots:
                    self._going_on.popitem(last=False)
                out = self._source_page(Cursor(key, "source", 0))
                out.rows[0] |= {"start_line": a, "end_line": b}
                return out
        rows, room, cut_off = [], self.limits.page_bytes, False
        for path, spans in windows.items():
            lines = texts[path].split("\n")
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                while b >= a and len("\n".join(lines[a - 1 : b]).encode()) > room:
                    b, cut_off = b - max(1, (b - a + 1) // 4), True
                if b >= a:
                    block = "\n".join(lines[a - 1 : b])
                    room -= len(block.encode())
                    rows.append({"path": path, "start_line": a, "end_line": b, "text": block})
        return Result("inspect", "source blocks", rows, {"returned": len(rows)}, cut_off, ["the page is full"] if cut_off else [])

    def _window(self, path: str, text: str, line: int) -> tuple[int, int]:
        n = text.count("\n") + 1
        if path.endswith((".py", ".pyi")):
            around = [s for s in X.python_outline(text) if s[2] <= line <= s[3]]
            if around:
                inner = min(around, key=lambda s: s[3] - s[2])
                return inner[2], min(n, inner[3])
        return max(1, line - self.limits.inspect_lines), min(n, line + self.limits.inspect_lines)

    def _validate(self, r: Request) -> Result:
        """Saved evidence against the sources as they are now, by the versions that the search read."""
        s, c = self.snapshots.get(r.get("cursor"))
        reasons = list(s.facts.get("stored_reasons", []))
        if s.manifest is None:
            reasons.append("no source versions are kept with this result")
            return Result("validate", "sources", [], {"returned": 0}, True, reasons, facts={"validity": "unknown"})
        saved = s.manifest
        if "path" in s.rows.columns:
            kept = s.rows if r.get("matchIndex") is None else s.rows.where(F.col("ord") == r.get("matchIndex"))
            saved = saved.join(kept.select("path").distinct(), "path", "left_semi")
        most = self.limits.validated_sources
        # The first sources by path are checked, up to a bound; the others are unknown, and only counted.
        first = saved.orderBy("path").limit(most + 1).collect()
        rest = saved.count() - most if len(first) > most else 0
        checked = saved.sparkSession.createDataFrame([tuple(x) for x in first[:most]], "path string, version string")
        try:
            rows = [x.asDict() for x in A.validation_order(A.staleness(checked, self.current())).collect()]
        except (PySparkException, Py4JJavaError):
            # The files behind the sources are not what they were: nothing can be told about any of them.
            rows = [{"path": x["path"], "status": "unknown", "reason": "the sources can't be read any more"} for x in first[:most]]
        worst = next((x for x in ("stale", "unknown", "current") if any(y["status"] == x for y in rows)), "unknown")
        if rest:
            worst = "unknown" if worst == "current" else worst
            reasons.append(f"{rest} more sources were not checked")
        if not rows:
            reasons.append("no saved source could be checked")
        # Evidence that was partial when it was saved stays so, however current its sources are.
        reasons = ([] if worst == "current" else [f"saved evidence is {worst}"]) + reasons
        return Result("validate", "sources", rows, {"returned": len(rows), "unchecked": rest}, bool(reasons), reasons, facts={"validity": worst})

    def _capabilities(self, r: Request) -> Result:
        given = frozenset((lang, c) for lang in self.syntax.languages for c in self.syntax.offers) if self.syntax else frozenset()
        rows = FI.capabilities(self._scoped(r), given).orderBy("language", "capability").collect()
        return self._coverage(r, Result("capabilities", "languages", [x.asDict() for x in rows], {"returned": len(rows)}))

    def _redacted(self, out: Result) -> Result:
        """Mask secrets in the returned texts; counts, cursors and hashes stay exact."""
        spots = [(row, k) for row in out.rows for k, v in row.items() if isinstance(v, str) and k not in ("path", "status", "id")]
        lines = [(row["context"], i) for row in out.rows for i in range(len(row.get("context", [])))]
        if not spots and not lines:
            return out
        texts = [row[k] for row, k in spots] + [c[i][1] for c, i in lines]
        df = self.sources.sparkSession.createDataFrame(list(enumerate(texts)), "i int, t string")
        masked = {x["i"]: (x["m"], x["n"]) for x in df.select("i", redact(F.col("t")).alias("m"), redaction_count(F.col("t")).alias("n")).collect()}
        for i, (row, k) in enumerate(spots):
            row[k] = masked[i][0]
        for i, (c, k) in enumerate(lines, len(spots)):
            c[k] = (c[k][0], masked[i][0])
        out.facts["redacted"] = sum(n for _, n in masked.values())
        return out
