"""The request contract: modes, the fields each takes, bounds, and typed errors with a way on."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import EvidenceError

# The names of modes and fields.  Which mode takes a field is said once, at the field.
_SEARCH = ("auto", "summary", "matches")
_PLACES = ("outline", "imports", "tests")
_GRAPH = ("imports", "tests")
_MEANING = ("concept", "hybrid")
_WHOLE = ("audit", "files", "structure", "capabilities", *_MEANING)
_WAITING = ("await", "cancel")
MODES = (*_SEARCH, "audit", "inspect", *_PLACES, "files", "structure", *_MEANING, "validate", "capabilities", *_WAITING)
_TAKEN_BY: dict[str, tuple[str, ...]] = {
    "mode": MODES,
    "redact": tuple(m for m in MODES if m not in _WAITING),
    "operationId": _WAITING,
    # What is looked for.
    "pattern": (*_SEARCH, "structure"),
    "anyOf": _SEARCH,
    "allOf": _SEARCH,
    "patterns": ("audit",),
    "query": ("files", *_MEANING),
    "targets": ("inspect",),
    # How it is read.
    "literal": _SEARCH,
    "ignoreCase": _SEARCH,
    "wholeWord": _SEARCH,
    "within": _SEARCH,
    "roles": _SEARCH,
    "changes": _SEARCH,
    # Where.
    "path": (*_SEARCH, "inspect", *_PLACES, *_WHOLE),
    "glob": (*_SEARCH, *_GRAPH, *_WHOLE),
    "exclude": (*_SEARCH, *_GRAPH, *_WHOLE),
    "hidden": (*_SEARCH, *_GRAPH, *_WHOLE),
    "ignorePolicy": (*_SEARCH, "audit"),
    "scope": _SEARCH,
    "modifiedAfter": (*_SEARCH, "files"),
    "modifiedBefore": (*_SEARCH, "files"),
    "line": ("inspect", *_PLACES),
    "symbol": _PLACES,
    # How much.
    "context": _SEARCH,
    "limit": _SEARCH,
    "conceptLimit": ("hybrid",),
    "maxFilesToParse": (*_SEARCH, *_PLACES, "structure", *_MEANING),
    # From where it goes on.
    "cursor": (*_SEARCH, "inspect", *_PLACES, "validate"),
    "matchIndex": (*_SEARCH, "inspect", *_PLACES, "validate"),
    "matchIndices": ("inspect",),
}
FIELDS: dict[str, tuple[str, ...]] = {mode: tuple(f for f, modes in _TAKEN_BY.items() if mode in modes) for mode in MODES}
#: Fields of a search for a pattern that several terms have no use for.
_PATTERN_ONLY = ("literal", "ignoreCase", "wholeWord", "context")
#: Fields that mean nothing in a mode, so that leaving them out does not change the request.
DROPPABLE = {"files": ("scope",)}
#: What is deliberately not offered.
REFUSED = ("definitions", "references", "implementations", "callers", "callees", "dependencies", "dependents", "trace", "impact")


@dataclass(frozen=True)
class Limits:
    """Bounds that are part of the results' meaning; each is a parameter."""

    retained_lines: int = 50_000
    retained_occurrences: int = 50_000
    retained_bytes: int = 32 << 20
    line_characters: int = 500
    page_bytes: int = 16_384
    page_matches: int = 100
    page_items: int = 30
    summary_files: int = 30
    context_lines: int = 20
    source_bytes: int = 5 << 20
    globs: int = 64
    path_characters: int = 4096
    pattern_characters: int = 65_536
    query_characters: int = 256
    concept_limit: int = 3
    max_concept_limit: int = 20
    snapshots: int = 20
    snapshot_seconds: float = 600.0
    inspect_targets: int = 5
    inspect_lines: int = 10
    validated_sources: int = 200
    diff_steps: int = 2_000_000
    #: Bytes of a page that are kept for its head and for the request that goes on.
    page_reserve: int = 1024
    summary_reserve: int = 3584
    #: Bytes of term counts in one page.
    term_bytes: int = 8192


@dataclass(frozen=True)
class Request:
    mode: str = "auto"
    fields: Mapping[str, Any] = field(default_factory=dict)

    def get(self, name: str, default: Any = None) -> Any:
        value = self.fields.get(name)
        return default if value is None else value


def _next(raw: Mapping[str, Any]) -> dict | None:
    """A request to offer instead, if it is small enough to print."""
    return dict(raw) if len(json.dumps(raw, default=str).encode()) <= 64 << 10 else None


def parse(raw: Mapping[str, Any], limits: Limits = Limits()) -> Request:
    """Check a flat request; unknown fields are errors, never ignored."""
    mode = raw.get("mode") or "auto"
    if mode in REFUSED:
        raise EvidenceError(f"{mode!r} is not offered: it needs a compiler's view of the code", "E_MODE_REFUSED", recovery="choose-capability")
    if mode not in FIELDS:
        raise EvidenceError(f"unknown mode {mode!r}", "E_MODE_UNKNOWN", recovery="choose-capability")
    extra = [k for k in raw if k not in FIELDS[mode]]
    if extra:
        kept = {k: v for k, v in raw.items() if k not in extra}
        safe = all(k in DROPPABLE.get(mode, ()) for k in extra)
        raise EvidenceError(f"mode {mode} does not take: {', '.join(sorted(extra))}", "E_FIELD_UNKNOWN", recovery="retry" if safe else "manual", next_request=_next(kept) if safe else None, issues=sorted(extra))
    r = Request(mode, {k: v for k, v in raw.items() if k != "mode"})
    _bounds(r, limits)
    _shape(r)
    return r


def _bounds(r: Request, limits: Limits) -> None:
    bad: list[str] = []

    def text(name: str, most: int, one_line: bool = False):
        v = r.get(name)
        if v is not None and (not isinstance(v, str) or len(v) > most or "\0" in v or (one_line and "\n" in v)):
            bad.append(name)

    def number(name: str, low: int, high: int):
        v = r.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high):
            bad.append(name)

    text("pattern", limits.pattern_characters)
    text("path", limits.path_characters)
    text("query", limits.query_characters, True)
    number("context", 0, limits.context_lines)
    number("limit", 1, limits.page_matches)
    number("conceptLimit", 1, limits.max_concept_limit)
    number("line", 1, 2**53 - 1)
    number("matchIndex", 1, 2**53 - 1)
    number("maxFilesToParse", 1, 2**53 - 1)
    for name in ("glob", "exclude"):
        v = r.get(name)
        if v is not None and (not isinstance(v, (list, tuple)) or len(v) > limits.globs or any(not isinstance(x, str) or not x or len(x) > limits.path_characters for x in v)):
            bad.append(name)
    for name in ("literal", "ignoreCase", "wholeWord", "hidden", "redact"):
        if r.get(name) is not None and not isinstance(r.get(name), bool):
            bad.append(name)
    if r.get("scope") not in (None, "auto", "strict"):
        bad.append("scope")
    if r.get("ignorePolicy") not in (None, "respect", "include"):
        bad.append("ignorePolicy")
    if bad:
        raise EvidenceError(f"out of bounds: {', '.join(bad)}", "E_FIELD_BOUNDS", issues=bad)


def _shape(r: Request) -> None:
    """Which fields a request needs, and which exclude each other."""

    def need(name: str):
        if r.get(name) is None:
            raise EvidenceError(f"mode {r.mode} needs {name}", "E_FIELD_MISSING", issues=[name])

    if r.mode in ("auto", "summary", "matches"):
        asked = [n for n in ("pattern", "anyOf", "allOf", "cursor") if r.get(n) is not None]
        if len(asked) != 1:
            raise EvidenceError("exactly one of pattern, anyOf, allOf or cursor is needed", "E_SELECTOR", issues=asked)
        if r.mode == "summary" and (r.get("anyOf") or r.get("allOf")):
            raise EvidenceError("several terms have no summary", "E_SELECTOR", issues=["mode"])
        if r.get("within") and not r.get("allOf"):
            raise EvidenceError("within needs allOf", "E_SELECTOR", issues=["within"])
        useless = [n for n in _PATTERN_ONLY if r.get(n) is not None] if asked[0] in ("anyOf", "allOf") else []
        if r.get("scope") == "auto" and asked[0] in ("anyOf", "allOf"):
            useless.append("scope")
        if r.get("matchIndex") is not None:
            useless.append("matchIndex")
        if asked[0] == "cursor":
            useless += [n for n in ("roles", "changes", "context", "path", "exclude") if r.get(n) is not None]
        if useless:
            raise EvidenceError(f"{asked[0]} is not combined with {', '.join(useless)}", "E_SELECTOR", issues=useless)
    elif r.mode == "audit":
        need("patterns")
    elif r.mode in ("files", "concept", "hybrid"):
        need("query")
    elif r.mode == "structure":
        need("pattern")
    elif r.mode in _PLACES:
        if r.get("cursor") is None:
            need("path")
        elif r.get("path") is not None:
            raise EvidenceError("a path or a match of a cursor is needed, not both", "E_SELECTOR", issues=["path", "cursor"])
        if r.get("matchIndex") is not None:
            need("cursor")
    elif r.mode == "validate":
        need("cursor")
    elif r.mode in ("await", "cancel"):
        need("operationId")
    elif r.mode == "inspect" and not any(r.get(n) is not None for n in ("path", "cursor", "targets")):
        raise EvidenceError("inspect needs a path, targets or a cursor", "E_FIELD_MISSING", issues=["path"])


def context_tier(remaining: float) -> tuple[str, int]:
    """How many tokens a page may take when a share of the context is left."""
    if remaining > 0.40:
        return "full", 2000
    return ("critical", 500) if remaining < 0.12 else ("tight", 1000)


def page_room(limits: Limits, remaining: float | None) -> int:
    """Bytes of a page of matches; four for each token that the context leaves, less what the page itself needs."""
    room = limits.page_bytes - limits.page_reserve
    return room if remaining is None else min(room, 4 * context_tier(remaining)[1] - 512)


def summary_room(limits: Limits, remaining: float | None) -> int:
    """Bytes of the files of a summary; where a page's tokens leave too little, 256."""
    room = limits.page_bytes - limits.summary_reserve
    return room if remaining is None else min(room, max(256, 4 * context_tier(remaining)[1] - 2400))
