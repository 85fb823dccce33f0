"""Typed errors of the engine; each has a stable code."""

from __future__ import annotations


class EvidenceError(Exception):
    """Base of all errors that a request can cause."""

    code = "E_REQUEST"

    def __init__(self, message: str, code: str | None = None, *, recovery: str = "manual", next_request: dict | None = None, issues: list[str] | None = None):
        super().__init__(message)
        self.code = code or self.code
        #: retry, choose-capability or manual
        self.recovery = recovery
        #: only where another request has the same meaning
        self.next_request = next_request
        self.issues = issues or []


class RegexError(EvidenceError):
    code = "E_REGEX_INVALID"


class CursorError(EvidenceError):
    code = "E_CURSOR"


class CapabilityError(EvidenceError):
    code = "E_CAPABILITY_UNAVAILABLE"
