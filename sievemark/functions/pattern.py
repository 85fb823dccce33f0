"""Search patterns: literal or regular expression, case mode and whole words, as one Java regular expression.

The dialect is that of automata-based engines: look-around and back-references are refused, a line is matched at a
time, and character classes are those of Unicode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import RegexError

_SPECIAL = re.compile(r"([\\.+*?()\[\]{}|^$#&~\-])")
_BACK_REFERENCE = re.compile(r"\\(?:[1-9]|k[<{'])")
_LOOK_AROUND = re.compile(r"\(\?(?:<?[=!]|>)")
_ESCAPE = re.compile(r"\\(?:[pPxuU]\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)", re.S)


def escape(literal: str) -> str:
    """A regular expression that matches the literal."""
    return _SPECIAL.sub(r"\\\1", literal)


def smart_case_is_sensitive(pattern: str, literal: bool) -> bool:
    """Whether the pattern has an upper-case letter of its own; letters of escapes such as ``\\S`` don't count."""
    text = pattern if literal else _ESCAPE.sub("", pattern)
    return any(c.isupper() for c in text)


@dataclass(frozen=True)
class Pattern:
    """``ignore_case``: True, False, or None for smart case."""

    text: str
    literal: bool = False
    ignore_case: bool | None = False
    whole_word: bool = False

    def __post_init__(self):
        if not self.text or "\0" in self.text or len(self.text) > 65_536:
            raise RegexError("a pattern has 1 to 65,536 characters and no NUL", "E_PATTERN")
        if not self.literal:
            bare = re.sub(r"\\\\", "", self.text)
            if _BACK_REFERENCE.search(bare) or _LOOK_AROUND.search(bare):
                raise RegexError("look-around and back-references are not supported")
            try:
                re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\z", ".", self.text))
            except re.error as e:
                raise RegexError(f"invalid regular expression: {e}") from e

    @property
    def insensitive(self) -> bool:
        return not smart_case_is_sensitive(self.text, self.literal) if self.ignore_case is None else self.ignore_case

    @property
    def plain(self) -> bool:
        """Whether substring search decides a line."""
        return self.literal and not self.insensitive and not self.whole_word

    @property
    def java(self) -> str:
        body = escape(self.text) if self.literal else self.text
        if self.whole_word:
            body = rf"(?<!\w)(?:{body})(?!\w)"
        return ("(?iuU)" if self.insensitive else "(?U)") + body

    @property
    def may_be_empty(self) -> bool:
        if self.literal:
            return False
        return re.compile(re.sub(r"\\[pP]\{[^}]*\}", ".", self.text)).match("") is not None or bool(re.search(r"[\^$]|\\b|\\B", self.text))
