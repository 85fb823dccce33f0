"""Masking of secrets in displayed text; search and hashes always use the original.

A text is read from left to right by three small readers: blocks of private keys, then assignments to a name that
speaks of a secret, then tokens that begin with the mark of their issuer.  What a reader masks the next ones see as
masked.  Only texts in which a plain search finds a hint are handed to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The mask, the words that make a name sensitive, the values that only name a type, the marks of issuers.
MASK = "[REDACTED]"
SECRET_WORDS = ("password", "passwd", "secret", "token")
SECRET_PAIRS = (("api", "key"), ("access", "key"), ("access", "token"), ("private", "key"), ("service", "key"), ("secret", "access", "key"))
TYPE_NAMES = ("boolean", "number", "string", "unknown", "never", "undefined", "null")
TOKEN_MARKS = ("sk", "ghp", "xoxb", "xoxa", "xoxp", "xoxr", "xoxs")
KEY_LABEL = "PRIVATE KEY"
#: A token has at least so many characters behind its mark.
TOKEN_CHARACTERS = 8

_BEGIN, _END, _DASHES = "-----BEGIN ", "-----END ", "-----"
_RUN = re.compile(r"[A-Za-z0-9_-]+")
_SPACE = " \t\n\r\f\v"
_BARE_ENDS = re.compile(r"[\s,;}]")


def sensitive(name: str) -> bool:
    """Whether a name, taken apart at ``_`` and ``-``, has a secret word, or a pair of words in one or in a row."""
    parts = re.split("[_-]", name.lower())
    if not all(parts):
        return False
    for i, part in enumerate(parts):
        if part in SECRET_WORDS or any("".join(pair) == part or tuple(parts[i : i + len(pair)]) == pair for pair in SECRET_PAIRS):
            return True
        if part[0].isdigit():
            return False  # words before the secret one begin with a letter
    return False


def _skip(text: str, at: int, of: str) -> int:
    while at < len(text) and text[at] in of:
        at += 1
    return at


def _value_end(text: str, at: int) -> int:
    """Where the value that begins at ``at`` ends: behind its closing quote on the same line, or at a delimiter."""
    if text[at : at + 1] in ('"', "'"):
        end = text.find(text[at], at + 1)
        if end > 0 and not {"\n", "\r"} & set(text[at:end]):
            return end + 1
    end = _BARE_ENDS.search(text, at)
    return end.start() if end else len(text)


def _names_a_type(text: str, at: int) -> bool:
    bare = _skip(text, at, "\"'") if text[at : at + 1] in ('"', "'") else at
    if bare > at + 1:
        return False
    word = re.compile(r"[A-Za-z]*").match(text, bare)
    rest = word.end() + (text[word.end() : word.end() + 1] in ('"', "'"))
    return word[0].lower() in TYPE_NAMES and (rest >= len(text) or bool(_BARE_ENDS.match(text, rest)))


def _key_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find(_BEGIN)
    while at >= 0:
        begin = at + len(_BEGIN)
        stop = text.find("-", begin)
        label = text[begin:stop] if stop >= 0 else ""
        following = begin
        if label.endswith(KEY_LABEL) and text.startswith(_DASHES, stop) and "\n" not in label and "\r" not in label:
            end = text.find(f"{_END}{label}{_DASHES}", stop + len(_DASHES))
            if end >= 0:
                yield stop + len(_DASHES), end, f"\n{MASK}\n"
                following = end
        at = text.find(_BEGIN, following)


def _assignments(text: str) -> Iterator[tuple[int, int, str]]:
    behind = 0
    for run in _RUN.finditer(text):
        if run.start() < behind:
            continue
        at = _skip(text, run.end() + (text[run.end() : run.end() + 1] in ('"', "'")), _SPACE)
        if text[at : at + 1] not in (":", "=") or not text[at:] or not sensitive(run[0]):
            continue
        value = _skip(text, at + 1, _SPACE)
        end = _value_end(text, value)
        if end > value and not _names_a_type(text, value):
            yield value, end, f'"{MASK}"'
            behind = end


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _RUN.finditer(text):
        start, stop = run.start(), len(run[0].rstrip("-")) + run.start()
        while start < stop:
            mark = next((m for m in TOKEN_MARKS if text.startswith(m, start)), None)
            body = start + len(mark) + 1 if mark else stop
            if mark and text[body - 1] in "-_" and stop - body >= TOKEN_CHARACTERS and text[body].isalnum():
                yield start, stop, MASK
                break
            # A word within the run begins behind a hyphen.
            hyphen = text.find("-", start, stop)
            start = hyphen + 1 if hyphen >= 0 else stop


def mask(text: str) -> tuple[str, int]:
    """The masked text, and how many places were masked."""
    count = 0
    for reader in (_key_blocks, _assignments, _tokens):
        parts, at = [], 0
        for start, end, instead in reader(text):
            parts += [text[at:start], instead]
            at = end
            count += 1
        text = "".join([*parts, text[at:]])
    return text, count


#: Every secret has one of these in lower case.
_HINTS = ("password", "passwd", "secret", "token", "key", "sk-", "sk_", "ghp", "xox")


def _suspicious(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [low.contains(h) for h in _HINTS])


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("places", LongType())]))
def _masked(column: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mask(t) if t is not None else (None, 0) for t in column], columns=["text", "places"])


def _read(text: Column) -> Column:
    """Texts without a hint stay behind: Python is given null in their place."""
    return _masked(F.when(_suspicious(text), text))


def redact(text: Column) -> Column:
    """The text with key blocks, sensitive assignments and marked tokens masked."""
    return F.coalesce(_read(text)["text"], text)


def redaction_count(text: Column) -> Column:
    """How many places :func:`redact` masks."""
    return F.coalesce(_read(text)["places"], F.lit(0)).cast("long")
