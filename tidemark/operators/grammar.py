"""The search language: text to a flat list of terms.

A query is a sequence of terms joined by AND (the default) or OR, each possibly negated by NOT, ``-`` or ``!=``; there
are no parentheses and no precedence, terms fold from left to right.  ``field=value`` and ``field:value`` compare,
``field~pattern`` matches a regular expression, anything else is free text.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from enum import Enum

#: Fixed field keywords.
FIELDS = ("level", "source", "sourcetype", "source_id", "message", "raw", "tag", "event_id", "host", "process", "subsystem", "category", "after", "before")


class Kind(Enum):
    TEXT = "text"
    FIELD = "field"


@dataclass(frozen=True)
class Term:
    kind: Kind
    value: str
    field: str | None = None
    regex: bool = False
    negated: bool = False
    is_or: bool = False


def tokenize(text: str) -> list[str]:
    """Words; a double quote anywhere switches quoting, in which white space belongs to the word. Quotes and empty words vanish."""
    words, current, quoted = [], [], False
    for c in text:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            words.append("".join(current))
            current = []
        else:
            current.append(c)
    words.append("".join(current))
    return [w for w in words if w]


def _term(word: str) -> tuple[Kind, str | None, str, bool, bool]:
    """Kind, field, value, whether a regular expression, whether negated by ``!=``."""
    name, bang, value = word.partition("!=")
    if bang and name.lower() in FIELDS:
        return Kind.FIELD, name.lower(), value, False, True
    at = min((i for i in map(word.find, "=:~") if i >= 0), default=-1)
    if at >= 0 and word[:at].lower() in FIELDS:
        return Kind.FIELD, word[:at].lower(), word[at + 1 :], word[at] == "~", False
    return Kind.TEXT, None, word, False, False


def parse(text: str) -> list[Term]:
    terms: list[Term] = []
    is_or = negate = False
    for word in tokenize(text):
        keyword = word.upper()
        if keyword in ("AND", "OR"):
            is_or = keyword == "OR"
        elif keyword == "NOT":
            negate = True
        else:
            if word.startswith("-") and len(word) > 1:
                word, negate = word[1:], True
            kind, field, value, regex, bang = _term(word)
            terms.append(Term(kind, value, field, regex, negate or bang, is_or))
            is_or = negate = False
    return terms


_TIME_SHAPES = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d")


def parse_time(text: str) -> datetime | None:
    """A bound of ``after`` or ``before``: date, or date and time by ``T`` or a space, seconds and fraction optional."""
    t = text.strip().replace(" ", "T", 1)
    head, dot, fraction = t.partition(".")
    if dot and (not fraction.isdigit() or not fraction.isascii()):
        return None
    for shape in _TIME_SHAPES:
        try:
            return datetime.strptime(head + (dot + fraction[:6] if dot else ""), shape)
        except ValueError:
            continue
    return None
