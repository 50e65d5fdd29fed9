"""Edits of query text by filter controls; the text is the only state.

A text is a list of clauses, each a word as it was typed, quotes included, with the keywords before it.  Controls look
for the clause whose term is theirs, change the list and print it; what they do not own stays as it was typed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from tidemark.operators.grammar import Term, parse

#: Fixed fields with a single-value column filter.
COLUMN_FILTERS = ("sourcetype", "host", "process", "event_id", "subsystem", "category")
_WORD = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')


@dataclass(frozen=True)
class Clause:
    """A word and the keywords typed before it."""

    word: str
    keywords: tuple[str, ...] = ()

    @cached_property
    def term(self) -> Term | None:
        found = parse(str(self))
        return found[0] if found else None

    def __str__(self) -> str:
        return " ".join([*self.keywords, self.word])


def clauses(text: str) -> list[Clause]:
    out, keywords = [], []
    for word in _WORD.findall(text):
        if word.replace('"', "").upper() in ("AND", "OR", "NOT"):
            keywords.append(word)
        else:
            out.append(Clause(word, tuple(keywords)))
            keywords = []
    return out + [Clause(w) for w in keywords]


def _print(found: list[Clause]) -> str:
    return " ".join(map(str, found))


def _is(field: str, value: str | None = None, negated: bool = False, regex: bool = False) -> Callable[[Clause], bool]:
    """Whether a clause compares ``field`` (with ``value``) in the given way."""

    def test(c: Clause) -> bool:
        t = c.term
        return t is not None and t.field == field and (value is None or t.value == value) and t.negated == negated and t.regex == regex

    return test


def _choice(field: str) -> Callable[[Clause], bool]:
    """Whether a clause is the multiple choice of ``field``."""
    is_pattern = _is(field, regex=True)
    return lambda c: is_pattern(c) and c.term.value.startswith("^(?:") and c.term.value.endswith(")$")


def _replaced(found: list[Clause], mine: Callable[[Clause], bool], word: str | None) -> list[Clause]:
    """The first clause of ``mine`` with another word, or without it (None); a new word comes last."""
    at = next((k for k, c in enumerate(found) if mine(c)), None)
    new = [] if word is None else [Clause(word, found[at].keywords if at is not None else ())]
    return found + new if at is None else found[:at] + new + found[at + 1 :]


def values(text: str, field: str) -> list[str]:
    """Values of a multiple choice, from its ``field~^(?:a|b)$`` term."""
    found = next(filter(_choice(field), clauses(text)), None)
    return found.term.value[4:-2].split("|") if found else []


def _choice_word(field: str, chosen: list[str]) -> str | None:
    return _quoted(f"{field}~^(?:{'|'.join(chosen)})$") if chosen else None


def set_values(text: str, field: str, chosen: list[str]) -> str:
    """Replace a multiple choice in its place; values are part of a pattern and are not escaped."""
    if field == "tag":
        return _with_tags(text, chosen, is_untagged(text))
    return _print(_replaced(clauses(text), _choice(field), _choice_word(field, chosen)))


def toggle_value(text: str, field: str, value: str) -> str:
    now = values(text, field)
    return set_values(text, field, [v for v in now if v != value] if value in now else [*now, value])


_UNTAGGED = _is("tag", "*", negated=True)


def is_untagged(text: str) -> bool:
    return any(map(_UNTAGGED, clauses(text)))


def toggle_untagged(text: str) -> str:
    return _with_tags(text, values(text, "tag"), not is_untagged(text))


def _with_tags(text: str, chosen: list[str], untagged: bool) -> str:
    """Tags and "untagged" are one OR block at the front, because terms fold from the left."""
    mine = _choice("tag")
    block = [Clause(_choice_word("tag", chosen))] if chosen else []
    if untagged:
        block.append(Clause("tag=*", ("OR", "NOT") if block else ("NOT",)))
    return _print(block + [c for c in clauses(text) if not mine(c) and not _UNTAGGED(c)])


def _hides(source_id: str) -> Callable[[Clause], bool]:
    return _is("source_id", source_id, negated=True)


def is_hidden(text: str, source_id: str) -> bool:
    return any(map(_hides(source_id), clauses(text)))


def _show(text: str, source_id: str) -> str:
    mine = _hides(source_id)
    return _print([c for c in clauses(text) if not mine(c)])


def toggle_source(text: str, source_id: str) -> str:
    if is_hidden(text, source_id):
        return _show(text, source_id)
    return _print([*clauses(text), Clause(f"source_id={source_id}", ("NOT",))])


def solo_source(text: str, source_id: str, all_ids: list[str]) -> str:
    for other in all_ids:
        if is_hidden(text, other) != (other != source_id):
            text = toggle_source(text, other)
    return text


def show_all_sources(text: str, all_ids: list[str]) -> str:
    for other in all_ids:
        text = _show(text, other)
    return text


def _quoted(word: str) -> str:
    return f'"{word}"' if any(c.isspace() for c in word) else word


def column_filter(text: str, field: str) -> str | None:
    found = next(filter(_is(field), clauses(text)), None)
    return found.term.value if found else None


def set_column_filter(text: str, field: str, value: str | None) -> str:
    """Set, replace or (None) remove ``field=value``."""
    return _print(_replaced(clauses(text), _is(field), None if value is None else _quoted(f"{field}={value}")))


def set_time_range(text: str, after: datetime | None, before: datetime | None) -> str:
    for field, at in (("after", after), ("before", before)):
        text = set_column_filter(text, field, None if at is None else at.strftime("%Y-%m-%dT%H:%M:%S"))
    return text


def context_window(at: datetime, minutes: int) -> str:
    """Query for the entries within ``minutes`` of a moment."""
    d = timedelta(minutes=minutes)
    return f"after={(at - d).isoformat(timespec='milliseconds')} before={(at + d).isoformat(timespec='milliseconds')}"
