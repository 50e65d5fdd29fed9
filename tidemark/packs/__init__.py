"""Built-in rule packs, message templates and text formats, as data files."""

from __future__ import annotations

import tomllib
from functools import cache
from importlib.resources import files

from tidemark.operators.tagging import Rule
from tidemark.sources.formats import TextFormat

RULE_PACKS = ("aul", "evtx", "journald")


def _data(name: str) -> dict:
    return tomllib.loads((files(__package__) / f"{name}.toml").read_text(encoding="utf-8"))


@cache
def rules(sourcetype: str) -> list[Rule]:
    """The rules of one pack; all of them are for its sourcetype."""
    out = []
    for name, body in _data(f"{sourcetype}_rules").items():
        match = {"sourcetype": sourcetype} | {k: v for k, v in body.items() if k != "tag"}
        out.append(Rule.from_dict({"rule": {"name": name, "match": match, "tag": {"value": body["tag"]}}}))
    return out


def all_rules(packs: tuple[str, ...] = RULE_PACKS) -> list[Rule]:
    return [r for p in packs for r in rules(p)]


@cache
def templates() -> dict[tuple[str, int], str]:
    """Message templates by provider and event id."""
    return {(provider, int(event)): text for provider, events in _data("evtx_templates").items() for event, text in events.items()}


@cache
def text_formats() -> dict[str, TextFormat]:
    return {
        key: TextFormat(d["name"], d["sourcetype"], d["regex"], d["timestamp_format"], d.get("multiline_start_pattern"), mapping={k: d[k] for k in ("level", "message") if k in d})
        for key, d in _data("text_formats").items()
    }
