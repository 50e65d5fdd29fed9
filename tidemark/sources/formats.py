"""Configurations of text logs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

import regex

from tidemark.functions.timezones import BadTime, TimeFormat, Zone
from tidemark.operators.rulefiles import quoted, slug


class BadFormat(ValueError):
    """A text format that cannot work."""


@dataclass(frozen=True)
class TextFormat:
    """How records of a text log begin, are matched and are mapped. ``mapping`` gives level and message the names of groups."""

    name: str
    sourcetype: str
    pattern: str
    timestamp_format: str
    multiline_start: str | None = None
    assume_offset: str | None = None
    assume_year: int | None = None
    mapping: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_toml(cls, text: str) -> TextFormat:
        try:
            p = tomllib.loads(text)["parser"]
            pattern = p["pattern"]
            return cls(
                p["name"], p["sourcetype"], pattern["regex"], pattern["timestamp_format"], pattern.get("multiline_start_pattern"),
                pattern.get("assume_offset"), pattern.get("assume_year"), dict(p.get("field_mapping", {})),
            )
        except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
            raise BadFormat(f"bad text format: {e}") from None

    def to_toml(self) -> str:
        lines = ["[parser]", f"name = {quoted(self.name)}", f"sourcetype = {quoted(self.sourcetype)}", "", "[parser.pattern]", f"regex = {quoted(self.pattern)}", f"timestamp_format = {quoted(self.timestamp_format)}"]
        if self.multiline_start is not None:
            lines.append(f"multiline_start_pattern = {quoted(self.multiline_start)}")
        if self.assume_offset is not None:
            lines.append(f"assume_offset = {quoted(self.assume_offset)}")
        if self.assume_year is not None:
            lines.append(f"assume_year = {self.assume_year}")
        return "\n".join([*lines, "", "[parser.field_mapping]", *(f"{k} = {quoted(v)}" for k, v in self.mapping.items()), ""])

    def save(self, folder: str | Path) -> Path:
        """Write the format, if it can work, to a file named after it; an existing file is replaced."""
        self.validate()
        path = Path(folder) / f"{slug(self.name)}.toml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.to_toml())
        return path

    def with_assumptions(self, offset: str | None = None, year: int | None = None) -> TextFormat:
        """Fill what the format does not say itself."""
        return replace(self, assume_offset=self.assume_offset or offset, assume_year=self.assume_year if self.assume_year is not None else year)

    def validate(self) -> TextFormat:
        """Itself; an error for bad patterns, a missing timestamp group, or a mapping to or from an unknown name."""
        try:
            main = regex.compile(self.pattern)
            if self.multiline_start is not None:
                regex.compile(self.multiline_start)
        except regex.error as e:
            raise BadFormat(f"bad pattern: {e}") from None
        if "timestamp" not in main.groupindex:
            raise BadFormat("the pattern has no group named timestamp")
        for target, group in self.mapping.items():
            if target not in ("level", "message"):
                raise BadFormat(f"unknown mapping target {target!r}")
            if group not in main.groupindex:
                raise BadFormat(f"mapping names an unknown group {group!r}")
        try:
            TimeFormat(self.timestamp_format)
            if self.assume_offset is not None:
                Zone.parse(self.assume_offset)
        except BadTime as e:
            raise BadFormat(str(e)) from None
        return self


def saved_formats(folder: str | Path) -> list[tuple[str, TextFormat]]:
    """(name, format) of the readable ``.toml`` files of a folder, sorted by name; unreadable ones are left out, a missing folder is empty."""
    out = []
    for p in sorted(Path(folder).glob("*.toml")) if Path(folder).is_dir() else []:
        try:
            f = TextFormat.from_toml(p.read_text())
        except (BadFormat, OSError, UnicodeDecodeError):
            continue
        out.append((f.name, f))
    return sorted(out, key=lambda x: x[0])
