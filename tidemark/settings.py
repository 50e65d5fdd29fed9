"""Settings of an analyst, kept in a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from tidemark.functions.timezones import Zone
from tidemark.operators.rulefiles import quoted


@dataclass(frozen=True)
class Settings:
    """Sessions may lie in any store that Spark reads; the rules of a local ``rules_dir`` are applied with the built-in ones, if it is there.

    ``load_group``: files that are loaded at a time.
    """

    sessions_dir: str = "sessions"
    rules_dir: str = "rules"
    load_group: int = 64
    default_source_timezone: str | None = None
    display_timezone: str = "UTC"

    def validate(self) -> Settings:
        """Itself; an error for a zone that is none, or no files at a time."""
        for zone in (self.default_source_timezone, self.display_timezone):
            if zone is not None:
                Zone.parse(zone)
        if self.load_group < 1:
            raise ValueError("load_group is 1 at least")
        return self

    @classmethod
    def read(cls, path: str | Path) -> Settings:
        """Of a file; a missing one gives the defaults, and unknown names are ignored."""
        if not Path(path).exists():
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in tomllib.loads(Path(path).read_text()).items() if k in known}).validate()

    def write(self, path: str | Path) -> None:
        lines = [f"{k} = {v if isinstance(v, int) else quoted(v)}" for k, v in asdict(self.validate()).items() if v is not None]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("\n".join([*lines, ""]))
