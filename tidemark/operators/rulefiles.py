"""Rule files on the driver: scan, load, create, extend."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from tidemark.operators.tagging import BadRule, Rule


def scan(folder: str | Path) -> list[Path]:
    """The ``.toml`` files of a folder itself, sorted; a missing folder is an error."""
    return sorted(p for p in Path(folder).iterdir() if p.suffix == ".toml" and p.is_file())


def load(paths: list[str | Path]) -> list[Rule]:
    """All rules; one bad file fails the call."""
    rules = []
    for p in paths:
        try:
            rules.append(Rule.from_toml(Path(p).read_text()))
        except (BadRule, OSError, UnicodeDecodeError) as e:
            raise BadRule(f"{p}: {e}") from None
    return rules


def slug(name: str) -> str:
    """Lower-case ASCII letters and digits joined by single underscores; ``rule`` for none."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower() if name.isascii() else re.sub(r"[^\x00-\x7f]", " ", name).lower())) or "rule"


def quoted(text: str) -> str:
    """A TOML basic string."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in text) + '"'


def _write(path: str | Path, name: str, match: list[str], tag: str) -> None:
    lines = ["[rule]", f"name = {quoted(name)}", "", "[rule.match]", *match, "", "[rule.tag]", f"value = {quoted(tag)}", ""]
    Path(path).write_text("\n".join(lines))


def create_contains(path: str | Path, name: str, pattern: str, tag: str) -> None:
    _write(path, name, [f"message_contains = {quoted(pattern)}"], tag)


def create_equals(path: str | Path, name: str, sourcetype: str, field: str, value: str, tag: str) -> None:
    """A rule for one field of one sourcetype; a value that is a 64-bit integer is compared as one."""
    whole = re.fullmatch(r"[+-]?\d+", value, re.ASCII) is not None and -(2**63) <= int(value) < 2**63
    key = field if re.fullmatch(r"[A-Za-z0-9_-]+", field) else quoted(field)
    _write(path, name, [f"sourcetype = {quoted(sourcetype)}", f"{key} = {int(value) if whole else quoted(value)}"], tag)


_KEY = re.compile(r"^[ \t]*message_contains[ \t]*=[ \t]*", re.M)


def _value_end(text: str, at: int) -> int:
    """End of the TOML value that begins at ``at``: the shortest text from there that parses and ends a line or comment."""
    for m in re.finditer(r"[\]\"']", text[at:]):
        end = at + m.end()
        try:
            tomllib.loads("x = " + text[at:end])
        except tomllib.TOMLDecodeError:
            continue
        if re.match(r"[ \t]*(#|\r?\n|\Z)", text[end:]):
            return end
    raise BadRule("message_contains is neither a string nor a list")


def _needles(value: str) -> list | None:
    try:
        return tomllib.loads("x = " + value)["x"]
    except tomllib.TOMLDecodeError:
        return None


def append_needle(path: str | Path, pattern: str) -> None:
    """Add a needle to a rule file; a single needle becomes a list, one that is there already changes nothing, comments stay."""
    text = Path(path).read_text()
    try:
        match = tomllib.loads(text)["rule"]["match"]
    except (tomllib.TOMLDecodeError, KeyError, TypeError):
        raise BadRule(f"{path} has no [rule.match] table") from None
    now = match.get("message_contains")
    if now is not None and not isinstance(now, (str, list)):
        raise BadRule("message_contains is neither a string nor a list")
    if now is None:
        head = re.search(r"^[ \t]*\[rule\.match\][^\n]*\n?", text, re.M)
        if not head:
            raise BadRule(f"{path} has no [rule.match] header")
        line = f"message_contains = [{quoted(pattern)}]\n"
        new = text[: head.end()] + ("" if head[0].endswith("\n") else "\n") + line + text[head.end() :]
    elif pattern in ([now] if isinstance(now, str) else now):
        return
    else:
        at = _KEY.search(text).end()
        end = _value_end(text, at)
        old = text[at:end]
        have = [now] if isinstance(now, str) else now
        if isinstance(now, str):
            tries = [f"[{old}, {quoted(pattern)}]"]
        else:
            body = old[:-1].rstrip()
            # at the end; before the first needle where a comment stands at the end
            tries = [f"{body}{'' if body.endswith((',', '[')) else ','} {quoted(pattern)}]", f"[{quoted(pattern)}, {old[1:]}"]
        value = next((v for v in tries if _needles(v) is not None and sorted(map(str, _needles(v))) == sorted(map(str, [*have, pattern]))), tries[0])
        new = text[:at] + value + text[end:]
    if pattern not in Rule.from_toml(new).needles():
        raise BadRule(f"{path}: the list of needles could not be extended")
    Path(path).write_text(new)


def describe(rule: Rule) -> str:
    """Match fields as Markdown table text, one below the other."""
    return "<br>".join(f"`{k}` = " + " or ".join(f"`{v}`" for v in (value if isinstance(value, tuple) else (value,))) for k, value in rule.match)


def reference_table(rules: list[Rule]) -> str:
    """A Markdown table of rules."""
    rows = [f"| `{r.name}` | {describe(r)} | `{r.tag}` | {r.description or ''} |" for r in rules]
    return "\n".join(["| Rule | Match | Tag | Description |", "|---|---|---|---|", *rows, ""])
