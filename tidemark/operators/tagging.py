"""Tagging rules: TOML conditions compiled to columns, and the three ways to apply them.

A rule matches when all keys of its match table do; an empty table matches every row.  ``sourcetype``, ``level`` and
``message`` compare whole strings, ``message_contains`` is one literal needle or a list of them, and any other key
compares with a JSON value of ``fields`` by type: a TOML string with a JSON string, an integer with an integral number,
a float with any number, a boolean with a boolean.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import KEY

#: Fixed: keys with a path of their own, by sourcetype; the first path present wins, then the flat key of that name.
_NORMALISED = {
    "event_id": {"evtx": [("Event", "System", "EventID")]},
    "provider": {"evtx": [("Event", "System", "Provider_attributes", "Name")]},
    "subsystem": {"evtx": [("Event", "System", "Provider_attributes", "Name")]},
    "host": {"evtx": [("Event", "System", "Computer")], "journald": [("_HOSTNAME",)]},
    "process": {"journald": [("SYSLOG_IDENTIFIER",), ("_COMM",)]},
    "category": {},
}


class BadRule(ValueError):
    """A rule file without the required parts."""


@dataclass(frozen=True)
class Rule:
    name: str
    tag: str
    match: tuple[tuple[str, object], ...] = ()
    description: str | None = None

    @classmethod
    def from_dict(cls, d: dict) -> Rule:
        try:
            r = d["rule"]
            name, tag, match = r["name"], r["tag"]["value"], r.get("match", {})
        except (KeyError, TypeError) as e:
            raise BadRule(f"rule without {e}") from None
        if not isinstance(name, str) or not isinstance(tag, str) or not isinstance(match, dict):
            raise BadRule("rule name and tag are strings, match is a table")
        return cls(name, tag, tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in match.items()), r.get("description"))

    @classmethod
    def from_toml(cls, text: str) -> Rule:
        try:
            return cls.from_dict(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise BadRule(str(e)) from None

    def needles(self) -> list[str]:
        value = dict(self.match).get("message_contains")
        return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, tuple) else []


def _member(key: str) -> str:
    """A path step; Spark's paths have no escapes, so a key with both kinds of quotes cannot be asked for."""
    if "'" not in key:
        return f"['{key}']"
    if '"' not in key:
        return f'["{key}"]'
    raise BadRule(f"a field name with both kinds of quotes: {key}")


def _at(path: Iterable[str]) -> Column:
    return F.try_variant_get("_v", "$" + "".join(map(_member, path)), "variant")


def _typed_equal(actual: Column, expected: object) -> Column:
    """Equality of a variant and a TOML value; never null."""
    kind = F.schema_of_variant(actual)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if isinstance(expected, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(actual, "$", "boolean") == expected)
    elif isinstance(expected, int):
        found = (kind == "BIGINT") & (F.try_variant_get(actual, "$", "bigint") == F.lit(expected).cast("bigint"))
    elif isinstance(expected, float):
        found = number & (F.try_variant_get(actual, "$", "double") == expected)
    elif isinstance(expected, str):
        found = (kind == "STRING") & (F.try_variant_get(actual, "$", "string") == expected)
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def _value(key: str) -> Column:
    flat = _at([key])
    value = flat
    for kind, paths in _NORMALISED.get(key, {}).items():
        value = F.when(F.col("sourcetype") == kind, F.coalesce(*map(_at, paths), flat)).otherwise(value)
    return value


def _field(key: str, expected: object) -> Column:
    return _typed_equal(_value(key), expected)


def condition(rule: Rule) -> Column:
    """The rule as a column over sourcetype, level, message and ``_v`` (the parsed fields); never null."""
    parts = []
    for key, expected in rule.match:
        if key in ("sourcetype", "level", "message"):
            part = F.col(key) == expected if isinstance(expected, str) else F.lit(False)
        elif key == "message_contains":
            needles = rule.needles()
            part = reduce(lambda a, b: a | b, [F.col("message").contains(n) for n in needles]) if needles else F.lit(False)
        else:
            part = _field(key, expected)
        parts.append(F.coalesce(part, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def reads_fields(rule: Rule) -> bool:
    return any(k not in ("sourcetype", "level", "message", "message_contains") for k, _ in rule.match)


def _with_fields(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``_v``: the parsed JSON, null if it is none; parsed once for all rules, and not at all if none reads it."""
    value = F.try_parse_json(F.coalesce("fields", F.lit("null"))) if any(map(reads_fields, rules)) else F.lit(None)
    return rows.withColumn("_v", value)


def taggable(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows rules see: entries with a source. Only the columns that rules read are scanned."""
    known = sources.select(F.col("source_file_id").alias("event_id_source"), "sourcetype")
    # a row for each source; else the plan may take the entries for the smaller side
    return entries.select(*KEY, "level", "message", "fields").join(F.broadcast(known), "event_id_source")


def matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """event_id_source, event_id_seq, rule_name, tag_value: one row for each row and matching rule."""
    if not rules:
        return rows.limit(0).select(*KEY, F.lit("").alias("rule_name"), F.lit("").alias("tag_value"))
    hits = F.array(*[F.when(condition(r), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.tag).alias("tag_value"))) for r in rules])
    found = _with_fields(rows, rules).select(*KEY, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit"))
    return found.select(*KEY, "hit.rule_name", "hit.tag_value")


#: A fact that no row has.
_NEVER = "never"
_PLAIN = ("sourcetype", "level", "message", "message_contains")
#: Types of JSON values that facts tell apart, by the type of a rule's value.
_TYPES = {bool: "b", int: "i", float: "f", str: "s"}


def needle_pattern(needles: list[str]) -> str:
    """A pattern whose group is the longest of ``needles`` (none empty) that begins at a place; the next match begins at the next place.

    The needles are written as a tree of their characters, so that a place is looked at once for all that begin alike.
    """
    tree: dict = {}
    for n in needles:
        node = tree
        for c in n:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        parts = [(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}") + written(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)}){'?' if '' in node else ''}"

    return f"(?=({written(tree)}))"


def _double_text(x: float) -> str:
    """A double as Spark writes it; both zeros are one."""
    return SparkSession.active()._jvm.java.lang.Double.toString(x + 0.0)


def _typed(kind: str, key: str) -> str:
    """The beginning of a fact about a field; the key's length keeps it apart from what follows."""
    return f"{kind}{len(key)}:{key}="


def _facts(rules: list[Rule]) -> Column:
    """What a row is, as far as ``rules`` ask: an array of strings, one for each of level, message, typed field and needle."""
    asked = {k for r in rules for k, _ in r.match}
    parts = [F.concat(F.lit(f"{k}="), F.col(k)) for k in ("level", "message") if k in asked]
    for key, kind in sorted({(k, _TYPES[type(v)]) for r in rules for k, v in r.match if k not in _PLAIN and type(v) in _TYPES}):
        value = _value(key)
        is_a = F.schema_of_variant(value)
        if kind == "b":
            right, text = is_a == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("string")
        elif kind == "i":
            right, text = is_a == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("string")
        elif kind == "f":
            right, text = is_a.isin("BIGINT", "DOUBLE", "FLOAT") | is_a.startswith("DECIMAL"), (F.try_variant_get(value, "$", "double") + F.lit(0.0)).cast("string")
        else:
            right, text = is_a == "STRING", F.try_variant_get(value, "$", "string")
        parts.append(F.when(right, F.concat(F.lit(_typed(kind, key)), text)))
    needles = sorted({n for r in rules for n in r.needles()})
    if "" in needles:
        parts.append(F.when(F.col("message").isNotNull(), F.lit("needle=")))
    none = F.array().cast("array<string>")
    known = F.array_compact(F.array(*parts)) if parts else none
    if any(needles):
        found = F.array_distinct(F.regexp_extract_all("message", F.lit(needle_pattern([n for n in needles if n])), 1))
        known = F.concat(known, F.coalesce(F.transform(found, lambda n: F.concat(F.lit("needle="), n)), none))
    return known


def _as_data(rule: Rule, needles: list[str]) -> dict:
    """The facts that a rule needs, and those of which it needs one: its needles, and longer ones that begin with one of them."""
    every, some = [], None
    for key, v in rule.match:
        if key == "message_contains":
            own = rule.needles()
            some = [f"needle={n}" for n in needles if any(n.startswith(o) for o in own)] or [_NEVER]
        elif key in _PLAIN:
            every += [f"{key}={v}"] if key != "sourcetype" else []
        elif type(v) in _TYPES:
            text = str(v).lower() if isinstance(v, bool) else _double_text(v) if isinstance(v, float) else str(v)
            every.append(_typed(_TYPES[type(v)], key) + text)
        else:
            every.append(_NEVER)
    return {"rule_name": rule.name, "tag_value": rule.tag, "every": every, "some": some}


def matches_in_one_pass(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """As :func:`matches`, for packs of dozens of rules: what a row is is found once, and rules are data that it is held against.

    Each sourcetype has one pattern for all its needles and one array of its rules, both literals; a row is looked at for
    those of its own sourcetype.  Nothing of it is Python, and the code does not grow with the rules.
    """
    rules = [r for r in rules if all(isinstance(v, str) for k, v in r.match if k in ("sourcetype", "level", "message"))]
    if not rules:
        return matches(rows, rules)
    schema = "array<struct<rule_name:string,tag_value:string,every:array<string>,some:array<string>>>"
    kinds = sorted({v for r in rules for k, v in r.match if k == "sourcetype"})

    def of(kind: str | None) -> tuple[Column, Column]:
        own = [r for r in rules if dict(r.match).get("sourcetype", kind) == kind]
        needles = sorted({n for r in own for n in r.needles()})
        return _facts(own), F.from_json(F.lit(json.dumps([_as_data(r, needles) for r in own])), schema)

    facts, known = of(None)
    for kind in kinds:
        own, data = of(kind)
        facts, known = (F.when(F.col("sourcetype") == kind, x).otherwise(y) for x, y in ((own, facts), (data, known)))
    seen = _with_fields(rows, rules).select(*KEY, "sourcetype", facts.alias("_facts"))
    holds = lambda r: F.forall(r["every"], lambda f: F.array_contains("_facts", f)) & (r["some"].isNull() | F.arrays_overlap(r["some"], "_facts"))
    found = seen.select(*KEY, F.explode(F.filter(known, holds)).alias("hit"))
    return found.select(*KEY, "hit.rule_name", "hit.tag_value")


#: Above this many rules one pass is faster than one compiled column for each.
COLUMN_RULES = 24


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return matches(rows, rules) if len(rules) <= COLUMN_RULES else matches_in_one_pass(rows, rules)


def tag_entries(entries: DataFrame, sources: DataFrame, rules: list[Rule], applied_at: datetime) -> DataFrame:
    """Rows of import_tags for all entries with a source: for a new batch, or anew for a whole timeline."""
    at = F.expr(f"TIMESTAMP_NTZ '{applied_at.isoformat(sep=' ', timespec='microseconds')}'")
    return apply_rules(taggable(entries, sources), rules).withColumn("applied_at", at)


def retag_summary(tags: DataFrame) -> DataFrame:
    """Applied tags by rule name; their sum is the number applied."""
    return tags.groupBy("rule_name").agg(F.count("*").alias("n")).orderBy("rule_name")


def evaluate(entries: DataFrame, sources: DataFrame, rules: list[Rule]) -> DataFrame:
    """Keys of the entries that any rule matches, once each; nothing is written."""
    rows = _with_fields(taggable(entries, sources), rules)
    return rows.where(reduce(lambda a, b: a | b, map(condition, rules), F.lit(False))).select(*KEY)


def owner_of_tag(rules: list[Rule], tag: str) -> Rule | None:
    """The only rule that gives a tag; None for none or several."""
    found = [r for r in rules if r.tag == tag]
    return found[0] if len(found) == 1 else None
