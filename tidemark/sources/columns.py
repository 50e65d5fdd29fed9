"""Text formats as column expressions: the patterns and times that need no Python.

A pattern qualifies if its parts mean the same to Java once classes are Unicode's and line ends are ``\\n`` alone: no
alternation, look-around, back reference or set operation, and no named group that may be left out.  A time format
qualifies if it gives year (or an assumed one), month, day, hour, minute and the like, and no weekday, half or epoch.
Everything else is read by :class:`tidemark.sources.text.BlockParser`; tests hold both equal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timezones import TimeFormat, Zone

#: Group openings, in the order they are looked for, and what they are for Java.
_OPENINGS = re.compile(r"\((?:\?P?<([A-Za-z_][A-Za-z0-9_]*)>|\?:|(?!\?))")
_ESCAPES = re.compile(r"\\(?:[dDsSwWtnr]|[^A-Za-z0-9\s])")
_CLASS = re.compile(r"\[\^?(?:\\(?:[dDsSwWtnr]|[^A-Za-z0-9\s])|[^\]\[\\&~-]|-)+\]")
_REPEAT = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??(?![*+?{])")


def java_pattern(pattern: str) -> tuple[str, dict[str, int]] | None:
    """The pattern for Java and the numbers of its named groups, or None."""
    m = re.match(r"\(\?s\)", pattern)
    at = m.end() if m else 0
    out, names, depth, number = ["(?dUs)" if m else "(?dU)"], {}, [], 0
    while at < len(pattern):
        c, rest = pattern[at], pattern[at:]
        part = None
        if c == "(":
            m = _OPENINGS.match(rest)
            if not m:
                return None
            capturing = not m[0].endswith("?:")
            number += capturing
            depth.append(list(names))
            if m[1]:
                names[m[1]] = number
            part, size = "(" if capturing else "(?:", m.end()
        elif c == ")":
            if not depth:
                return None
            before = depth.pop()
            repeat = _REPEAT.match(pattern[at + 1 :])
            if repeat and len(names) > len(before):
                return None  # a named group that may be left out, or stand several times
            part, size = ")", 1
        elif c == "\\":
            m = _ESCAPES.match(rest)
            part, size = (m[0], m.end()) if m else (None, 0)
        elif c == "[":
            m = _CLASS.match(rest)
            part, size = (m[0], m.end()) if m else (None, 0)
        elif c in "*+?{":
            m = _REPEAT.match(rest)
            part, size = (m[0], m.end()) if m else (None, 0)
        elif c == "$":
            part, size = r"\z", 1
        elif c not in "|]}":
            part, size = c, 1
        if part is None:
            return None
        out.append(part)
        at += size
    return None if depth else ("".join(out), names)


_PARTS = {"year", "month", "day", "month_name", "hour", "minute", "second", "nanos", "offset"}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _offset(at: Column, zone: str) -> Column:
    """Seconds that local time is ahead of the UTC instant ``at``."""
    return F.timestamp_diff("SECOND", at, F.convert_timezone(F.lit("UTC"), F.lit(zone), at))


def _to_utc(local: Column, zone: Zone) -> Column:
    """The one instant of a local time; null where the zone skips it or has it twice."""
    if zone.minutes is not None:
        return F.timestamp_add("MINUTE", F.lit(-zone.minutes), local)
    name = zone.spark_name()
    first, second = (F.timestamp_add("SECOND", -_offset(F.timestamp_add("DAY", F.lit(d), local), name), local) for d in (-1, 1))
    good = [F.convert_timezone(F.lit("UTC"), F.lit(name), u) == local for u in (first, second)]
    return F.when(good[0] & good[1] & (first != second), None).when(good[0], first).when(good[1], second)


def time_column(text: Column, fmt: TimeFormat, zone: Zone | None, year: int | None) -> Column | None:
    """UTC of a timestamp's text, null for one without a single meaning; None if the format does not qualify."""
    fields = list(fmt.fields)
    if not set(fields) <= _PARTS or len(set(fields)) < len(fields) or not {"day", "hour", "minute"} <= set(fields):
        return None
    if not {"month", "month_name"} & set(fields) or ("year" not in fields and year is None) or ("offset" not in fields and zone is None):
        return None
    pattern = "(?i)\\A(?:" + re.sub(r"\(\?P<f\d+>", "(", fmt.pattern.pattern) + ")\\z"
    got = {f: F.trim(F.regexp_extract(text, pattern, k + 1)) for k, f in enumerate(fields)}
    whole = lambda name: got[name].try_cast("int")
    month = whole("month") if "month" in got else F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(got["month_name"], 1, 3))).cast("int")
    second = F.coalesce(whole("second"), F.lit(0)) if "second" in got else F.lit(0)
    micros = F.coalesce(F.substring(F.rpad(got["nanos"], 9, "0"), 1, 6).try_cast("int"), F.lit(0)) if "nanos" in got else F.lit(0)
    base = F.try_make_timestamp_ntz(whole("year") if "year" in got else F.lit(year), month, whole("day"), whole("hour"), whole("minute"), F.when(second == 60, 59).otherwise(second).cast("decimal(8,6)"))
    local = F.timestamp_add("MICROSECOND", micros + F.when(second == 60, 1_000_000).otherwise(0), base)
    if "offset" in got:
        sign = F.when(got["offset"].startswith("-"), 1).otherwise(-1)
        digits = F.regexp_replace(got["offset"], "[^0-9]", "")
        minutes = F.when(digits == "", 0).otherwise(F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
        utc = F.when(minutes < 24 * 60, F.timestamp_add("MINUTE", sign * minutes, local))
    else:
        utc = _to_utc(local, zone)
    return F.when(text.rlike(pattern), utc)
