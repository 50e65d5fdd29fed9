"""Time zones and timestamps: fixed offsets and IANA zones, strict local times, strftime-style formats."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadTime(ValueError):
    """A zone, format or timestamp that has no single meaning."""


@dataclass(frozen=True)
class Zone:
    """A fixed offset in minutes, or an IANA zone name."""

    minutes: int | None = None
    name: str | None = None

    @classmethod
    def parse(cls, text: str) -> Zone:
        t = text.strip()
        if t.lower() == "utc" or t in ("Z", "z"):
            return cls(minutes=0)
        m = re.fullmatch(r"([+-])(\d{4})", t.replace(":", ""))
        if m:
            minutes = int(m[2][:2]) * 60 + int(m[2][2:])
            if minutes >= 24 * 60:
                raise BadTime(f"offset out of range: {text!r}")
            return cls(minutes=-minutes if m[1] == "-" else minutes)
        try:
            ZoneInfo(t)
        except (ZoneInfoNotFoundError, ValueError, OSError):
            raise BadTime(f"neither an offset like +02:00 nor a zone like Europe/Berlin: {text!r}") from None
        return cls(name=t)

    def tzinfo(self):
        return ZoneInfo(self.name) if self.name else timezone(timedelta(minutes=self.minutes))

    def spark_name(self) -> str:
        if self.name:
            return self.name
        sign, m = "-" if self.minutes < 0 else "+", abs(self.minutes)
        return f"{sign}{m // 60:02}:{m % 60:02}"

    def to_utc(self, local: datetime) -> datetime:
        """The instant of a naive local time as naive UTC; an error where the zone skips it or has it twice."""
        tz = self.tzinfo()
        found = set()
        for fold in (0, 1):
            utc = local.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)
            if utc.astimezone(tz).replace(tzinfo=None) == local:
                found.add(utc.replace(tzinfo=None))
        if len(found) != 1:
            raise BadTime(f"local time {local} is {'ambiguous' if found else 'skipped'} in {self.spark_name()}")
        return found.pop()


def ntz_text(ts: Column) -> Column:
    """A TIMESTAMP_NTZ to milliseconds, whatever the session's zone is."""
    text = ts.cast("string")
    fraction = F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(F.substring(text, 1, 19), F.lit("."), fraction)


def display_text(ts: Column, zone: Zone) -> Column:
    """Local time in ``zone`` to milliseconds and its offset, as in ``2026-07-28 14:00:00.000 +02:00``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone.spark_name()), ts)
    minutes = F.timestamp_diff("MINUTE", ts, local)
    size = F.abs(minutes)
    part = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), part(F.floor(size / 60)), F.lit(":"), part(size % 60))
    return F.concat(ntz_text(local), F.lit(" "), offset)


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
#: Specifier, pattern, field.
_SPECIFIERS = {
    "Y": (r"[+-]?\d{4}", "year"), "y": (r"\d{2}", "year2"), "m": (r"\d{1,2}", "month"), "d": (r"\s*\d{1,2}", "day"), "e": (r"\s*\d{1,2}", "day"),
    "H": (r"\s*\d{1,2}", "hour"), "k": (r"\s*\d{1,2}", "hour"), "I": (r"\s*\d{1,2}", "hour12"), "l": (r"\s*\d{1,2}", "hour12"), "p": (r"[AaPp][Mm]", "half"), "P": (r"[AaPp][Mm]", "half"),
    "M": (r"\d{1,2}", "minute"), "S": (r"\d{1,2}", "second"), "f": (r"\d{1,9}", "nanos"), "z": (r"[+-]\d{2}:?\d{2}|Z", "offset"),
    "b": ("|".join(_MONTHS), "month_name"), "h": ("|".join(_MONTHS), "month_name"), "B": ("|".join([*_FULL, *_MONTHS]), "month_name"),
    "a": ("|".join(_DAYS), "weekday"), "A": (r"[A-Za-z]+day|" + "|".join(_DAYS), "weekday"), "j": (r"\d{1,3}", "ordinal"), "s": (r"-?\d+", "epoch"),
}
_COMPOUND = {"T": "%H:%M:%S", "F": "%Y-%m-%d", "D": "%m/%d/%y", "R": "%H:%M", "+": "%Y-%m-%dT%H:%M:%S%.f%z"}


class TimeFormat:
    """A strftime-style format; unknown specifiers are an error."""

    def __init__(self, text: str):
        self.text, self.fields, out, at = text, [], [], 0
        for k, v in _COMPOUND.items():
            text = text.replace("%" + k, v)
        while at < len(text):
            c = text[at]
            if c.isspace():
                out.append(r"\s*")
                at += 1
                continue
            if c != "%":
                out.append(re.escape(c))
                at += 1
                continue
            m = re.match(r"%([-_0]?)(\.(\d?)f|:{0,2}z|#z|(\d)f|[A-Za-z%])", text[at:])
            if not m:
                raise BadTime(f"bad format: {self.text!r}")
            spec = m[2]
            at += m.end()
            if spec == "%":
                out.append("%")
            elif spec.endswith("f") and spec != "f":
                digits = m[3] or m[4]
                body = rf"(?P<f{len(self.fields)}>\d{{{digits}}})" if digits else rf"(?P<f{len(self.fields)}>\d{{1,9}})"
                out.append((rf"\.{body}" if digits else rf"(?:\.{body})?") if spec[0] == "." else body)
                self.fields.append("nanos")
            elif spec in ("n", "t"):
                out.append(r"\s*")
            elif spec[-1] in _SPECIFIERS:
                pattern, field = _SPECIFIERS[spec[-1]]
                out.append(f"(?P<f{len(self.fields)}>{pattern})")
                self.fields.append(field)
            else:
                raise BadTime(f"unknown specifier %{spec} in {self.text!r}")
        self.pattern = re.compile("".join(out), re.IGNORECASE | re.ASCII)

    def parse(self, text: str, zone: Zone | None = None, year: int | None = None) -> datetime:
        """Naive UTC. The text's own offset wins over ``zone``; a text without a full year needs ``year``."""
        m = self.pattern.fullmatch(text)
        if not m:
            raise BadTime(f"{text!r} does not match {self.text!r}")
        got: dict[str, str] = {}
        for k, field in enumerate(self.fields):
            value = m[f"f{k}"]
            if value is not None:
                got[field] = value.strip()
        if "year" not in got and year is None:
            raise BadTime("timestamp has no year and none is assumed")
        try:
            local = self._local(got, year)
        except ValueError as e:
            raise BadTime(str(e)) from None
        if "epoch" in got:
            return local
        if "offset" in got:
            return local - timedelta(minutes=Zone.parse(got["offset"]).minutes)
        if zone is None:
            raise BadTime("timestamp has no zone and none is assumed")
        return zone.to_utc(local)

    @staticmethod
    def _local(got: dict[str, str], year: int | None) -> datetime:
        micros = int(got.get("nanos", "0").ljust(9, "0")[:6]) if "nanos" in got else 0
        if "epoch" in got:
            return datetime(1970, 1, 1) + timedelta(seconds=int(got["epoch"]), microseconds=micros)
        y = int(got["year"]) if "year" in got else year
        hour = int(got.get("hour", 0))
        if "hour12" in got:
            if not 1 <= int(got["hour12"]) <= 12 or "half" not in got:
                raise ValueError("a 12-hour time needs 1 to 12 and AM or PM")
            hour = int(got["hour12"]) % 12 + 12 * (got["half"].lower() == "pm")
        second = int(got.get("second", 0))
        leap = second == 60
        if "ordinal" in got:
            day = datetime(y, 1, 1) + timedelta(days=int(got["ordinal"]) - 1)
            month, dom = day.month, day.day
        else:
            month = int(got["month"]) if "month" in got else _MONTHS.index(got["month_name"].lower()[:3]) + 1 if "month_name" in got else None
            dom = int(got["day"]) if "day" in got else None
            if month is None or dom is None:
                raise ValueError("timestamp has no date")
        if "hour" not in got and "hour12" not in got or "minute" not in got:
            raise ValueError("timestamp has no time of day")
        at = datetime(y, month, dom, hour, int(got["minute"]), 59 if leap else second, micros) + timedelta(seconds=leap)
        if "weekday" in got and _DAYS[at.weekday()] != got["weekday"].lower()[:3]:
            raise ValueError("weekday and date disagree")
        return at
