"""The result of a search in timeline order, stored by place, so that any page is as near as the first one.

The keys of the result are written once in ranges of the order, one file a range, with the range and the index in it.  The
driver holds a count, a file and the first and last time of each range.  The page at an offset is then read from the files
of the ranges that hold it, and the entries of its keys by their source and a stretch of their numbers.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timezones import Zone
from tidemark.model import KEY
from tidemark.operators.places import INDEX_BITS, in_ranges, rows_before, which_range
from tidemark.operators.timeline import ORDER, Timeline

#: Rows of a page whose sources and numbers become conditions; larger pages are joined.
FILTERED_ROWS = 2_000
_KEYS = "timestamp_utc timestamp_ntz, event_id_source string, event_id_seq long, _at long"


@dataclass
class Range:
    """One range of the order: its number, its rows and those before it, its file, and its first and last time."""

    part: int
    rows: int
    before: int
    file: str
    first: str
    last: str


class Ranking:
    """A stored ranking. It stays as it was when the timeline or its tags change."""

    def __init__(self, timeline: Timeline, text: str, ranges: list[Range]):
        self.timeline, self.text, self.ranges = timeline, text, ranges

    @classmethod
    def build(cls, timeline: Timeline, text: str, folder: str, ranges: int | None = None) -> Ranking:
        """Rank the result of a search in a new ``folder``."""
        spark = timeline.entries.sparkSession
        in_ranges(timeline.search(text).select(*ORDER), [F.col(c).asc() for c in ORDER], ranges).write.parquet(folder)
        kept = spark.read.schema(_KEYS).parquet(folder)
        time = lambda c: c.cast("string")
        found = kept.groupBy(which_range().alias("part"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), time(F.min("timestamp_utc")).alias("first"), time(F.max("timestamp_utc")).alias("last")).collect()
        before = dict(rows_before([(r.part, r.n) for r in found]))
        return cls(timeline, text, sorted((Range(r.part, r.n, before[r.part], r.file, r.first, r.last) for r in found), key=lambda r: r.part))

    def to_json(self) -> str:
        return json.dumps({"text": self.text, "ranges": [asdict(r) for r in self.ranges]})

    @classmethod
    def from_json(cls, timeline: Timeline, text: str) -> Ranking:
        d = json.loads(text)
        return cls(timeline, d["text"], [Range(**r) for r in d["ranges"]])

    @property
    def total(self) -> int:
        return self.ranges[-1].before + self.ranges[-1].rows if self.ranges else 0

    def _read(self, ranges: list[Range]) -> DataFrame:
        spark = self.timeline.entries.sparkSession
        return spark.read.schema(_KEYS).parquet(*[r.file for r in ranges]) if ranges else spark.createDataFrame([], _KEYS)

    def keys(self, offset: int, limit: int) -> DataFrame:
        """timestamp_utc and key of the rows at ``offset`` and after it; only the files of their ranges are read."""
        held = [r for r in self.ranges if r.before < offset + limit and offset < r.before + r.rows]
        rows = self._read(held)
        within = [F.col("_at").between((r.part << INDEX_BITS) + max(0, offset - r.before), (r.part << INDEX_BITS) + min(r.rows, offset + limit - r.before) - 1) for r in held]
        return rows.where(reduce(Column.__or__, within, F.lit(False))).select(*ORDER)

    def window(self, offset: int, limit: int, zone: Zone = Zone(minutes=0)) -> DataFrame:
        """The page at ``offset``, as :meth:`Timeline.window` gives it."""
        t, keys = self.timeline, self.keys(offset, limit).select(*KEY)
        if limit > FILTERED_ROWS:
            return t._page(keys, False, zone)
        stretches: dict[str, list[int]] = {}
        rows = keys.collect()
        for r in rows:
            stretches.setdefault(r.event_id_source, []).append(r.event_id_seq)
        wanted = [(F.col("event_id_source") == s) & F.col("event_id_seq").between(min(n), max(n)) for s, n in sorted(stretches.items())]
        narrow = t.entries.where(reduce(Column.__or__, wanted, F.lit(False)))
        near = Timeline(narrow, t.sources, t.tags, t.analyst_tags, t.notes)
        return near._page(keys.sparkSession.createDataFrame(rows, keys.schema), True, zone)

    def place_at(self, time: datetime) -> int:
        """How many rows come before ``time``: the offset of a jump to it. One range is read at most."""
        at = F.expr(f"TIMESTAMP_NTZ '{time.isoformat(sep=' ', timespec='microseconds')}'")
        first, last = ([datetime.fromisoformat(getattr(r, c)) for r in self.ranges] for c in ("first", "last"))
        whole = bisect_left(last, time)
        partly = self.ranges[whole : whole + 1] if whole < len(first) and first[whole] < time else []
        return sum(r.rows for r in self.ranges[:whole]) + (self._read(partly).where(F.col("timestamp_utc") < at).count() if partly else 0)
