"""Queries over a timeline: search, count, pages, single entries, and the counts behind filter menus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.extract import PATHS, virtual
from tidemark.functions.labels import level_label, level_name
from tidemark.functions.regex import BadPattern
from tidemark.functions.timezones import Zone, display_text, ntz_text
from tidemark.model import KEY
from tidemark.operators.compiler import check_patterns, compile_term, conjuncts, fold, needs_sources, tag_condition
from tidemark.operators.grammar import Term, parse
from tidemark.operators.required import of_query

ORDER = ["timestamp_utc", "event_id_source", "event_id_seq"]
#: Pages larger than this are joined without a broadcast of their keys.
BROADCAST_ROWS = 100_000
_UTC = Zone(minutes=0)


def tags_by_event(tags: DataFrame, distinct: bool = True) -> DataFrame:
    """event_id_source, event_id_seq, tags: sorted; an event has at most as many as there are rules."""
    collect = F.collect_set if distinct else F.collect_list
    return tags.groupBy(*KEY).agg(F.array_sort(collect("tag_value")).alias("tags"))


@dataclass
class Counts:
    """Counts that are kept beside a timeline: entries by event_id_source, level, sourcetype; tags by event_id_source, rule_name, tag_value.

    Several rows of one key add up.
    """

    entries: DataFrame
    tags: DataFrame

    @staticmethod
    def total(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sum("n").alias("n"))


class Timeline:
    """A timeline over ``entries``, ``sources`` and ``tags``; analyst tags and notes are optional.

    Entries that are stored with their sourcetype and virtual columns are searched by those columns, others by
    expressions over ``fields`` and the sourcetype of their source.  An ``index``
    (:class:`tidemark.plans.ngrams.NgramIndex`) leaves out files and stretches of entries that the texts of a search rule out; with ``counts``
    the counts behind menus are sums of those, else counts of the tables.
    """

    def __init__(self, entries: DataFrame, sources: DataFrame, tags: DataFrame, analyst_tags: DataFrame | None = None, notes: DataFrame | None = None, index=None, counts: Counts | None = None):
        self.index, self.counts = index, counts
        self.entries, self.sources, self.tags = entries, sources, tags
        self.analyst_tags, self.notes = analyst_tags, notes
        self.stored = {"sourcetype", *PATHS} <= set(entries.columns)

    def with_sources(self, entries: DataFrame, how: str = "left") -> DataFrame:
        """``entries`` with path and sourcetype; a missing source leaves them null, but a stored sourcetype stays."""
        known = self.sources.select(F.col("source_file_id").alias("event_id_source"), "path", "sourcetype")
        # a row for each source: joined by a shuffle, all entries of a source would meet in one task
        return entries.join(F.broadcast(known.drop("sourcetype") if "sourcetype" in entries.columns else known), "event_id_source", how)

    def search(self, text: str, strict: bool = False) -> DataFrame:
        """The entries that match. A pattern that is no regular expression makes the whole query match nothing, or is raised if ``strict``.

        Sources are joined only if a term reads them.  A tag term that must hold by itself is a semi or anti join with
        the tags it asks for; one under an OR adds a flag.
        """
        terms = parse(text)
        rows, columns = self.entries, self.entries.columns
        try:
            check_patterns(terms)
        except BadPattern:
            if strict:
                raise
            return rows.where(F.lit(False))
        pruned = self.index.prune(of_query(terms)) if self.index is not None and terms else None
        if pruned is not None:
            rows = pruned.entries
        if needs_sources(terms, self.stored):
            rows = self.with_sources(rows)
        either, each = conjuncts(terms)
        for t in each:
            if t.field != "tag":
                rows = rows.where(compile_term(t, self.stored))
        for t in each:
            if t.field == "tag":
                rows = rows.join(self._tagged(t), KEY, "left_anti" if t.negated else "left_semi")
        if either:
            conditions = []
            for k, t in enumerate(either):
                flag = None
                if t.field == "tag":
                    rows = rows.join(self._tagged(t).distinct().withColumn(f"_tag{k}", F.lit(True)), KEY, "left")
                    flag = F.coalesce(F.col(f"_tag{k}"), F.lit(False))
                conditions.append(compile_term(t, self.stored, flag))
            rows = rows.where(fold(either, conditions))
        return rows.select(*columns)

    def _tagged(self, term: Term) -> DataFrame:
        """The keys of the tags asked for. Stored ones grow with the log, however small their compressed files look: never broadcast."""
        keys = self.tags.where(tag_condition(term)).select(*KEY)
        return keys.hint("merge") if self.stored else keys

    def count(self, text: str = "") -> int:
        return self.search(text).count()

    def count_message_contains(self, pattern: str) -> int:
        return self.entries.where(F.col("message").contains(pattern)).count()

    def tag_preview(self, field: str | None, value: str) -> int:
        """How many entries a new rule would tag: by a field's value, or (no field) by a part of the message."""
        if field is None:
            return self.count_message_contains(value)
        quoted = f'"{field}={value}"'
        return self.search(quoted).count()

    def _display(self, rows: DataFrame, zone: Zone, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Display columns and ``_at`` of ``rows``; ``only`` restricts a table with the key columns to those rows."""
        wide = self.with_sources(rows)
        text = lambda c: F.coalesce(c, F.lit(""))
        field = F.col if self.stored else virtual
        cols = [
            *KEY,
            ntz_text(F.col("timestamp_utc")).alias("timestamp_utc"),
            display_text(F.col("timestamp_utc"), zone).alias("timestamp_display"),
            text(F.col("level")).alias("level"),
            text(F.col("path")).alias("source"),
            text(F.col("sourcetype")).alias("sourcetype"),
            *[text(field(name)).alias(name) for name in ("host", "process", "event_code", "subsystem", "category")],
            text(F.col("message")).alias("message"),
            F.col("timestamp_utc").alias("_at"),
        ]
        return self._merged_tags(wide.select(*cols), only)

    def display(self, rows: DataFrame, zone: Zone = _UTC) -> DataFrame:
        """The 14 display columns of ``rows`` (entries), nulls as empty strings, unordered."""
        return self._display(rows, zone, lambda table: table).drop("_at")

    def ordered(self, rows: DataFrame, zone: Zone = _UTC) -> DataFrame:
        """As :meth:`display`, in timeline order."""
        return self._display(rows, zone, lambda table: table).orderBy("_at", *KEY).drop("_at")

    def _merged_tags(self, rows: DataFrame, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Import tags sorted; with analyst tags sorted and distinct; notes in order of their ids."""
        none = F.array().cast("array<string>")
        rows = rows.join(tags_by_event(only(self.tags.select(*KEY, "tag_value")), distinct=False), KEY, "left")
        tags = F.coalesce("tags", none)
        if self.analyst_tags is not None:
            own = only(self.analyst_tags.select(*KEY, "tag_value")).groupBy(*KEY).agg(F.collect_list("tag_value").alias("_own"))
            rows = rows.join(own, KEY, "left")
            tags = F.when(F.col("_own").isNull(), tags).otherwise(F.array_sort(F.array_distinct(F.concat(tags, "_own"))))
        rows = rows.withColumn("tags", tags).drop("_own")
        if self.notes is None:
            return rows.withColumn("notes", none)
        ordered = only(self.notes.select(*KEY, "id", "note")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("id", "note"))).alias("_notes"))
        return rows.join(ordered, KEY, "left").withColumn("notes", F.coalesce(F.transform("_notes", lambda n: n["note"]), none)).drop("_notes")

    def _page(self, keys: DataFrame, small: bool, zone: Zone) -> DataFrame:
        """Whole rows of ``keys`` in timeline order; entries, tags and notes are all restricted to them first."""
        keys = F.broadcast(keys) if small else keys
        only = lambda table: table.join(keys, KEY, "left_semi")
        return self._display(only(self.entries), zone, only).orderBy("_at", *KEY).drop("_at")

    def window(self, text: str, offset: int, limit: int, zone: Zone = _UTC, strict: bool = False) -> DataFrame:
        """A page in timeline order. Keys are found on narrow columns first; only the page's rows are read whole.

        A deep offset sorts all rows before it; :meth:`page_after` does not.
        """
        keys = self.search(text, strict).select(*ORDER).orderBy(*ORDER).offset(offset).limit(limit).select(*KEY)
        return self._page(keys, limit <= BROADCAST_ROWS, zone)

    def page_after(self, text: str, last: tuple[datetime, str, int], limit: int, zone: Zone = _UTC, strict: bool = False) -> DataFrame:
        """The ``limit`` rows that follow the row ``last`` (timestamp_utc, event_id_source, event_id_seq) in timeline order."""
        at = F.expr(f"TIMESTAMP_NTZ '{last[0].isoformat(sep=' ', timespec='microseconds')}'")
        source, seq = F.col("event_id_source"), F.col("event_id_seq")
        later = (F.col("timestamp_utc") > at) | (F.col("timestamp_utc") == at) & ((source > last[1]) | (source == last[1]) & (seq > last[2]))
        keys = self.search(text, strict).where(F.col("timestamp_utc") >= at).where(later).select(*ORDER).orderBy(*ORDER).limit(limit).select(*KEY)
        return self._page(keys, limit <= BROADCAST_ROWS, zone)

    def full_entry(self, source: str, seq: int, zone: Zone = _UTC) -> DataFrame:
        """One entry with its raw text and fields; no row if there is none."""
        only = lambda table: table.where((F.col("event_id_source") == source) & (F.col("event_id_seq") == seq))
        one = only(self.entries)
        extra = one.select(*KEY, "raw", F.coalesce("fields", F.lit("null")).alias("fields"))
        return self._display(one, zone, only).drop("_at").join(extra, KEY)

    def at_keys(self, keys: DataFrame, zone: Zone = _UTC) -> DataFrame:
        """Display rows of the given (event_id_source, event_id_seq), in timeline order."""
        return self._page(keys.select(*KEY).distinct(), False, zone)

    def _counted(self, table: str, key: str) -> DataFrame:
        """key, n: rows of entries or tags by a column."""
        if self.counts is not None:
            return Counts.total(getattr(self.counts, table), key)
        return getattr(self, table).groupBy(key).agg(F.count("*").alias("n"))

    def tag_counts(self) -> DataFrame:
        """Rows of import tags by value."""
        return self._counted("tags", "tag_value")

    def level_counts(self) -> DataFrame:
        return self._counted("entries", "level").where("level is not null")

    def source_counts(self) -> DataFrame:
        return self._counted("entries", "event_id_source")

    def rule_counts(self, source_ids: list[str]) -> DataFrame:
        """Import tags by rule, of the given sources; none for no sources."""
        wanted = F.col("event_id_source").isin(source_ids) if source_ids else F.lit(False)
        if self.counts is not None:
            return Counts.total(self.counts.tags.where(wanted), "rule_name")
        return self.tags.where(wanted).groupBy("rule_name").agg(F.count("*").alias("n"))

    def distinct_levels(self) -> DataFrame:
        entries = self.entries if self.counts is None else self.counts.entries.select("event_id_source", "level")
        rows = self.with_sources(entries.where("level is not null").select("event_id_source", "level"))
        return rows.select("level", "sourcetype").distinct().orderBy("level", F.col("sourcetype").asc_nulls_last())

    def level_labels(self) -> DataFrame:
        """level, label: a level with the names its sourcetypes give it, sorted and joined by ``/``."""
        names = self.distinct_levels().withColumn("name", level_name(F.col("level"), F.col("sourcetype")))
        each = names.groupBy("level").agg(F.array_sort(F.collect_set("name")).alias("names"))
        joined = F.concat("level", F.lit(" ("), F.array_join("names", "/"), F.lit(")"))
        return each.select("level", F.when(F.size("names") == 0, F.col("level")).otherwise(joined).alias("label")).orderBy("level")

    def distinct_analyst_tags(self) -> DataFrame:
        return self.analyst_tags.select("tag_value").distinct().orderBy("tag_value")

    def _tag_values(self) -> DataFrame:
        return (self.tags if self.counts is None else self.counts.tags).select("tag_value")

    def distinct_tags(self) -> DataFrame:
        return self._tag_values().distinct().orderBy("tag_value")

    def tag_vocabulary(self) -> DataFrame:
        """Import and analyst tags together."""
        all_tags = self._tag_values()
        if self.analyst_tags is not None:
            all_tags = all_tags.unionByName(self.analyst_tags.select("tag_value"))
        return all_tags.distinct().orderBy("tag_value")

    def labelled_levels(self, rows: DataFrame) -> DataFrame:
        return self.with_sources(rows).withColumn("level_label", level_label(F.col("level"), F.col("sourcetype")))


def entry_text(row) -> str:
    """Plain text of a :meth:`Timeline.full_entry` row."""
    return "\n".join([f"Timestamp: {row.timestamp_display}", f"Level: {row.level}", f"Tags: {', '.join(row.tags)}", f"Message: {row.message}", f"Raw: {row.raw}", f"Fields: {row.fields}"])


#: Fixed markers of messages that a unified-log decoder could not resolve.
UNRESOLVED = {"missing_marker": "Missing message data", "failed_marker": "Failed to get", "unknown_shared": "Unknown shared string", "invalid_offset": "Invalid offset"}


def _empty() -> Column:
    return F.coalesce(F.col("message") == "", F.lit(True))


def _unresolved() -> Column:
    out = _empty()
    for marker in UNRESOLVED.values():
        out = out | F.col("message").contains(marker)
    return F.coalesce(out, F.lit(True))


def message_quality(entries: DataFrame) -> DataFrame:
    """One row of counts of empty and unresolved messages; sums are null for no entries."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    marks = [one(F.col("message").contains(m)).alias(n) for n, m in UNRESOLVED.items()]
    return entries.agg(F.count("*").alias("total"), one(_empty()).alias("empty_message"), *marks, one(_unresolved()).alias("any_unresolved"))


def resolution_by_day(entries: DataFrame) -> DataFrame:
    day = F.col("timestamp_utc").cast("date").cast("timestamp_ntz")  # no session zone comes between
    rows = entries.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.sum(F.when(_unresolved(), 1).otherwise(0)).alias("unresolved"))
    return rows.orderBy("day")


def level_breakdown(entries: DataFrame, most: int = 20) -> DataFrame:
    return entries.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("level").asc_nulls_last()).limit(most)


def sample_rows(entries: DataFrame, n: int = 5) -> DataFrame:
    """``n`` random entries: the feature is the sample."""
    return entries.select("level", "message", "fields").orderBy(F.rand()).limit(n)


VIRTUAL_NAMES = list(PATHS)
