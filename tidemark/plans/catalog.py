"""Registered timeline queries over the driver's tables, each with its SQL.

``events`` becomes a timeline of four sources (the fourth has no source row), with fields shaped as each source type has
them, null levels and null messages.  All tables are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import packs
from tidemark.functions.labels import source_label
from tidemark.functions.timezones import Zone, display_text
from tidemark.operators import querytext as q
from tidemark.operators import timeline as T
from tidemark.operators.tagging import Rule, apply_rules, evaluate, matches_in_one_pass, retag_summary, taggable
from tidemark.operators.timeline import Timeline
from tidemark.plans.export import export_file, export_folder, export_rows, read_array
from tidemark.plans.load import LoadSummary, load
from tidemark.plans.scratch import Scratch, remove, shared_dir
from tidemark.plans.session import Session
from tidemark.sources.discovery import source_files
from tidemark.sources.records import RENDERED, read_aul_records, read_evtx_records
from tidemark.streaming.ingest import watch

_COLUMNS = [
    "CAST(user_id % 4 AS STRING) AS event_id_source",
    "event_id AS event_id_seq",
    "ts AS timestamp_utc",
    "CASE WHEN event_id % 10 <> 0 THEN event_type END AS level",
    "CASE WHEN event_id % 11 <> 0 THEN concat(event_type, ' by user ', user_id) END AS message",
    "concat(event_id, '|', event_type, '|', props) AS raw",
    """CASE user_id % 4
    WHEN 0 THEN concat('{"event_record_id":', event_id, ',"Event":{"System":{"Computer":"WS', event_id % 7, '","EventID":', 4624 + event_id % 3, ',"Provider_attributes":{"Name":"Sec-', event_id % 2, '"}}}}')
    WHEN 1 THEN concat('{"_HOSTNAME":"node', event_id % 5, '",', CASE WHEN event_id % 3 = 0 THEN '"SYSLOG_IDENTIFIER":"sshd",' ELSE '' END, '"_COMM":"comm', event_id % 4, '"}')
    WHEN 2 THEN concat('{"process":"/usr/bin/p', event_id % 6, '","subsystem":"com.example.s', event_id % 4, '","category":"c', event_id % 3, '"}')
    ELSE props END AS fields""",
]
_SOURCES = [("0", "/e/a.evtx", "evtx", None, None), ("1", "/e/b.journal", "journald", None, None), ("2", "/e/c", "aul", None, None)]
#: Rules of the registered queries, as (name, tag, match).
_RULES = [
    ("purchases", "money", {"message_contains": ["purchase", "refund"]}),
    ("evtx_errors", "bad", {"sourcetype": "evtx", "level": "error"}),
    ("logons", "logon", {"event_id": 4624}),
    ("ssh", "logon", {"sourcetype": "journald", "process": "sshd"}),
    ("category_one", "c1", {"category": "c1", "message_contains": "view"}),
]
RULES = [Rule.from_dict({"rule": {"name": n, "tag": {"value": t}, "match": m}}) for n, t, m in _RULES]

_SQL_ENTRIES = f"SELECT {', '.join(_COLUMNS)} FROM events".replace("AS STRING", "AS VARCHAR")
_SQL = f"""WITH le AS ({_SQL_ENTRIES}),
src AS (SELECT * FROM (VALUES ('0', '/e/a.evtx', 'evtx'), ('1', '/e/b.journal', 'journald'), ('2', '/e/c', 'aul')) v(source_file_id, path, sourcetype)),
ls AS (SELECT le.*, path, sourcetype FROM le LEFT JOIN src ON event_id_source = source_file_id),
x AS (SELECT ls.*,
  CASE sourcetype WHEN 'evtx' THEN json_extract_string(fields, '$.Event.System.Computer') WHEN 'journald' THEN json_extract_string(fields, '$._HOSTNAME') END AS host,
  CASE sourcetype WHEN 'journald' THEN coalesce(json_extract_string(fields, '$.SYSLOG_IDENTIFIER'), json_extract_string(fields, '$._COMM')) WHEN 'aul' THEN json_extract_string(fields, '$.process') END AS process,
  CASE sourcetype WHEN 'evtx' THEN json_extract_string(fields, '$.Event.System.EventID') END AS event_code,
  CASE sourcetype WHEN 'evtx' THEN json_extract_string(fields, '$.Event.System.Provider_attributes.Name') WHEN 'aul' THEN json_extract_string(fields, '$.subsystem') END AS subsystem,
  CASE sourcetype WHEN 'aul' THEN json_extract_string(fields, '$.category') END AS category FROM ls),
tg AS (
  SELECT event_id_source, event_id_seq, 'purchases' AS rule_name, 'money' AS tag_value FROM x WHERE sourcetype IS NOT NULL AND (contains(message, 'purchase') OR contains(message, 'refund'))
  UNION ALL SELECT event_id_source, event_id_seq, 'evtx_errors', 'bad' FROM x WHERE sourcetype = 'evtx' AND level = 'error'
  UNION ALL SELECT event_id_source, event_id_seq, 'logons', 'logon' FROM x WHERE sourcetype = 'evtx' AND event_code = '4624'
  UNION ALL SELECT event_id_source, event_id_seq, 'ssh', 'logon' FROM x WHERE sourcetype = 'journald' AND json_extract_string(fields, '$.SYSLOG_IDENTIFIER') = 'sshd'
  UNION ALL SELECT event_id_source, event_id_seq, 'category_one', 'c1' FROM x WHERE sourcetype = 'aul' AND category = 'c1' AND contains(message, 'view'))
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*_COLUMNS)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "source_file_id string, path string, sourcetype string, original_tz string, parser_config string")


def timeline(spark: SparkSession, sf_dir: str) -> Timeline:
    rows, known = entries(spark, sf_dir), sources(spark)
    return Timeline(rows, known, apply_rules(taggable(rows, known), RULES))


_KEYS = "event_id_source, event_id_seq"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _QUERIES[name], _ORACLES[name] = query, sql


def _search(name: str, text: str, where: str) -> None:
    """A search and the SQL condition it stands for."""
    _add(name, lambda spark, d: timeline(spark, d).search(text).select("event_id_source", "event_id_seq"), f"{_SQL} SELECT {_KEYS} FROM x WHERE {where}")


def _tagged(test: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM tg WHERE tg.event_id_source = x.event_id_source AND tg.event_id_seq = x.event_id_seq AND {test})"


_search("search_free_text", "purchase", "contains(message, 'purchase') OR contains(raw, 'purchase')")
_search("search_phrase", '"by user 12"', "contains(message, 'by user 12') OR contains(raw, 'by user 12')")
_search("search_not_text", "-signup", "NOT (contains(message, 'signup') OR contains(raw, 'signup'))")
_search("search_level", "level=error", "level = 'error'")
_search("search_not_level", "NOT level=error", "NOT (level = 'error')")
_search("search_level_neq", "level!=click", "NOT (level = 'click')")
_search("search_fold", "level=error OR level=click message=7", "((level = 'error') OR (level = 'click')) AND contains(message, '7')")
_search("search_regex", "message~user.[1-3]+$ level~^(?:view|click)$", "regexp_matches(message, 'user.[1-3]+$') AND regexp_matches(level, '^(?:view|click)$')")
_search("search_bad_regex", "level=error OR message~a(?=b)", "false")
_search("search_time_range", "after=2024-01-02 before=2024-03-01T12:30", "timestamp_utc >= TIMESTAMP '2024-01-02' AND timestamp_utc <= TIMESTAMP '2024-03-01 12:30:00'")
_search("search_bad_time", "after=yesterday OR level=view", "false OR level = 'view'")
_search("search_source", "source=.journal sourcetype=journald", "contains(path, '.journal') AND sourcetype = 'journald'")
_search("search_source_id", "NOT source_id=2", "NOT (event_id_source = '2')")
_search("search_host", "host=WS3", "host = 'WS3'")
_search("search_not_host", "host!=node1", "NOT (host = 'node1')")
_search("search_process", "process=sshd OR process~p[0-2]$", "process = 'sshd' OR regexp_matches(process, 'p[0-2]$')")
_search("search_event_id", "event_id=4625 subsystem=Sec-1", "event_code = '4625' AND subsystem = 'Sec-1'")
_search("search_category", "category=c2 -level=view", "category = 'c2' AND NOT (level = 'view')")
_search("tag_exact", "tag=logon", _tagged("tag_value = 'logon'"))
_search("tag_regex", "tag~^(?:bad|money)$", _tagged("regexp_matches(tag_value, '^(?:bad|money)$')"))
_search("tag_any", "tag=*", _tagged())
_search("untagged", "NOT tag=*", f"NOT {_tagged()}")
_search("tag_or_untagged", "tag~^(?:bad)$ OR NOT tag=* level=view", f"({_tagged('''tag_value = 'bad' ''')} OR NOT {_tagged()}) AND level = 'view'")

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"
_VIRTUAL = ", ".join(f"coalesce({c}, '') AS {c}" for c in T.VIRTUAL_NAMES)
_ARRAYS = ["tags", "notes"]


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, for comparison."""
    return df.withColumns({c: F.array_join(c, ",") for c in _ARRAYS})


def timeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(timeline(spark, sf_dir).window("message=user", 400, 200, Zone.parse("+02:00")))


_DISPLAY = f"""SELECT x.event_id_source, x.event_id_seq, {_TS.format('timestamp_utc')} AS timestamp_utc,
  {_TS.format("timestamp_utc + INTERVAL '2 hours'")} || ' +02:00' AS timestamp_display, coalesce(level, '') AS level, coalesce(path, '') AS source,
  coalesce(sourcetype, '') AS sourcetype, {_VIRTUAL}, coalesce(message, '') AS message,
  coalesce((SELECT string_agg(tag_value, ',' ORDER BY tag_value) FROM tg WHERE tg.event_id_source = x.event_id_source AND tg.event_id_seq = x.event_id_seq), '') AS tags, '' AS notes FROM """
_add("timeline_window", timeline_window, f"{_SQL} {_DISPLAY} (SELECT * FROM x WHERE contains(message, 'user') ORDER BY timestamp_utc, event_id_source, event_id_seq LIMIT 200 OFFSET 400) x")
_add("at_keys", lambda s, d: _flat(timeline(s, d).at_keys(entries(s, d).where("event_id_seq in (5, 6, 7)"), Zone.parse("+02:00"))), f"{_SQL} {_DISPLAY} (SELECT * FROM x WHERE event_id_seq IN (5, 6, 7)) x")
_add("full_entry", lambda s, d: timeline(s, d).full_entry("2", 5).select("event_id_seq", "raw", "fields"), f"{_SQL} SELECT event_id_seq, raw, fields FROM x WHERE event_id_seq = 5 AND event_id_source = '2'")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(timeline(spark, sf_dir), "level=error", Zone.parse("+02:00"))


_add("export_rows", _export, f"{_SQL}, shown AS ({_DISPLAY} (SELECT * FROM x WHERE level = 'error') x) SELECT timestamp_display AS timestamp, level, source, sourcetype, host, process, event_code, subsystem, category, replace(tags, ',', ';') AS tags, notes, message FROM shown")
_add("extract_fields", lambda s, d: (lambda t: t.display(t.entries).select("event_id_source", "event_id_seq", *T.VIRTUAL_NAMES))(timeline(s, d)), f"{_SQL} SELECT {_KEYS}, {_VIRTUAL} FROM x")
_add("left_join_sources", lambda s, d: (lambda t: t.with_sources(t.entries).groupBy("sourcetype", "path").agg(F.count("*").alias("n")))(timeline(s, d)), f"{_SQL} SELECT sourcetype, path, count(*) AS n FROM x GROUP BY 1, 2")
_add("retag", lambda s, d: timeline(s, d).tags, f"{_SQL} SELECT * FROM tg")
_add("retag_batch", lambda s, d: matches_in_one_pass(taggable(entries(s, d), sources(s)), RULES), f"{_SQL} SELECT * FROM tg")
_add("retag_rule_counts", lambda s, d: retag_summary(timeline(s, d).tags), f"{_SQL} SELECT rule_name, count(*) AS n FROM tg GROUP BY 1")
_add("evaluate_rules", lambda s, d: evaluate(entries(s, d), sources(s), RULES), f"{_SQL} SELECT DISTINCT {_KEYS} FROM tg")
_add("rule_counts_for_sources", lambda s, d: timeline(s, d).rule_counts(["0", "2"]), f"{_SQL} SELECT rule_name, count(*) AS n FROM tg WHERE event_id_source IN ('0', '2') GROUP BY 1")
_add("tag_counts", lambda s, d: timeline(s, d).tag_counts(), f"{_SQL} SELECT tag_value, count(*) AS n FROM tg GROUP BY 1")
_add("level_counts", lambda s, d: timeline(s, d).level_counts(), f"{_SQL} SELECT level, count(*) AS n FROM le WHERE level IS NOT NULL GROUP BY 1")
_add("source_counts", lambda s, d: timeline(s, d).source_counts(), f"{_SQL} SELECT event_id_source, count(*) AS n FROM le GROUP BY 1")
_add("distinct_levels", lambda s, d: timeline(s, d).distinct_levels(), f"{_SQL} SELECT DISTINCT level, sourcetype FROM x WHERE level IS NOT NULL")
_add("distinct_tags", lambda s, d: timeline(s, d).distinct_tags(), f"{_SQL} SELECT DISTINCT tag_value FROM tg")


def _analyst(spark: SparkSession, sf_dir: str) -> Timeline:
    """Analyst tags on every seventh event and notes on every ninth."""
    t = timeline(spark, sf_dir)
    marked = t.entries.where("event_id_seq % 7 = 0")
    t.analyst_tags = marked.select("event_id_source", "event_id_seq", F.when(F.col("event_id_seq") % 2 == 0, "logon").otherwise("seen").alias("tag_value"))
    noted = t.entries.where("event_id_seq % 9 = 0")
    t.notes = noted.select(F.col("event_id_seq").alias("id"), "event_id_source", "event_id_seq", F.concat(F.lit("note "), "event_id_seq").alias("note"))
    return t


_OWN = """, own AS (SELECT event_id_source, event_id_seq, CASE WHEN event_id_seq % 2 = 0 THEN 'logon' ELSE 'seen' END AS tag_value FROM le WHERE event_id_seq % 7 = 0)"""
_add(
    "merged_tags_notes",
    lambda s, d: _flat((lambda t: t.display(t.entries))(_analyst(s, d))).select("event_id_source", "event_id_seq", "tags", "notes"),
    f"""{_SQL}{_OWN}, every AS (SELECT event_id_source, event_id_seq, tag_value FROM tg UNION ALL SELECT * FROM own),
    agg AS (SELECT event_id_source, event_id_seq, CASE WHEN event_id_seq % 7 = 0 THEN string_agg(DISTINCT tag_value, ',' ORDER BY tag_value) ELSE string_agg(tag_value, ',' ORDER BY tag_value) END AS tags FROM every GROUP BY 1, 2)
    SELECT le.event_id_source, le.event_id_seq, coalesce(tags, '') AS tags, CASE WHEN le.event_id_seq % 9 = 0 THEN concat('note ', le.event_id_seq) ELSE '' END AS notes
    FROM le LEFT JOIN agg USING (event_id_source, event_id_seq)""",
)
_add("tag_vocabulary", lambda s, d: _analyst(s, d).tag_vocabulary(), f"{_SQL}{_OWN} SELECT tag_value FROM tg UNION SELECT tag_value FROM own")


def _documents_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    marker = F.element_at(F.array(*[F.lit(m) for m in ("Missing message data", "Failed to get", "Unknown shared string", "Invalid offset", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    message = F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.concat("text", marker)).otherwise(F.col("text"))
    day = F.expr("TIMESTAMP_NTZ '2026-01-01' + make_dt_interval(CAST(doc_id % 30 AS INT))")
    return docs.select(F.col("source").alias("level"), message.alias("message"), day.alias("timestamp_utc"))


_DOCS = """WITH d AS (SELECT source AS level, TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * CAST(doc_id % 30 AS INT) AS timestamp_utc,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN text || (['Missing message data', 'Failed to get', 'Unknown shared string', 'Invalid offset', ''])[doc_id % 5 + 1] ELSE text END AS message FROM documents),
u AS (SELECT *, message IS NULL OR message = '' OR contains(message, 'Missing message data') OR contains(message, 'Failed to get') OR contains(message, 'Unknown shared string') OR contains(message, 'Invalid offset') AS bad FROM d)"""
_add(
    "message_quality",
    lambda s, d: T.message_quality(_documents_as_entries(s, d)),
    f"""{_DOCS} SELECT count(*) AS total, CAST(count(*) FILTER (message IS NULL OR message = '') AS BIGINT) AS empty_message, count(*) FILTER (contains(message, 'Missing message data')) AS missing_marker,
    count(*) FILTER (contains(message, 'Failed to get')) AS failed_marker, count(*) FILTER (contains(message, 'Unknown shared string')) AS unknown_shared, count(*) FILTER (contains(message, 'Invalid offset')) AS invalid_offset, count(*) FILTER (bad) AS any_unresolved FROM u""",
)
_add("resolution_by_day", lambda s, d: T.resolution_by_day(_documents_as_entries(s, d)), f"{_DOCS} SELECT date_trunc('day', timestamp_utc)::TIMESTAMP AS day, count(*) AS total, count(*) FILTER (bad) AS unresolved FROM u GROUP BY 1")
_add("level_top20", lambda s, d: T.level_breakdown(_documents_as_entries(s, d)), f"{_DOCS} SELECT level, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, level LIMIT 20")


# Loads, state, labels and texts: sessions are written from ``events`` to the folder that driver and executors share.

_EVENT_TIME = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"


def _shared(spark: SparkSession) -> str:
    """A folder for one query; its result reads it, so :func:`clear` removes it and not the query."""
    return f"{shared_dir(spark)}/catalog/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what the registered queries of this application wrote; their results must be saved before."""
    remove(spark, f"{shared_dir(spark)}/catalog/{spark.sparkContext.applicationId}")


def _lines(spark: SparkSession, sf_dir: str, line: str, where: str = "true") -> str:
    """A folder with the lines of ``events`` in the order of event_id, one log in parts for each of two users' groups."""
    path = f"{_shared(spark)}/logs"
    rows = _read(spark, sf_dir, "events").where(where).selectExpr("user_id % 2 AS part", "event_id", f"{line} AS value")
    # ranges of the order, so that a task sorts one of many and no log is one task's
    rows.repartitionByRange("part", "event_id").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return path


def _loaded(spark: SparkSession, kind: str, path: str, **options) -> tuple[Session, LoadSummary]:
    session = Session(spark, f"{_shared(spark)}/session")
    return session, load(session, kind, path, suffix=".txt", **options)


def _parts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files of :func:`_lines` with their group as id."""
    return [(p, f) for p in ("0", "1") for f in source_files(spark, "text", f"{path}/part={p}", ".txt")]


def _named(df: DataFrame, session: Session) -> DataFrame:
    """With the part of the log's folder in place of the random id of the source."""
    part = F.regexp_extract("path", r"part=(\d)", 1)
    # a row for each log
    named = session.sources().select(F.col("source_file_id").alias("event_id_source"), part.alias("part"))
    return df.join(F.broadcast(named), "event_id_source").drop("event_id_source")


_SEQ = "row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS event_id_seq, CAST(user_id % 2 AS VARCHAR) AS part"
_GENERIC = f"concat({_EVENT_TIME}, ' ', event_type, ' by user ', user_id)"


def load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text log with local times of a fixed offset."""
    session, _ = _loaded(spark, "text", _lines(spark, sf_dir, _GENERIC), fmt=packs.text_formats()["generic_timestamp"], zone="+02:00")
    return _named(session.entries(), session)


_add(
    "load_text",
    load_text,
    f"""SELECT {_SEQ}, date_trunc('milliseconds', ts) - INTERVAL 2 HOUR AS timestamp_utc, CAST(NULL AS VARCHAR) AS level, concat(event_type, ' by user ', user_id) AS message,
    concat({_TS.format('ts')}, ' ', event_type, ' by user ', user_id) AS raw,
    '{{"timestamp":"' || {_TS.format('ts')} || '","message":"' || event_type || ' by user ' || user_id || '"}}' AS fields FROM events""",
)


def load_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three lines."""
    session, _ = _loaded(spark, "text", _lines(spark, sf_dir, f"concat({_GENERIC}, '\\n  at step ', event_id, '\\n  end')"), fmt=packs.text_formats()["generic_timestamp"], zone="UTC")
    return _named(session.entries().select("event_id_source", "event_id_seq", "timestamp_utc", "message"), session)


_add(
    "load_multiline",
    load_multiline,
    f"SELECT {_SEQ}, date_trunc('milliseconds', ts) AS timestamp_utc, concat(event_type, ' by user ', user_id, chr(10), '  at step ', event_id, chr(10), '  end') AS message FROM events",
)

_SYSLOG = "concat(date_format(ts, 'MMM'), ' ', lpad(CAST(day(ts) AS STRING), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' node', user_id % 5, ' sshd[', event_id, ']: ', event_type)"


def load_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a year, and optional parts."""
    fmt = packs.text_formats()["syslog_rfc3164"].with_assumptions(year=2024)
    session, _ = _loaded(spark, "text", _lines(spark, sf_dir, _SYSLOG, "year(ts) = 2024"), fmt=fmt, zone="UTC")
    fields = [F.get_json_object("fields", f"$.{n}").alias(n) for n in ("host", "process", "message")]
    return _named(session.entries().select("event_id_source", "event_id_seq", "timestamp_utc", *fields), session)


_add(
    "load_syslog",
    load_syslog,
    f"SELECT {_SEQ}, date_trunc('second', ts) AS timestamp_utc, concat('node', user_id % 5) AS host, 'sshd' AS process, event_type AS message FROM events WHERE year(ts) = 2024",
)

_EVTX = """concat('{"event_record_id":', event_id, ',"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), 'Z","Event":{"System":{"Computer":"WS', event_id % 7, '","EventID":', 4624 + event_id % 3, ',"Level":', event_id % 6, '},"RenderingInfo":{"Message":', CASE WHEN event_id % 4 = 0 THEN '{}' ELSE concat('"', event_type, '"') END, '}}}')"""


def load_evtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows event records as JSON lines, searched by their stored columns."""
    session, _ = _loaded(spark, "evtx", _lines(spark, sf_dir, _EVTX))
    found = session.timeline().search("host=WS3 event_id=4625")
    return _named(found.select("event_id_source", "event_id_seq", "timestamp_utc", "level", "message"), session)


_add(
    "load_evtx",
    load_evtx,
    f"""SELECT * EXCLUDE (h, e) FROM (SELECT {_SEQ}, date_trunc('milliseconds', ts) AS timestamp_utc, CAST(event_id % 6 AS VARCHAR) AS level, CASE WHEN event_id % 4 <> 0 THEN event_type END AS message,
    event_id % 7 AS h, 4624 + event_id % 3 AS e FROM events) WHERE h = 3 AND e = 4625""",
)


def load_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made from a template: named strings are put in, other names stay."""
    line = """concat('{"timestamp":"2024-01-01T00:00:00Z","Event":{"System":{"EventID":', 1 + event_id % 2, ',"Provider_attributes":{"Name":"P"}},"EventData":{"User":"u', user_id, '","Count":', event_id, '}}}')"""
    path = _lines(spark, sf_dir, line)
    rows = read_evtx_records(spark, _parts(spark, path), {("P", 1): "by {User}, {Count} times, {None}"}, Scratch(spark, f"{_shared(spark)}/kept").keep)
    return rows.select(F.col("event_id_source").alias("part"), "event_id_seq", "message")


_add("load_templates", load_templates, f"SELECT {_SEQ}, CASE WHEN event_id % 2 = 0 THEN '{RENDERED}by u' || user_id || ', {{Count}} times, {{None}}' END AS message FROM events")

_AUL = """concat('{"time":', unix_micros(CAST(ts AS TIMESTAMP)) * 1000, ',"evidence":"', event_id % 3, '","log_type":"', CASE WHEN event_id % 5 = 0 THEN 'Error' ELSE 'Info' END, '","process":"/bin/p', event_id % 6, '","message":"', event_type, '"}')"""


def load_aul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified-log records are numbered by time, then evidence file, then their place."""
    path = _lines(spark, sf_dir, _AUL)
    rows = read_aul_records(spark, _parts(spark, path), Scratch(spark, f"{_shared(spark)}/kept").keep)
    return rows.select(F.col("event_id_source").alias("part"), "event_id_seq", "level", "message", F.get_json_object("fields", "$.process").alias("process"))


_add(
    "load_aul",
    load_aul,
    """SELECT CAST(user_id % 2 AS VARCHAR) AS part, row_number() OVER (PARTITION BY user_id % 2 ORDER BY CAST(epoch_us(ts) * 1000 AS DOUBLE), event_id % 3, event_id) - 1 AS event_id_seq,
    CASE WHEN event_id % 5 = 0 THEN 'Error' ELSE 'Info' END AS level, event_type AS message, concat('/bin/p', event_id % 6) AS process FROM events""",
)


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with one bad line is skipped whole; counts by file and rule, and the activity log."""
    line = f"CASE WHEN user_id % 2 = 1 AND event_id % 50 = 7 THEN 'no time' ELSE {_GENERIC} END"
    fmt = replace(packs.text_formats()["generic_timestamp"], multiline_start=None)
    rules = [Rule("buys", "money", (("message_contains", "purchase"),)), Rule("all", "any", (("sourcetype", "text_generic"),))]
    session, summary = _loaded(spark, "text", _lines(spark, sf_dir, line), fmt=fmt, zone="UTC", rules=rules)
    (loaded,) = summary.inserted.values()
    log = session.activity().select("operation", "status", "entries_inserted", "tags_applied", F.size("skipped").alias("skipped"), F.size("per_file").alias("files"))
    return log.withColumn("loaded", F.lit(loaded)).withColumn("buys", F.lit(summary.tags_by_rule.get("buys", 0)).cast("long"))


_add(
    "load_summary",
    load_summary,
    """SELECT 'load' AS operation, 'ok' AS status, count(*) AS entries_inserted, count(*) + count(*) FILTER (contains(event_type, 'purchase')) AS tags_applied, CAST(1 AS INT) AS skipped, CAST(1 AS INT) AS files,
    CAST(count(*) AS INT) AS loaded, count(*) FILTER (contains(event_type, 'purchase')) AS buys FROM events WHERE user_id % 2 = 0""",
)


def _written(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the catalogue's entries."""
    session, rows = Session(spark, f"{_shared(spark)}/session"), entries(spark, sf_dir)
    for source, path, kind, zone, config in _SOURCES:
        session.append_entries(rows.where(F.col("event_id_source") == source), kind)
        session.append("sources", [(source, path, kind, zone, config)])
    return session


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retagging, tags and notes of an analyst, changes and deletions, all read back by a page."""
    session = _written(spark, sf_dir)
    session.retag(RULES[:2])
    session.retag(RULES)
    first = [r["event_id_seq"] for r in session.entries().where("event_id_source = '0'").orderBy("event_id_seq").select("event_id_seq").limit(3).collect()]
    for seq, tag in zip(first, ("seen", "logon", "seen")):
        session.add_tag("0", seq, tag)
    notes = [session.add_note("0", seq, f"note {k}") for k, seq in enumerate(first)]
    session.update_note(notes[0], "changed")
    session.delete_note(notes[1])
    return _flat(session.timeline().at_keys(session.analyst_tags())).select("event_id_seq", "host", "tags", "notes")


_add(
    "session_state",
    session_state,
    f"""{_SQL}, f AS (SELECT event_id_seq, host, row_number() OVER (ORDER BY event_id_seq) AS k FROM x WHERE event_id_source = '0' ORDER BY event_id_seq LIMIT 3),
    a AS (SELECT event_id_seq, tag_value FROM tg WHERE event_id_source = '0' UNION SELECT event_id_seq, CASE k WHEN 2 THEN 'logon' ELSE 'seen' END FROM f)
    SELECT event_id_seq, host, string_agg(tag_value, ',' ORDER BY tag_value) AS tags, max(CASE k WHEN 1 THEN 'changed' WHEN 3 THEN 'note 2' ELSE '' END) AS notes FROM f JOIN a USING (event_id_seq) GROUP BY 1, 2""",
)


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of stored columns with a tag under an OR."""
    session = _written(spark, sf_dir)
    session.retag(RULES)
    return session.timeline().search("host=WS1 OR tag=c1 -level=view").select("event_id_source", "event_id_seq")


_add("stored_search", stored_search, f"{_SQL} SELECT {_KEYS} FROM x WHERE (host = 'WS1' OR {_tagged('''tag_value = 'c1' ''')}) AND NOT (level = 'view') AND event_id_source <> '3'")


def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows the page before it."""
    t = timeline(spark, sf_dir)
    last = t.search("message=user").orderBy(*T.ORDER).offset(399).first()
    return t.page_after("message=user", tuple(last[c] for c in T.ORDER), 50).select("event_id_source", "event_id_seq")


_add("page_after", page_after, f"{_SQL} SELECT {_KEYS} FROM x WHERE contains(message, 'user') ORDER BY timestamp_utc, event_id_source, event_id_seq LIMIT 50 OFFSET 400")


def ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by place of a stored ranking, and the place of a time."""
    session = _written(spark, sf_dir)
    ranking = session.ranking("message=user")
    place = ranking.place_at(datetime(2024, 1, 10, 12))
    return ranking.window(500, 60).select("event_id_source", "event_id_seq").withColumns({"total": F.lit(ranking.total).cast("long"), "place": F.lit(place).cast("long")})


_add(
    "ranked_page",
    ranked_page,
    f"""{_SQL}, m AS (SELECT * FROM x WHERE contains(message, 'user') AND event_id_source <> '3') SELECT {_KEYS}, (SELECT count(*) FROM m) AS total,
    (SELECT count(*) FROM m WHERE timestamp_utc < TIMESTAMP '2024-01-10 12:00:00') AS place FROM m ORDER BY timestamp_utc, event_id_source, event_id_seq LIMIT 60 OFFSET 500""",
)


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of a loaded log by its trigram index: a text, a pattern, texts under OR, and one that nothing has."""
    session, _ = _loaded(spark, "text", _lines(spark, sf_dir, _GENERIC), fmt=packs.text_formats()["generic_timestamp"], zone="UTC")
    t = session.timeline()
    texts = ["purchase", "message~^view.*[37]$", '"user 12" OR "user 7" -click', "nowhere"]
    each = [_named(t.search(text).select("event_id_source", "event_id_seq"), session).withColumn("k", F.lit(k)) for k, text in enumerate(texts)]
    return reduce(DataFrame.unionAll, each)


_FOUND = ["contains(m, 'purchase')", "regexp_matches(m, '^view.*[37]$')", "(contains(m, 'user 12') OR contains(m, 'user 7')) AND NOT contains(m, 'click')"]
_add(
    "indexed_search",
    indexed_search,
    f"""WITH l AS (SELECT {_SEQ}, concat(event_type, ' by user ', user_id) AS m FROM events) """ + " UNION ALL ".join(f"SELECT event_id_seq, part, CAST({k} AS INT) AS k FROM l WHERE {w}" for k, w in enumerate(_FOUND)),
)


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared(spark)}/rows.csv"
    export_folder(timeline(spark, sf_dir), "level=error", path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("timestamp", "level", "message").fillna("")


_EXPORTED = f"SELECT {_TS.format('timestamp_utc')} || ' +00:00' AS timestamp, level, coalesce(message, '') AS message FROM x WHERE level = 'error'"
_add("export_csv", export_csv, f"{_SQL} {_EXPORTED}")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared(spark)}/rows.JSON"
    export_folder(timeline(spark, sf_dir), "level=error", path)
    return spark.read.schema("timestamp string, level string, message string").json(path)


_add("export_json", export_json, f"{_SQL} {_EXPORTED}")


def export_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array, written without a row on the driver."""
    path = f"{_shared(spark)}/rows.json"
    n = export_file(timeline(spark, sf_dir), "level=error", path)
    rows = read_array(spark, path, "timestamp string, level string, message string")
    return rows.withColumn("rows", F.lit(n).cast("long"))


_add("export_array", export_array, f"{_SQL} SELECT *, count(*) OVER () AS rows FROM ({_EXPORTED})")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    counts = {"all": t.count(), "text": t.count("purchase"), "message": t.count_message_contains("purchase"), "by_field": t.tag_preview("host", "WS3"), "by_message": t.tag_preview(None, "user 1")}
    return spark.createDataFrame(list(counts.items()), "name string, n long")


_add(
    "counts",
    _counts,
    f"""{_SQL} SELECT 'all' AS name, count(*) AS n FROM x UNION ALL SELECT 'text', count(*) FROM x WHERE contains(message, 'purchase') OR contains(raw, 'purchase') UNION ALL SELECT 'message', count(*) FROM x WHERE contains(message, 'purchase')
    UNION ALL SELECT 'by_field', count(*) FROM x WHERE host = 'WS3' UNION ALL SELECT 'by_message', count(*) FROM x WHERE contains(message, 'user 1')""",
)


def _numeric(spark: SparkSession, sf_dir: str) -> Timeline:
    """Numeric levels, of which both journald and evtx have some."""
    rows = entries(spark, sf_dir).withColumn("level", (F.col("event_id_seq") % 9).cast("string"))
    return Timeline(rows, sources(spark), timeline(spark, sf_dir).tags)


_NAMES = """n AS (SELECT * FROM (VALUES ('journald', '0', 'emerg'), ('journald', '1', 'alert'), ('journald', '2', 'crit'), ('journald', '3', 'err'), ('journald', '4', 'warning'), ('journald', '5', 'notice'), ('journald', '6', 'info'),
  ('journald', '7', 'debug'), ('evtx', '0', 'LogAlways'), ('evtx', '1', 'Critical'), ('evtx', '2', 'Error'), ('evtx', '3', 'Warning'), ('evtx', '4', 'Informational'), ('evtx', '5', 'Verbose')) v(sourcetype, level, name)),
  l AS (SELECT event_id_source, event_id_seq, path, sourcetype, CAST(event_id_seq % 9 AS VARCHAR) AS level FROM x)"""
_add(
    "level_labels",
    lambda s, d: _numeric(s, d).level_labels(),
    f"""{_SQL}, {_NAMES} SELECT level, CASE WHEN count(name) = 0 THEN level ELSE level || ' (' || string_agg(DISTINCT name, '/' ORDER BY name) || ')' END AS label FROM l LEFT JOIN n USING (sourcetype, level) GROUP BY level""",
)


def _row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _numeric(spark, sf_dir)
    rows = t.labelled_levels(t.entries)
    return rows.groupBy("level_label", source_label(F.col("path"), F.col("sourcetype")).alias("source")).agg(F.count("*").alias("n"))


_add(
    "row_labels",
    _row_labels,
    f"""{_SQL}, {_NAMES} SELECT CASE WHEN name IS NULL THEN level ELSE level || ' (' || name || ')' END AS level_label, CASE sourcetype WHEN 'evtx' THEN 'a.evtx' WHEN 'journald' THEN 'b.journal' WHEN 'aul' THEN '/e/c' END AS source, count(*) AS n
    FROM l LEFT JOIN n USING (sourcetype, level) GROUP BY 1, 2""",
)


def _query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query text means after each of several edits by filter controls: step, matches."""
    texts = [q.toggle_value("user", "level", "click")]
    texts.append(q.toggle_value(texts[-1], "level", "view"))
    texts.append(q.toggle_untagged(q.toggle_value(texts[-1], "tag", "logon")))
    texts.append(q.set_column_filter(q.toggle_source(texts[-1], "2"), "host", "WS3"))
    texts.append(q.set_column_filter(texts[-1], "host", None))
    texts.append(q.set_time_range(texts[-1], datetime(2024, 1, 5), None))
    texts.append(q.toggle_value(texts[-1], "level", "view"))
    t = timeline(spark, sf_dir)
    each = [t.search(text).agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "n") for k, text in enumerate(texts)]
    return reduce(DataFrame.unionAll, each)


_EDITED = ["level = 'click'", "level IN ('click', 'view')", f"level IN ('click', 'view') AND ({_tagged('''tag_value = 'logon' ''')} OR NOT {_tagged()})"]
_EDITED += [f"{_EDITED[-1]} AND NOT (event_id_source = '2') AND host = 'WS3'", f"{_EDITED[-1]} AND NOT (event_id_source = '2')"]
_EDITED += [f"{_EDITED[-1]} AND timestamp_utc >= TIMESTAMP '2024-01-05'", f"{_EDITED[-1]} AND timestamp_utc >= TIMESTAMP '2024-01-05' AND level = 'click'"]
_add(
    "query_text_edits",
    _query_texts,
    f"{_SQL} " + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS step, count(*) AS n FROM x WHERE (contains(message, 'user') OR contains(raw, 'user')) AND {where}" for k, where in enumerate(_EDITED)),
)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).search(q.context_window(datetime(2024, 1, 10, 12), 60)).select("event_id_source", "event_id_seq")


_add("context_window", _context, f"{_SQL} SELECT {_KEYS} FROM x WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-10 11:00:00' AND TIMESTAMP '2024-01-10 13:00:00'")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp_utc")
    zones = [display_text(at, Zone.parse(z)).alias(n) for n, z in (("berlin", "Europe/Berlin"), ("kolkata", "+0530"), ("new_york", "America/New_York"))]
    return entries(spark, sf_dir).select("event_id_seq", *zones)


def _zone_sql(name: str, zone: str) -> str:
    """Local time and the difference to UTC."""
    local = f"timezone('{zone}', timezone('UTC', timestamp_utc))"
    minutes = f"datediff('minute', date_trunc('minute', timestamp_utc), date_trunc('minute', {local}))"
    return f"{_TS.format(local)} || ' ' || CASE WHEN {minutes} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({minutes}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({minutes}) % 60 AS VARCHAR), 2, '0') AS {name}"


_add("display_zones", _zones, f"{_SQL} SELECT event_id_seq, {_zone_sql('berlin', 'Europe/Berlin')}, {_zone_sql('kolkata', 'Asia/Kolkata')}, {_zone_sql('new_york', 'America/New_York')} FROM x")


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules in one pass over records of all three kinds, counts by rule."""
    ids = "element_at(array(4624, 4625, 1102, 4720, 7045, 99999), CAST(event_id_seq % 6 + 1 AS INT))"
    evtx = f"""concat('{{"Event":{{"System":{{"EventID":', {ids}, '}}}}}}')"""
    journal = """concat('{"SYSLOG_IDENTIFIER":"', element_at(array('sshd', 'sudo', 'kernel', 'x'), CAST(event_id_seq % 4 + 1 AS INT)), '","_TRANSPORT":"', CASE WHEN event_id_seq % 2 = 0 THEN 'kernel' ELSE 'journal' END, '"}')"""
    rows = entries(spark, sf_dir).withColumn("fields", F.expr(f"CASE event_id_source WHEN '0' THEN {evtx} WHEN '1' THEN {journal} ELSE fields END"))
    needle = F.element_at(F.array(*[F.lit(n) for n in _needles()]), (F.col("event_id_seq") % len(_needles()) + 1).cast("int"))
    rows = rows.withColumn("message", F.concat(F.lit("x "), needle, F.lit(" y")))
    return retag_summary(apply_rules(taggable(rows, sources(spark)), packs.all_rules()))


def _needles() -> list[str]:
    """The needles of the packs, in order."""
    return sorted({n for r in packs.all_rules() for n in r.needles()})


def _packs_sql() -> str:
    """The packs themselves as SQL: one condition a rule, over the same records."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    paths = {("evtx", "event_id"): "$.Event.System.EventID", ("evtx", "provider"): "$.Event.System.Provider_attributes.Name", ("journald", "process"): "$.SYSLOG_IDENTIFIER"}
    rules = []
    for r in packs.all_rules():
        m = dict(r.match)
        kind, parts = m["sourcetype"], []
        for k, v in m.items():
            if k == "message_contains":
                parts.append("(" + " OR ".join(f"contains(message, {text(n)})" for n in r.needles()) + ")")
            elif k in ("sourcetype", "level", "message"):
                parts.append(f"{k} = {text(v)}")
            else:
                parts.append(f"json_extract_string(fields, {text(paths.get((kind, k), '$.' + k))}) = {text(str(v))}")
        rules.append(f"SELECT {text(r.name)} AS rule_name FROM p WHERE {' AND '.join(parts)}")
    needles = ", ".join(map(text, _needles()))
    return f"""{_SQL}, p AS (SELECT event_id_seq, sourcetype, level, 'x ' || ([{needles}])[event_id_seq % {len(_needles())} + 1] || ' y' AS message, CASE event_id_source
      WHEN '0' THEN '{{"Event":{{"System":{{"EventID":' || ([4624, 4625, 1102, 4720, 7045, 99999])[event_id_seq % 6 + 1] || '}}}}}}'
      WHEN '1' THEN '{{"SYSLOG_IDENTIFIER":"' || (['sshd', 'sudo', 'kernel', 'x'])[event_id_seq % 4 + 1] || '","_TRANSPORT":"' || CASE WHEN event_id_seq % 2 = 0 THEN 'kernel' ELSE 'journal' END || '"}}'
      ELSE fields END AS fields FROM x WHERE sourcetype IS NOT NULL)
    SELECT rule_name, count(*) AS n FROM ({' UNION ALL '.join(rules)}) GROUP BY rule_name"""


_add("builtin_rules", _packs, _packs_sql())


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a file stream, tagged batch by batch."""
    base = _shared(spark)
    rows = _read(spark, sf_dir, "events").selectExpr("CAST(ts AS STRING) AS timestamp_utc", "event_type AS level", "concat(event_type, ' by user ', user_id) AS message", "event_id AS seq")
    rows.write.json(f"{base}/in")
    session = Session(spark, f"{base}/session")
    watch(session, f"{base}/in", "app", [Rule("buys", "money", (("message_contains", "purchase"),))], f"{base}/checkpoint", "live").awaitTermination()
    return session.timeline().search("tag=money").select("event_id_seq", "timestamp_utc", "message")


_add("stream_ingest", _stream, "SELECT event_id AS event_id_seq, ts AS timestamp_utc, concat(event_type, ' by user ', user_id) AS message FROM events WHERE contains(event_type, 'purchase')")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
