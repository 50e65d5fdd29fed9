"""Schemas of the timeline and session tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _TIME, _BOOL = T.StringType(), T.LongType(), T.TimestampNTZType(), T.BooleanType()


def _schema(required: dict | None = None, **optional: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(k, v, False) for k, v in (required or {}).items()), *(T.StructField(k, v) for k, v in optional.items())])


def _list_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(_schema(**fields))


KEY = ["event_id_source", "event_id_seq"]
_KEY = {"event_id_source": _STRING, "event_id_seq": _LONG}
LOG_ENTRIES = T.StructType(
    [*_schema(_KEY | {"timestamp_utc": _TIME}, level=_STRING, message=_STRING).fields, T.StructField("raw", _STRING, False), T.StructField("fields", _STRING)]
)
SOURCES = _schema({"source_file_id": _STRING, "path": _STRING, "sourcetype": _STRING}, original_tz=_STRING, parser_config=_STRING)
IMPORT_TAGS = _schema(_KEY | {"rule_name": _STRING, "tag_value": _STRING, "applied_at": _TIME})
ANALYST_TAGS = _schema(id=_LONG, **_KEY, tag_value=_STRING, note=_STRING, created_at=_LONG)
#: Notes are a log of operations: the row of an id with the highest ``version`` holds, unless it is a deletion.
EVENT_NOTES = _schema(id=_LONG, version=_LONG, deleted=_BOOL, **_KEY, note=_STRING, created_at=_LONG)
SESSION_STATE = _schema(key=_STRING, version=_LONG, value=_STRING)
ACTIVITY_LOG = _schema(
    id=_LONG, operation=_STRING, started_at=_LONG, finished_at=_LONG, source_path=_STRING, sourcetype=_STRING, status=_STRING, error=_STRING, entries_inserted=_LONG, tags_applied=_LONG,
    skipped=_list_of(path=_STRING, reason=_STRING), per_file=_list_of(path=_STRING, inserted=_LONG), tags_by_rule=_list_of(rule_name=_STRING, count=_LONG),
)
