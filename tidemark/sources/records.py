"""Windows event and unified-log records given as JSON lines, by column expressions.

Decoders of the binary formats are not part of this engine; their output, one JSON record a line, is.  A record that is
no JSON or has no valid time is an error of its file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.places import with_places
from tidemark.plans.scratch import Scratch
from tidemark.sources.text import Keep, lines_of, numbered

#: Put before a message that comes from a template and not from the log itself.
RENDERED = "[rendered] "
_PLACE = re.compile(r"\{([A-Za-z0-9_]+)\}", re.ASCII)


def _scalar(path: str) -> Column:
    """A JSON string, number or boolean as text; null for an object, an array or none."""
    kind = F.schema_of_variant(F.try_variant_get(F.col("_v"), path, "variant"))
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), F.get_json_object("value", path))


def instant(micros: Column) -> Column:
    """UTC of microseconds since 1970 as TIMESTAMP_NTZ, without the session's zone, whose clock changes would move it."""
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def filled(template: str) -> Column:
    """``{Name}`` becomes the string of that name in the record's EventData; anything else, numbers too, stays as it is."""
    parts = []
    for k, part in enumerate(_PLACE.split(template)):
        if k % 2 == 0:
            parts.append(F.lit(part))
            continue
        value = F.try_variant_get("_v", f"$.Event.EventData.{part}", "variant")
        parts.append(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise("{" + part + "}"))
    return F.concat(*parts)


def rendered_message(templates: dict[tuple[str, int], str]) -> Column:
    """The filled template of the record's provider and event id, or null. The table is package data of fixed size."""
    provider = F.get_json_object("value", "$.Event.System.Provider_attributes.Name")
    event = F.try_variant_get("_v", "$.Event.System.EventID", "bigint")
    # one flat CASE: its conditions are compared one after the other
    out = F
    for (name, number), template in templates.items():
        out = out.when((provider == name) & (event == number), F.concat(F.lit(RENDERED), filled(template)))
    return F.lit(None).cast("string") if out is F else out


def _parsed(rows: DataFrame, at: Column, level: Column, message: Column, fields: Column) -> DataFrame:
    error = F.when(F.col("_v").isNull(), "not a JSON record").when(at.isNull(), "record without a valid time")
    return rows.select("event_id_source", "event_id_seq", at.alias("timestamp_utc"), level.alias("level"), message.alias("message"), F.coalesce(fields, "value").alias("raw"), fields.alias("fields"), error.alias("error"))


def read_evtx_records(spark: SparkSession, files: list[tuple[str, str]], templates: dict[tuple[str, int], str], keep: Keep | None = None) -> DataFrame:
    """Records ``{"event_record_id": n, "timestamp": RFC 3339, "Event": {...}}``; without a timestamp that of the System block holds."""
    keep = keep or Scratch(spark).keep
    rows = numbered(keep(lines_of(spark, files)), keep).withColumn("event_id_seq", (F.col("line") - 1).cast("long")).withColumn("_v", F.try_parse_json("value"))
    stamp = F.coalesce(F.get_json_object("value", "$.timestamp"), F.get_json_object("value", "$.Event.System.TimeCreated_attributes.SystemTime"))
    at = instant(F.unix_micros(F.try_to_timestamp(stamp)))
    record = F.coalesce(F.to_json(F.try_variant_get("_v", "$.event_record_id", "variant")), F.lit("null"))
    event = F.coalesce(F.to_json(F.try_variant_get("_v", "$.Event", "variant")), F.lit("null"))
    fields = F.concat(F.lit('{"event_record_id":'), record, F.lit(',"Event":'), event, F.lit("}"))
    message = F.coalesce(_scalar("$.Event.RenderingInfo.Message"), rendered_message(templates))
    return _parsed(rows, at, _scalar("$.Event.System.Level"), message, F.when(F.col("_v").isNotNull(), fields))


def read_aul_records(spark: SparkSession, files: list[tuple[str, str]], keep: Keep | None = None) -> DataFrame:
    """Unified-log records with ``time`` in nanoseconds; numbered by time, then evidence file, then order in the file.

    A record's number is its place among all records by source, time and so on, less that of its source's first record, so
    no task sees a whole source.  ``keep`` writes a DataFrame once and reads it back.
    """
    lines = lines_of(spark, files).withColumn("_nanos", F.try_variant_get(F.try_parse_json("value"), "$.time", "double"))
    order = [F.col("event_id_source"), F.col("_nanos"), F.get_json_object("value", "$.evidence"), F.col("block"), F.col("place")]
    placed = with_places(lines, [c.asc() for c in order], keep or Scratch(spark).keep, place="_place")
    # a row for each file of the driver's own list
    first = placed.groupBy("event_id_source").agg(F.min("_place").alias("_first"))
    rows = placed.join(F.broadcast(first), "event_id_source").withColumn("event_id_seq", F.col("_place") - F.col("_first")).withColumn("_v", F.try_parse_json("value"))
    at = instant(F.floor(F.round("_nanos") / 1000).cast("long"))
    return _parsed(rows, at, F.get_json_object("value", "$.log_type"), F.get_json_object("value", "$.message"), F.when(F.col("_v").isNotNull(), F.col("value")))
