"""Files as they arrive: a file stream of JSON records, normalised and tagged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.tagging import Rule, tag_entries
from tidemark.plans.session import Session, utc_now
from tidemark.sources.records import instant

#: Normalised records as JSON lines.
RECORD = "timestamp_utc timestamp_ntz, level string, message string, raw string, fields string, seq long"


def watch(session: Session, folder: str, sourcetype: str, rules: list[Rule], checkpoint: str, source_id: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the records of new files of ``folder`` to ``session`` under one source, and tag each batch.

    Each batch is a load named by the source and the batch's number, entries and tags together.  A batch that is run again
    replaces what its first run left, if that was not committed, and is not stored again if it was.
    """
    spark = session.spark
    if session.sources().where(F.col("source_file_id") == source_id).isEmpty():
        session.append("sources", [(source_id, folder, sourcetype, None, None)])

    def write(batch: DataFrame, number: int) -> None:
        name = f"{source_id}-{number}"
        if session.committed(name) is not None:
            return
        session.begin(name)
        rows = batch.select(F.lit(source_id).alias("event_id_source"), F.col("seq").alias("event_id_seq"), "timestamp_utc", "level", "message", F.coalesce("raw", F.lit("")).alias("raw"), "fields")
        session.write_entries(rows, sourcetype, name)
        tables = ["log_entries"]
        if rules:
            session.write_tags(tag_entries(session.load_entries(name), session.sources(), rules, utc_now()), name)
            tables.append("load_tags")
        session.commit(name, tables)

    stream = spark.readStream.schema(RECORD).json(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by level and time window of a record stream; records later than ``late`` are dropped.

    The session's zone has no part in it: a time becomes an instant by its distance from 1970, and a window's bounds become
    UTC times again in the same way.
    """
    zero = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, F.col("timestamp_utc"))).alias("at")
    counts = stream.select(at, "level").withWatermark("at", late).groupBy(F.window("at", width), "level").agg(F.count("*").alias("n"))
    bounds = [instant(F.unix_micros(f"window.{c}")).alias(c) for c in ("start", "end")]
    return counts.select(F.struct(*bounds).alias("window"), "level", "n")
