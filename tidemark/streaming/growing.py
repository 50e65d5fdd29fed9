"""Text logs that grow: chunks of a log as they arrive, with records that go on from one chunk to the next.

A log is a folder of chunks (rotated or appended parts) whose names order them.  What a log has begun and not ended is kept
as keyed state across micro-batches: a last line without its end, and the record that the next line may continue.  A record
comes out when the next one begins, or after a time without any chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import model
from tidemark.operators.tagging import Rule, tag_entries
from tidemark.plans.session import Session, utc_now
from tidemark.sources.formats import TextFormat
from tidemark.sources.text import parse_records, parsed_by_columns

RECORDS = "event_id_source string, event_id_seq long, line long, raw string, valid boolean"
#: The unfinished last line, the unfinished record and its first line, and the numbers of the next line and record.
_STATE = "tail string, record string, record_line long, line long, seq long"
#: Reasons for skipped records that the activity log gets of one batch.
MOST_REASONS = 20


class Assembler:
    """Records of one log from its chunks; the state is that of :data:`_STATE`."""

    def __init__(self, start: str | None, state: tuple | None):
        self.start = regex.compile(start) if start is not None else None
        self.tail, self.record, self.record_line, self.line, self.seq = state or ("", None, 0, 1, 0)
        self.out: list[tuple[int, int, str]] = []

    def state(self) -> tuple:
        return self.tail, self.record, self.record_line, self.line, self.seq

    def add(self, chunk: str) -> None:
        *lines, self.tail = (self.tail + chunk).split("\n")
        for text in lines:
            self._line(text)

    def _line(self, text: str) -> None:
        text = text.removesuffix("\r")
        if self.record is not None and self.start is not None and not self.start.search(text):
            self.record += "\n" + text
        else:
            self._end()
            self.record, self.record_line = text, self.line
        self.line += 1

    def _end(self) -> None:
        if self.record is not None:
            self.out.append((self.seq, self.record_line, self.record))
            self.seq, self.record = self.seq + 1, None

    def flush(self) -> None:
        """End what is unfinished."""
        if self.tail:
            text, self.tail = self.tail, ""
            self._line(text)
        self._end()

    def unfinished(self) -> bool:
        return bool(self.tail) or self.record is not None


def growing_records(chunks: DataFrame, fmt: TextFormat, idle_ms: int) -> DataFrame:
    """:data:`RECORDS` of a stream of chunks (event_id_source, path, value); a task sees the chunks of one log in one batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Assembler(fmt.multiline_start, state.get if state.exists else None)
        if state.hasTimedOut:
            log.flush()
        else:
            for b in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.path):
                log.add(b.value)
        state.update(log.state())
        if log.unfinished():
            state.setTimeoutDuration(idle_ms)
        rows = [(key[0], seq, line, raw, "�" not in raw) for seq, line, raw in log.out]
        yield pd.DataFrame(rows, columns=["event_id_source", "event_id_seq", "line", "raw", "valid"])

    return chunks.groupBy("event_id_source").applyInPandasWithState(run, RECORDS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch_text(
    session: Session, folder: str, fmt: TextFormat, rules: list[Rule], checkpoint: str, name: str, zone: str | None = None, idle_ms: int = 60_000, trigger: dict | None = None
) -> StreamingQuery:
    """Append the records of the logs below ``folder`` to ``session`` as their chunks arrive; each folder of chunks is a source ``name/folder``.

    Each batch is a load named by ``name`` and its number, with entries, new sources and tags together; a batch that is run
    again is stored once.  Records that cannot be read are left out, and the activity log says how many and why.
    """
    spark, fmt = session.spark, fmt.with_assumptions(zone).validate()
    path = F.col("_metadata.file_path")
    log = F.concat(F.lit(f"{name}/"), F.element_at(F.split(path, "/"), -2))
    chunks = spark.readStream.text(f"{folder.rstrip('/')}/*", wholetext=True).select(log.alias("event_id_source"), path.alias("path"), "value")

    def write(batch: DataFrame, number: int) -> None:
        load = f"{name}-{number}"
        if session.committed(load) is not None:
            batch.write.format("noop").mode("overwrite").save()  # the state of the logs goes on all the same
            return
        session.begin(load)
        batch = batch.persist()
        try:
            parsed = parsed_by_columns(batch, fmt)
            parsed = parse_records(batch, fmt) if parsed is None else parsed
            session.write_entries(parsed.where("error is null").select(*model.LOG_ENTRIES.names), fmt.sourcetype, load)
            bad = [r.error for r in parsed.where("error is not null").select("error").limit(MOST_REASONS).collect()]
            skipped = parsed.where("error is not null").count() if bad else 0
        finally:
            batch.unpersist()
        entries, tables = session.load_entries(load), ["log_entries"]
        known = session.sources().select(F.col("source_file_id").alias("event_id_source"))
        # a row for each log of the batch
        new = [r.event_id_source for r in entries.select("event_id_source").distinct().join(known, "event_id_source", "left_anti").collect()]
        if new:
            session.write_sources([(i, f"{folder}/{i.split('/', 1)[1]}", fmt.sourcetype, None, None) for i in new], load)
            tables.append("load_sources")
        if rules:
            both = session.sources().unionByName(spark.createDataFrame([(i, "", fmt.sourcetype, None, None) for i in new], model.SOURCES))
            session.write_tags(tag_entries(entries, both, rules, utc_now()), load)
            tables.append("load_tags")
        session.commit(load, tables, skipped=skipped)
        if skipped:
            session.record("stream", int(utc_now().timestamp()), status="ok", path=folder, sourcetype=fmt.sourcetype, skipped=[(folder, e) for e in bad])

    stream = growing_records(chunks, fmt, idle_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    # a query over what is there must end: batches without data, which end idle records, are for queries that go on
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, str(trigger is not None and "availableNow" not in trigger).lower())
    try:
        return stream.start()
    finally:
        spark.conf.set(key, before)
