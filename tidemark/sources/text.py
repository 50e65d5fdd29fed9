"""Configured text logs as normalised rows, for any number of files of any size.

Lines are read once by Spark's splittable text reader and written with their place: their file, the start of their block
and their order in the task.  A line's number is that of the lines in earlier blocks of its file and its own place in its
block, so no task sees more of a file than a block.  The table of blocks (one row a block) is broadcast up to
:data:`MOST_BLOCKS` rows, so lines of one-line records are not shuffled.  Lines of a record are gathered by record.  Records are parsed by column expressions where the format allows it
(:mod:`tidemark.sources.columns`), else in Arrow batches; files with any bad record are dropped whole and reported.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timezones import BadTime, TimeFormat, Zone
from tidemark.plans.scratch import Scratch, splits_of
from tidemark.sources.columns import java_pattern, time_column
from tidemark.sources.discovery import parts_of
from tidemark.sources.formats import TextFormat

#: Blocks whose table (about 100 bytes a row) is broadcast at most; more are joined by a shuffle.
MOST_BLOCKS = 200_000
#: Bytes of a block: records of several lines are counted by a sort of each block.
BLOCK_BYTES = 32 << 20
type Keep = Callable[[DataFrame], DataFrame]
PARSED = "event_id_source string, event_id_seq long, timestamp_utc timestamp_ntz, level string, message string, raw string, fields string, error string"


class BlockParser:
    """One record's text to (timestamp, level, message, fields JSON); errors name the line."""

    def __init__(self, fmt: TextFormat):
        fmt.validate()
        self.fmt = fmt
        self.main = regex.compile(fmt.pattern)
        self.time = TimeFormat(fmt.timestamp_format)
        self.zone = Zone.parse(fmt.assume_offset) if fmt.assume_offset is not None else None

    def parse(self, text: str, line: int):
        m = self.main.search(text)
        if not m:
            raise BadTime(f"line {line}: does not match the pattern: {text[:200]!r}")
        stamp = m["timestamp"]
        if stamp is None:
            raise BadTime(f"line {line}: the timestamp group did not match")
        try:
            at = self.time.parse(stamp, self.zone, self.fmt.assume_year)
        except BadTime as e:
            raise BadTime(f"line {line}: {e}") from None
        groups = m.groupdict()
        level, message = (groups.get(self.fmt.mapping.get(k)) for k in ("level", "message"))
        return at, level, message, json.dumps(groups, ensure_ascii=False, separators=(",", ":"))


def preview(lines: list[str], fmt: TextFormat, most: int = 20) -> list[tuple[str, str | None, str | None]]:
    """(record, message, error) of the first lines, by the parser that loads them."""
    parser, start = BlockParser(fmt), regex.compile(fmt.multiline_start) if fmt.multiline_start else None
    blocks: list[tuple[int, list[str]]] = []
    for n, line in enumerate(lines[:most], 1):
        if start is None or not blocks or start.search(line):
            blocks.append((n, [line]))
        else:
            blocks[-1][1].append(line)
    out = []
    for n, block in blocks:
        text = "\n".join(block)
        try:
            out.append((text, parser.parse(text, n)[1 + 1], None))
        except BadTime as e:
            out.append((text, None, str(e)))
    return out


def lines_of(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """event_id_source, block, place, value: all lines of ``files`` (source id, path), a final carriage return removed.

    A log in parts is one file: ``block`` counts from the first byte of its first part.
    """
    each = []
    for i, path in files:
        before = 0
        for part, size in parts_of(spark, path) or [(path, 0)]:
            each.append((i, part, before))
            before += size
    names = spark.createDataFrame([(i, metadata_path(spark, p), before) for i, p, before in each], "event_id_source string, _path string, _before long")
    lines = spark.read.option("lineSep", "\n").text([p for _, p, _ in each])
    cols = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", r"\r\z", "").alias("value"), F.is_valid_utf8("value").alias("valid"))
    # a row for each file or part: bounded by the driver's own list
    return cols.join(F.broadcast(names), "_path").select("event_id_source", (F.col("_before") + F.col("_start")).alias("block"), "place", "value", "valid")


def metadata_path(spark: SparkSession, path: str) -> str:
    """The path as Spark's file metadata gives it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)
    return re.sub(r"^file:/+", "file:/", whole.toUri().toString())


def _with_before(lines: DataFrame, blocks: DataFrame, names: list[str], keep: Keep) -> DataFrame:
    """``lines`` with the columns of ``blocks`` (a row for each block of a file), ``names`` of which become sums over the file's earlier blocks."""
    earlier = Window.partitionBy("event_id_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keep(blocks.withColumns({n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names}))
    return lines.join(F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks.hint("merge"), ["event_id_source", "block"])


def numbered(lines: DataFrame, keep: Keep) -> DataFrame:
    """``lines`` (written) with their number in their file, from 1; a task reads its blocks in order, so a block's lines have consecutive places."""
    blocks = lines.groupBy("event_id_source", "block").agg(F.count("*").alias("_lines"), F.min("place").alias("_first"))
    placed = _with_before(lines, blocks, ["_lines"], keep)
    return placed.withColumn("line", F.col("_lines") + F.col("place") - F.col("_first") + 1).drop("_lines", "_first")


def _starts(pattern: str) -> Column:
    """Whether a line begins a record."""
    java = java_pattern(pattern)
    if java is not None:
        return F.col("value").rlike(java[0])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = regex.compile(pattern).search
        for b in batches:
            yield b.map(lambda v: found(v) is not None)

    return F.pandas_udf(run, "boolean")("value")


def records_of(lines: DataFrame, fmt: TextFormat, keep: Keep) -> DataFrame:
    """event_id_source, event_id_seq, line, raw, valid: a record begins at each line that matches the start pattern, and at a file's first line."""
    each = numbered(lines, keep)
    if fmt.multiline_start is None:
        return each.select("event_id_source", (F.col("line") - 1).cast("long").alias("event_id_seq"), "line", F.col("value").alias("raw"), "valid")
    begins = each.withColumn("begins", (_starts(fmt.multiline_start) | (F.col("line") == 1)).cast("long"))
    blocks = begins.groupBy("event_id_source", "block").agg(F.sum("begins").alias("_records"))
    until = Window.partitionBy("event_id_source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = _with_before(begins.withColumn("_own", F.sum("begins").over(until)), blocks, ["_records"], keep)
    # lines before a block's first record belong to the last one of an earlier block
    grouped = placed.withColumn("event_id_seq", F.col("_records") + F.col("_own") - 1)
    whole = grouped.groupBy("event_id_source", "event_id_seq").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"), F.min("valid").alias("valid"))
    return whole.select("event_id_source", "event_id_seq", F.col("l")[0]["line"].alias("line"), F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("raw"), "valid")


def parsed_by_columns(records: DataFrame, fmt: TextFormat) -> DataFrame | None:
    """:data:`PARSED` rows by column expressions, or None for a format that needs more."""
    java = java_pattern(fmt.pattern)
    if java is None:
        return None
    pattern, names = java
    groups = {n: F.regexp_extract("raw", pattern, k) for n, k in names.items()}
    at = time_column(F.col("_stamp"), TimeFormat(fmt.timestamp_format), Zone.parse(fmt.assume_offset) if fmt.assume_offset is not None else None, fmt.assume_year)
    if at is None:
        return None
    rows = records.withColumn("_stamp", groups["timestamp"]).withColumn("_at", at)
    line = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "))
    error = (
        F.when(~F.col("valid"), F.concat(line, F.lit("not UTF-8")))
        .when(~F.col("raw").rlike(pattern), F.concat(line, F.lit("does not match the pattern: "), F.substring("raw", 1, 200)))
        .when(F.col("_at").isNull(), F.concat(line, F.lit("no single time: "), "_stamp"))
    )
    good = lambda c: F.when(F.col("error").isNull(), c)
    mapped = [good(groups[g]) if (g := fmt.mapping.get(n)) else F.lit(None).cast("string") for n in ("level", "message")]
    fields = F.to_json(F.struct(*[c.alias(n) for n, c in groups.items()]))
    return rows.withColumn("error", error).select("event_id_source", "event_id_seq", good(F.col("_at")).alias("timestamp_utc"), mapped[0].alias("level"), mapped[1].alias("message"), "raw", good(fields).alias("fields"), "error")


def parse_records(records: DataFrame, fmt: TextFormat) -> DataFrame:
    """:data:`PARSED` rows; ``error`` says why a record cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = BlockParser(fmt)
        for b in batches:
            out = []
            for source, seq, line, raw, valid in b.itertuples(index=False):
                try:
                    if not valid:
                        raise BadTime(f"line {line}: not UTF-8")
                    out.append((source, seq, *(r := parser.parse(raw, line))[:3], raw, r[3], None))
                except BadTime as e:
                    out.append((source, seq, None, None, None, raw, None, str(e)))
            yield pd.DataFrame(out, columns=["event_id_source", "event_id_seq", "timestamp_utc", "level", "message", "raw", "fields", "error"]).astype({"timestamp_utc": "datetime64[us]"})

    return records.select("event_id_source", "event_id_seq", "line", "raw", "valid").mapInPandas(run, PARSED)


def read_text(spark: SparkSession, files: list[tuple[str, str]], fmt: TextFormat, keep: Keep | None = None) -> DataFrame:
    """:data:`PARSED` rows of ``files`` (source id, path); ``keep`` writes a DataFrame once and reads it back."""
    fmt.validate()
    keep = keep or Scratch(spark).keep
    with splits_of(spark, BLOCK_BYTES):
        lines = keep(lines_of(spark, files))
    records = records_of(lines, fmt, keep)
    by_columns = parsed_by_columns(records, fmt)
    return parse_records(records, fmt) if by_columns is None else by_columns
