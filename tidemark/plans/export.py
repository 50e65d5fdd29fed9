"""Exports of a filtered timeline."""

from __future__ import annotations

import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timezones import Zone
from tidemark.operators.timeline import Timeline

#: Fixed order of columns.
COLUMNS = ["timestamp", "level", "source", "sourcetype", "host", "process", "event_code", "subsystem", "category", "tags", "notes", "message"]


def export_rows(timeline: Timeline, text: str, zone: Zone = Zone(minutes=0)) -> DataFrame:
    """All matching rows in timeline order as strings; a bad pattern is an error, unlike in a search."""
    rows = timeline.ordered(timeline.search(text, strict=True), zone)
    joined = rows.withColumn("tags", F.array_join("tags", ";")).withColumn("notes", F.array_join("notes", " | "))
    return joined.withColumnRenamed("timestamp_display", "timestamp").select(*COLUMNS)


def is_json(path: str) -> bool:
    return str(path).lower().endswith(".json")


def export_folder(timeline: Timeline, text: str, path: str, zone: Zone = Zone(minutes=0)) -> None:
    """A folder of part files in timeline order, written by all executors: CSV, or for ``.json`` a JSON object a line."""
    writer = export_rows(timeline, text, zone).write
    if is_json(path):
        writer.json(path)
    else:
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def _lines(rows: DataFrame, as_json: bool) -> DataFrame:
    """Each row as one text: a JSON object, or a CSV record with quotes where a value has a comma, a quote or a line break."""
    if as_json:
        return rows.select(F.to_json(F.struct(*COLUMNS)).alias("value"))
    quoted = [F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in COLUMNS]
    return rows.select(F.concat_ws(",", *quoted).alias("value"))


def export_file(timeline: Timeline, text: str, path: str | Path, zone: Zone = Zone(minutes=0)) -> int:
    """One file in any store: CSV, or for ``.json`` one array. Returns the number of rows.

    Executors write the rows in ranges of the timeline's order, as text with its separators.  The parts are then joined by
    the store itself if it can, else their bytes are copied one part after the other; no row comes to the driver.  The file
    appears whole under its name.
    """
    spark, as_json = timeline.entries.sparkSession, is_json(str(path))
    path = Path(path).absolute().as_uri() if isinstance(path, Path) else path
    seen, work = Observation(), f"{path}.parts-{uuid.uuid4().hex}"
    lines = _lines(export_rows(timeline, text, zone), as_json).observe(seen, F.count("*").alias("n"))
    # a separator follows every row; that of the last one is cut off
    lines.write.option("lineSep", ",\n" if as_json else "\n").text(f"{work}/rows")
    head, tail = ("[\n", "\n]\n") if as_json else (",".join(COLUMNS) + "\n", "")
    try:
        _joined(spark, path, work, head, tail, len(",\n") if as_json else 0)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(work)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return seen.get["n"]


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an array that :func:`export_file` wrote: a row is a line, so any number of tasks read the file."""
    lines = spark.read.option("lineSep", "\n").text(path).where(~F.col("value").isin("[", "]", ""))
    return lines.select(F.from_json(F.regexp_replace("value", r",\z", ""), schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def _joined(spark: SparkSession, path: str, work: str, head: str, tail: str, cut: int) -> None:
    """Write ``path`` from ``head``, the parts below ``work``/rows less their last ``cut`` bytes, and ``tail``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    target, whole = at(path), at(f"{work}/whole")
    files = target.getFileSystem(conf)
    parts = sorted((f.getPath().toString(), f.getLen()) for f in files.listStatus(at(f"{work}/rows")) if f.getPath().getName().startswith("part-") and f.getLen())
    if parts:
        name, size = parts[-1]
        parts[-1] = (name, size - cut)  # a part holds whole rows, so its last separator is in it

    def written(name, text: str) -> None:
        out = files.create(name, True)
        out.write(bytearray(text.encode()))
        out.close()

    try:
        if cut and parts and not files.truncate(at(parts[-1][0]), parts[-1][1]):
            raise OSError("the store shortens files later")
        written(whole, head)
        written(at(f"{work}/tail"), tail)
        each = [at(name) for name, _ in parts] + ([at(f"{work}/tail")] if tail else [])
        moved = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(each))
        for k, p in enumerate(each):
            moved[k] = p
        files.concat(whole, moved)
    except (Py4JJavaError, PySparkException, OSError):
        # a store without concatenation, the local one for example
        out = files.create(whole, True)
        out.write(bytearray(head.encode()))
        for name, size in parts:
            source = files.open(at(name))
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
            source.close()
        out.write(bytearray(tail.encode()))
        out.close()
    files.delete(target, False)
    if not files.rename(whole, target):
        raise OSError(f"{path} could not be written")
