"""A session: a folder of Parquet tables with the timeline and the analyst's state.

A load (or a retagging) writes its tables below a folder of its own name and then one small file in ``commits``.  Readers
see the folders of committed loads only, so a load is there with its entries, sources and tags, or not at all, wherever it
stops.  A load that is done again under its name first removes what the attempt before it left; one that is committed is
not done again.  Small state tables are kept by one driver; the timeline tables may be of any size.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark import model
from tidemark.functions.extract import PATHS, virtual
from tidemark.operators.tagging import Rule, retag_summary, tag_entries
from tidemark.operators.timeline import Counts, Timeline
from tidemark.plans.ngrams import NgramIndex
from tidemark.plans.ranking import Ranking
from tidemark.plans.scratch import splits_of

_SCHEMAS = {"sources": model.SOURCES, "analyst_tags": model.ANALYST_TAGS, "event_notes": model.EVENT_NOTES, "session_state": model.SESSION_STATE, "activity_log": model.ACTIVITY_LOG}
#: Entries are stored with their sourcetype and virtual columns, so that filters on them reach the Parquet scan.
#: Tables that a load may write.
LOADED = ["log_entries", "load_sources", "load_tags", "entry_counts", "tag_counts", "ngrams", "ngram_files"]
#: Counts that are written with a load's entries and tags: the menus add them up and scan neither.
ENTRY_COUNTS = T.StructType([T.StructField("event_id_source", T.StringType()), T.StructField("level", T.StringType()), T.StructField("sourcetype", T.StringType()), T.StructField("n", T.LongType())])
TAG_COUNTS = T.StructType([T.StructField("event_id_source", T.StringType()), T.StructField("rule_name", T.StringType()), T.StructField("tag_value", T.StringType()), T.StructField("n", T.LongType())])
_COUNTED = {"log_entries": "entry_counts", "load_tags": "tag_counts"}
#: Bytes of files whose entries a task sorts: compressed they are a tenth of its rows or less.
SORTED_BYTES = 32 << 20
STORED = T.StructType([*model.LOG_ENTRIES.fields, T.StructField("sourcetype", T.StringType()), *[T.StructField(n, T.StringType()) for n in PATHS]])


def new_session_id(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("session-%Y%m%d-%H%M%S")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Session:
    """Tables below ``path``; ``path`` may be any location Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        self._commits: dict[str, dict] = {}

    def _exists(self, name: str) -> bool:
        files, p = self._fs(f"{self.path}/{name}")
        return files.exists(p)

    def table(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or _SCHEMAS[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # loads

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commits(self) -> list[dict]:
        """What is committed, in order: number, load, tables and what else the load noted. Commits never change, so each is read once."""
        files, folder = self._fs(f"{self.path}/commits")
        names = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
        for name in names:
            if name.endswith(".json") and name not in self._commits:
                self._commits[name] = json.loads(self.spark.read.text(f"{self.path}/commits/{name}", wholetext=True).first()[0])
        return [self._commits[n] for n in names if n in self._commits]

    def committed(self, load: str) -> dict | None:
        return next((c for c in self.commits() if c["load"] == load), None)

    def folder(self, table: str, load: str) -> str:
        return f"{self.path}/{table}/load={load}"

    def begin(self, load: str) -> None:
        """Remove what an attempt of this load that was not committed has left."""
        for table in LOADED:
            files, p = self._fs(self.folder(table, load))
            files.delete(p, True)

    def commit(self, load: str, tables: list[str], **noted) -> None:
        """Make a load visible, all its tables at once: its file appears whole under its name or not at all."""
        number = max((c["number"] for c in self.commits()), default=0) + 1
        tables = [*tables, *(_COUNTED[t] for t in tables if t in _COUNTED)]
        self._put(f"commits/{number:012d}-{load}.json", json.dumps({"number": number, "load": load, "tables": tables, **noted}))

    def _put(self, name: str, text: str) -> None:
        """A small file, whole under its name or not at all."""
        files, target = self._fs(f"{self.path}/{name}")
        _, written = self._fs(f"{self.path}/{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
        files.mkdirs(target.getParent())
        out = files.create(written, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(written, target):
            raise OSError(f"{target} could not be written")

    def vacuum(self) -> list[str]:
        """Remove the tables of loads that never were committed; no load may be under way. Returns their names."""
        known, gone = {c["load"] for c in self.commits()}, set()
        for table in LOADED:
            for name in _folders(self.spark, f"{self.path}/{table}"):
                load = name.removeprefix("load=")
                if load not in known:
                    files, p = self._fs(f"{self.path}/{table}/{name}")
                    files.delete(p, True)
                    gone.add(load)
        return sorted(gone)

    def loaded(self, table: str, schema: T.StructType, commits: list[dict] | None = None) -> DataFrame:
        """A table of the committed loads (or of ``commits``)."""
        paths = [self.folder(table, c["load"]) for c in (self.commits() if commits is None else commits) if table in c["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths).select(*schema.names)

    # timeline

    def stored_entries(self) -> DataFrame:
        return self.loaded("log_entries", STORED)

    def entries(self) -> DataFrame:
        return self.stored_entries().select(*model.LOG_ENTRIES.names)

    def stored_form(self, rows: DataFrame, sourcetype: str) -> DataFrame:
        """Entries of one sourcetype as they are stored: with it and their virtual columns."""
        typed = rows.withColumn("sourcetype", F.lit(sourcetype))
        return typed.select(*model.LOG_ENTRIES.names, "sourcetype", *[virtual(n).alias(n) for n in PATHS])

    def write_entries(self, rows: DataFrame, sourcetype: str, load: str) -> None:
        """The entries of a load, a folder for each source, so that ``source_id`` prunes, in the order of their numbers."""
        stored = self.stored_form(rows, sourcetype).sortWithinPartitions(*model.KEY)
        with splits_of(rows.sparkSession, SORTED_BYTES):
            stored.write.partitionBy("event_id_source").parquet(self.folder("log_entries", load))
        self._write_counts("log_entries", STORED, ENTRY_COUNTS, load)

    def _write_counts(self, table: str, schema: T.StructType, counts: T.StructType, load: str) -> None:
        """The counts of a table of a load that is under way, from the columns that they need."""
        written = self.loaded(table, schema, [{"load": load, "tables": [table]}])
        written.groupBy(*counts.names[:-1]).agg(F.count("*").alias("n")).coalesce(1).write.parquet(self.folder(_COUNTED[table], load))

    def append_entries(self, rows: DataFrame, sourcetype: str) -> None:
        """Entries as a load of their own, without sources or tags."""
        load = uuid.uuid4().hex
        self.write_entries(rows, sourcetype, load)
        self.commit(load, ["log_entries"])

    def write_sources(self, rows: list[tuple], load: str) -> None:
        self.spark.createDataFrame(rows, model.SOURCES).coalesce(1).write.parquet(self.folder("load_sources", load))

    def write_tags(self, tags: DataFrame, load: str) -> None:
        tags.select(*model.IMPORT_TAGS.names).write.parquet(self.folder("load_tags", load))
        self._write_counts("load_tags", model.IMPORT_TAGS, TAG_COUNTS, load)

    def load_entries(self, load: str) -> DataFrame:
        """Entries of a load that is under way."""
        return self.loaded("log_entries", STORED, [{"load": load, "tables": ["log_entries"]}]).select(*model.LOG_ENTRIES.names)

    def sources(self) -> DataFrame:
        """Sources of the loads, and those that were added by hand."""
        return self.table("sources").unionByName(self.loaded("load_sources", model.SOURCES))

    def _tag_commits(self) -> list[dict]:
        """The last retagging and the loads that it had not seen."""
        commits = self.commits()
        last = next((c for c in reversed(commits) if "covers" in c), None)
        seen = set(last["covers"]) if last else set()
        return [c for c in commits if c is last or "covers" not in c and c["load"] not in seen]

    def import_tags(self) -> DataFrame:
        return self.loaded("load_tags", model.IMPORT_TAGS, self._tag_commits())

    def counts(self) -> Counts:
        """Entries by source, level and sourcetype, and import tags by source, rule and value, a row for each load or retagging."""
        return Counts(self.loaded("entry_counts", ENTRY_COUNTS), self.loaded("tag_counts", TAG_COUNTS, self._tag_commits()))

    def retag(self, rules: list[Rule]) -> dict[str, int]:
        """Recompute all import tags; the new table is complete before it replaces the old one. Returns tags by rule."""
        started, load, covers = int(time.time()), f"retag-{uuid.uuid4().hex}", self.commits()
        rows = self.loaded("log_entries", STORED, covers).select(*model.LOG_ENTRIES.names)
        self.write_tags(tag_entries(rows, self.sources(), rules, utc_now()), load)
        self.commit(load, ["load_tags"], covers=[c["load"] for c in covers])
        counts = {r["rule_name"]: r["n"] for r in retag_summary(self.import_tags()).collect()}
        self.record("retag", started, status="ok", tags_applied=sum(counts.values()), tags_by_rule=list(counts.items()))
        return counts

    def timeline(self) -> Timeline:
        """The whole session, searched by its stored columns."""
        indexed = any("ngrams" in c["tables"] for c in self.commits())
        return Timeline(self.stored_entries(), self.sources(), self.import_tags(), self.analyst_tags(), self.notes(), NgramIndex(self, STORED) if indexed else None, self.counts())

    def ranking(self, text: str = "", ranges: int | None = None) -> Ranking:
        """The result of a search by place: the stored one, if nothing was loaded or tagged since, or else a new one."""
        timeline, last = self.timeline(), max((c["number"] for c in self.commits()), default=0)
        name = f"rankings/{last:012d}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"
        if self._exists(f"{name}.json"):
            return Ranking.from_json(timeline, self.spark.read.text(f"{self.path}/{name}.json", wholetext=True).first()[0])
        found = Ranking.build(timeline, text, f"{self.path}/{name}-{uuid.uuid4().hex}", ranges)
        self._put(f"{name}.json", found.to_json())
        return found

    # analyst state

    def _next(self, name: str, column: str = "id") -> int:
        return (self.table(name).agg(F.max(column)).first()[0] or 0) + 1

    def add_tag(self, source: str, seq: int, tag: str, note: str | None = None, now: int | None = None) -> int:
        i = self._next("analyst_tags")
        self.append("analyst_tags", [(i, source, seq, tag, note, int(time.time()) if now is None else now)])
        return i

    def analyst_tags(self) -> DataFrame:
        return self.table("analyst_tags")

    def tags_of(self, source: str, seq: int) -> DataFrame:
        """Analyst tags of an event, oldest first."""
        return self.analyst_tags().where((F.col("event_id_source") == source) & (F.col("event_id_seq") == seq)).orderBy("created_at", "id")

    def add_note(self, source: str, seq: int, note: str, now: int | None = None) -> int:
        i = self._next("event_notes")
        self.append("event_notes", [(i, 1, False, source, seq, note, int(time.time()) if now is None else now)])
        return i

    def _change_note(self, i: int, note: str | None) -> bool:
        row = self._latest("event_notes", "id").where((F.col("id") == i) & ~F.col("deleted")).first()
        if row is None:
            return False
        self.append("event_notes", [(i, row["version"] + 1, note is None, row["event_id_source"], row["event_id_seq"], row["note"] if note is None else note, row["created_at"])])
        return True

    def update_note(self, i: int, note: str) -> bool:
        return self._change_note(i, note)

    def delete_note(self, i: int) -> bool:
        return self._change_note(i, None)

    def _latest(self, name: str, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("version"))
        return self.table(name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def notes(self) -> DataFrame:
        """Notes as they are now, in order of their ids."""
        return self._latest("event_notes", "id").where(~F.col("deleted")).select("id", "event_id_source", "event_id_seq", "note", "created_at").orderBy("id")

    def set_state(self, key: str, value: str | None) -> None:
        self.append("session_state", [(key, self._next("session_state", "version"), value)])

    def state(self) -> dict[str, str | None]:
        return {r["key"]: r["value"] for r in self._latest("session_state", "key").collect()}

    @property
    def search_query(self) -> str:
        return self.state().get("search_query") or ""

    @search_query.setter
    def search_query(self, text: str) -> None:
        self.set_state("search_query", text)

    @property
    def display_name(self) -> str | None:
        return self.state().get("display_name")

    @display_name.setter
    def display_name(self, name: str | None) -> None:
        self.set_state("display_name", name)

    def loaded_sources(self) -> list[str]:
        """Paths of the loaded files, in the order of their loads."""
        return [p for c in self.commits() for p in c.get("inserted", {})]

    def byte_size(self) -> int:
        files, p = self._fs(self.path)
        return files.getContentSummary(p).getLength() if files.exists(p) else 0

    def is_empty(self) -> bool:
        """Whether nothing was ever loaded or noted."""
        return self.stored_entries().isEmpty() and self.analyst_tags().isEmpty() and self.notes().isEmpty()

    def delete(self) -> None:
        files, p = self._fs(self.path)
        files.delete(p, True)

    # activity

    def record(self, operation: str, started: int, *, status: str, path: str | None = None, sourcetype: str | None = None, error: str | None = None, inserted: int | None = None, tags_applied: int | None = None, skipped=(), per_file=(), tags_by_rule=()) -> None:
        row = (self._next("activity_log"), operation, started, int(time.time()), path, sourcetype, status, error, inserted, tags_applied, list(skipped), list(per_file), list(tags_by_rule))
        self.append("activity_log", [row])

    def activity(self) -> DataFrame:
        """Newest first."""
        return self.table("activity_log").orderBy(F.desc("id"))


def _folders(spark: SparkSession, folder: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(str(folder))
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(p) if f.isDirectory()] if files.exists(p) else []


def list_sessions(spark: SparkSession, folder: str | Path) -> list[str]:
    """Session folders, newest id first."""
    return sorted((n for n in _folders(spark, folder) if n.startswith("session-")), reverse=True)


def session_counts(spark: SparkSession, folder: str | Path) -> DataFrame:
    """session, entries, newest first: one job over the entries of all sessions, of which only file footers are read."""
    names = list_sessions(spark, folder)
    ids = spark.createDataFrame([(n,) for n in names], "session string")
    each = [Session(spark, f"{folder}/{n}").stored_entries().select(F.lit(n).alias("session")) for n in names]
    if not each:
        return ids.withColumn("entries", F.lit(0).cast("long"))
    counts = reduce(DataFrame.unionAll, each).groupBy("session").agg(F.count("*").alias("entries"))
    return ids.join(counts, "session", "left").select("session", F.coalesce("entries", F.lit(0)).alias("entries")).orderBy(F.desc("session"))


def delete_if_empty(session: Session) -> bool:
    if not session.is_empty():
        return False
    session.delete()
    return True


def sweep(spark: SparkSession, folder: str | Path, keep: str | None = None) -> list[str]:
    """Delete the empty sessions of a folder but for ``keep``; their ids."""
    return [n for n in list_sessions(spark, folder) if n != keep and delete_if_empty(Session(spark, f"{folder}/{n}"))]


def epoch_text(seconds: int | None) -> str:
    """UTC of an activity's time, to seconds."""
    return "" if seconds is None else datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def size_text(n: int) -> str:
    """Bytes in decimal units."""
    size, units = float(n), ["B", "KB", "MB", "GB", "TB"]
    while size >= 1000 and len(units) > 1:
        size, units = size / 1000, units[1:]
    return f"{n} B" if units[0] == "B" else f"{size:.1f} {units[0]}"
