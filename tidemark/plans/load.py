"""Loads: files of one kind into a session, each file whole or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model, packs
from tidemark.operators.tagging import Rule, tag_entries
from tidemark.plans import ngrams
from tidemark.plans.scratch import Scratch
from tidemark.plans.session import STORED, Session, utc_now
from tidemark.plans.watching import Cancelled, Done, Watch
from tidemark.sources.discovery import byte_size, source_files
from tidemark.sources.formats import BadFormat, TextFormat
from tidemark.sources.journald import read_journals
from tidemark.sources.records import read_aul_records, read_evtx_records
from tidemark.sources.text import Keep, read_text


class LoadError(ValueError):
    """A load that cannot begin."""


@dataclass
class LoadSummary:
    inserted: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    tags_by_rule: dict[str, int] = field(default_factory=dict)
    source_ids: dict[str, str] = field(default_factory=dict)

    def add(self, other: LoadSummary) -> None:
        self.inserted |= other.inserted
        self.skipped |= other.skipped
        self.source_ids |= other.source_ids
        for rule, n in other.tags_by_rule.items():
            self.tags_by_rule[rule] = self.tags_by_rule.get(rule, 0) + n


def read(session: Session, kind: str, files: list[tuple[str, str]], fmt: TextFormat | None, keep: Keep) -> DataFrame:
    if kind == "text":
        return read_text(session.spark, files, fmt, keep)
    if kind == "journald":
        return read_journals(session.spark, files)
    if kind == "evtx":
        return read_evtx_records(session.spark, files, packs.templates(), keep)
    if kind == "aul":
        return read_aul_records(session.spark, files, keep)
    raise LoadError(f"unknown kind of source {kind!r}")


@dataclass(frozen=True)
class Progress:
    """How far a load has come: files and bytes of the groups that are stored, and what the running step has done."""

    files: int
    total_files: int
    bytes: int
    total_bytes: int
    running: Done | None = None


def load(
    session: Session, kind: str, path: str, fmt: TextFormat | None = None, rules: list[Rule] = (), suffix: str | None = None, zone: str | None = None, ids: list[str] | None = None,
    group: int | None = None, progress: Callable[[Progress], None] | None = None, cancelled: Callable[[], bool] | None = None, name: str | None = None, index: bool = True,
) -> LoadSummary:
    """Load a file or folder: entries with their sources, tags and text index, which become visible together.

    ``zone`` is assumed for a text format that names none.  ``ids`` fixes the source ids (tests).  A file with a bad
    record, and one without records, is skipped with a reason; the others are loaded.  With ``group`` the files are
    loaded that many at a time.  ``progress`` is told after each group, and while jobs run, what they have read and written.
    Where ``cancelled`` says so the running jobs end; the groups that are stored stay, the running one leaves nothing.

    ``name`` names the load.  A load that failed or was stopped leaves nothing that a reader sees; done again under its
    name it replaces what is left of it, and what it had committed (all, or some groups of files) is not done again.
    """
    started, sourcetype = int(time.time()), fmt.sourcetype if kind == "text" and fmt else kind
    summary, status = LoadSummary(), "ok"
    try:
        if kind == "text" and fmt is None:
            raise LoadError("a text source needs a format")
        found = source_files(session.spark, kind, path, suffix)
        if not found:
            raise LoadError(f"no {kind} files in {path}")
        files = list(zip(ids or [str(uuid.uuid4()) for _ in found], found))
        name = name or uuid.uuid4().hex
        assumed = fmt.with_assumptions(zone) if fmt else None
        sizes = [byte_size(session.spark, p) for _, p in files] if progress else []
        step = group or len(files)

        def told(at: int, done: Done | None = None) -> None:
            progress(Progress(min(at, len(files)), len(files), sum(sizes[:at]), sum(sizes), done))

        for at in range(0, len(files), step):
            watch = Watch(session.spark, (lambda done, at=at: told(at, done)) if progress is not None else None, cancelled)
            try:
                summary.add(_load(session, kind, files[at : at + step], assumed, list(rules), sourcetype, f"{name}-{at // step}", index, watch))
            except Cancelled:
                status = "cancelled"
                break
            if progress is not None:
                told(at + step)
    except Exception as e:
        session.record("load", started, status="failed", path=path, sourcetype=sourcetype, error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        raise
    session.record(
        "load", started, status=status, path=path, sourcetype=sourcetype, inserted=sum(summary.inserted.values()), tags_applied=sum(summary.tags_by_rule.values()),
        skipped=list(summary.skipped.items()), per_file=list(summary.inserted.items()), tags_by_rule=list(summary.tags_by_rule.items()),
    )
    return summary


def _load(session: Session, kind: str, files: list[tuple[str, str]], fmt: TextFormat | None, rules: list[Rule], sourcetype: str, name: str, index: bool, watch: Watch) -> LoadSummary:
    spark = session.spark
    done = session.committed(name)
    if done is not None:
        return LoadSummary(done["inserted"], done["skipped"], done["tags_by_rule"], done["source_ids"])
    staged_path = f"{session.path}/staging/{name}"
    try:
        if fmt is not None:
            fmt.validate()
    except BadFormat as e:
        raise LoadError(str(e)) from None
    own = Scratch(spark, staged_path)
    own.clear()
    try:
        return _stored(session, kind, files, fmt, rules, sourcetype, name, index, watch, own)
    finally:
        own.clear()


def _stored(session: Session, kind: str, files: list[tuple[str, str]], fmt: TextFormat | None, rules: list[Rule], sourcetype: str, name: str, index: bool, watch: Watch, own: Scratch) -> LoadSummary:
    spark = session.spark
    staged = watch.step("reading", lambda: own.keep(read(session, kind, files, fmt, own.keep)))
    # one row for each file of the driver's own list
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("event_id_seq", "error")))
    state = {r["event_id_source"]: r for r in staged.groupBy("event_id_source").agg(F.count("*").alias("n"), first.alias("bad")).collect()}
    summary, good = LoadSummary(), []
    for i, p in files:
        if i not in state:
            summary.skipped[p] = "no matching entries"
        elif state[i]["bad"] is not None:
            summary.skipped[p] = state[i]["bad"]["error"]
        else:
            summary.inserted[p], summary.source_ids[p] = state[i]["n"], i
            good.append(i)
    if not good:
        return summary
    session.begin(name)
    tables = ["log_entries", "load_sources"]
    kept = spark.createDataFrame([(i,) for i in good], "event_id_source string")
    rows = staged.join(F.broadcast(kept), "event_id_source", "left_semi").select(*model.LOG_ENTRIES.names)
    watch.step("storing", lambda: session.write_entries(rows, sourcetype, name))
    source_rows = [(i, p, sourcetype, None, None) for p, i in summary.source_ids.items()]
    session.write_sources(source_rows, name)
    if rules:
        known = spark.createDataFrame(source_rows, model.SOURCES)
        watch.step("tagging", lambda: session.write_tags(tag_entries(session.load_entries(name), known, rules, utc_now()), name))
        tables.append("load_tags")
        counted = session.loaded("load_tags", model.IMPORT_TAGS, [{"load": name, "tables": tables}]).groupBy("rule_name").count().collect()
        summary.tags_by_rule = {r["rule_name"]: r["count"] for r in counted}
    if index:
        watch.step("indexing", lambda: ngrams.write(session, name, STORED))
        tables += ["ngrams", "ngram_files"]
    session.commit(name, tables, inserted=summary.inserted, skipped=summary.skipped, tags_by_rule=summary.tags_by_rule, source_ids=summary.source_ids)
    return summary
