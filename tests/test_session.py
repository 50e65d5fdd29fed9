"""Sessions, loads, exports, streams."""

import csv
import io
import json
import random
import tempfile
from datetime import datetime, timedelta

import pytest

from tidemark import packs
from tidemark.__main__ import cleanup, main
from tidemark.functions.labels import color_slot, level_label, source_label
from tidemark.functions.timezones import Zone
from tidemark.model import IMPORT_TAGS, LOG_ENTRIES, SOURCES
from tidemark.operators.tagging import Rule
from tidemark.operators.timeline import Timeline, message_quality, resolution_by_day, sample_rows
from tidemark.plans.export import COLUMNS, export_file, export_folder, export_rows
from tidemark.plans.load import LoadError, load
from tidemark.plans.session import Session, delete_if_empty, epoch_text, list_sessions, new_session_id, session_counts, size_text, sweep
from tidemark.settings import Settings
from tidemark.sources.formats import TextFormat
from tidemark.streaming.ingest import live_counts, watch

FMT = TextFormat("iso", "app", r"^(?P<timestamp>\S+) (?P<level>[A-Z]+) (?P<message>.*)$", "%Y-%m-%dT%H:%M:%S%z", mapping={"level": "level", "message": "message"})
RULES = [Rule.from_dict({"rule": {"name": n, "tag": {"value": t}, "match": m}}) for n, t, m in (("broke", "bad", {"message_contains": "broke"}), ("app", "app", {"sourcetype": "app"}))]


@pytest.fixture()
def logs(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.log").write_text("2025-06-17T12:00:00+0200 ERROR pump 4 broke\n")
    (d / "b.log").write_text("2025-06-17T12:00:01+0200 INFO fine, \"quoted\"\n2025-06-17T12:00:02+0200 INFO broke again\n")
    (d / "c.log").write_text("2025-06-17T12:00:00+0200 ERROR good line\nnever matches\n")
    (d / "empty.log").write_text("")
    return d


@pytest.fixture()
def session(spark, tmp_path):
    return Session(spark, str(tmp_path / "session"))


def test_load_folder(session, logs):
    got = load(session, "text", str(logs), FMT, RULES, ids=["a", "b", "c", "e"])
    assert {k.rsplit("/", 1)[1]: v for k, v in got.inserted.items()} == {"a.log": 1, "b.log": 2}
    skipped = {k.rsplit("/", 1)[1]: v for k, v in got.skipped.items()}
    assert "line 2" in skipped["c.log"] and skipped["empty.log"] == "no matching entries"
    assert got.tags_by_rule == {"broke": 2, "app": 3}
    t = session.timeline()
    assert t.entries.count() == 3 and t.sources.count() == 2 and t.count("tag=bad level=INFO") == 1
    assert [r.message for r in t.window("", 0, 2).collect()] == ["pump 4 broke", 'fine, "quoted"']
    act = session.activity().first()
    assert (act.operation, act.status, act.entries_inserted, act.tags_applied) == ("load", "ok", 3, 5) and len(act.skipped) == 2
    # the same file again is another source
    again = load(session, "text", str(logs / "a.log"), FMT, RULES)
    assert list(again.inserted.values()) == [1] and session.timeline().count("pump 4 broke") == 1 + 1
    assert len(session.loaded_sources()) == 3
    pruned = session.stored_entries().where("event_id_source = 'b'")
    assert pruned.count() == 2 and "PartitionFilters: [isnotnull(event_id_source" in pruned._jdf.queryExecution().executedPlan().toString()


def test_retag(session, logs):
    load(session, "text", str(logs), FMT, RULES)
    assert session.retag([RULES[0]]) == {"broke": 2} and session.import_tags().count() == 2
    assert session.retag([]) == {} and session.import_tags().count() == 0
    assert [r.operation for r in session.activity().collect()] == ["retag", "retag", "load"]


def test_loads_that_cannot_begin(session, logs, tmp_path):
    (tmp_path / "none").mkdir()
    for args in (("text", str(logs)), ("evtx", str(tmp_path / "none")), ("odd", str(logs / "a.log"))):
        with pytest.raises(LoadError):
            load(session, *args)
    with pytest.raises(LoadError):
        load(session, "text", str(logs), TextFormat("x", "x", "(", "%s"))
    assert {r.status for r in session.activity().collect()} == {"failed"} and session.entries().count() == 0


def test_zone_of_the_session(session, tmp_path):
    p = tmp_path / "g.log"
    p.write_text("2025-06-17 12:00:00 x\n")
    load(session, "text", str(p), packs.text_formats()["generic_timestamp"], zone="Europe/Berlin")
    assert session.entries().first().timestamp_utc == datetime(2025, 6, 17, 10)


def test_stored_virtual_columns_equal_the_definition(session, tmp_path):
    p = tmp_path / "e.evtx"
    p.write_text(json.dumps({"event_record_id": 1, "timestamp": "2026-01-01T10:00:00Z", "Event": {"System": {"Computer": "W", "EventID": 4624}}}) + "\n")
    load(session, "evtx", str(p), rules=packs.rules("evtx"))
    r = session.stored_entries().first()
    assert (r.host, r.event_code, r.process, r.sourcetype) == ("W", "4624", None, "evtx")
    assert session.timeline().count("event_id=4624 host=W tag=logon_success") == 1


def test_analyst_state(session):
    assert session.analyst_tags().count() == 0 and session.state() == {} and session.search_query == ""
    session.add_tag("s", 1, "seen", now=10)
    session.add_tag("s", 1, "again", "why", now=5)
    assert [r.tag_value for r in session.tags_of("s", 1).collect()] == ["again", "seen"]
    a, b = session.add_note("s", 1, "first", now=1), session.add_note("s", 1, "second", now=1)
    assert session.update_note(a, "changed") and [r.note for r in session.notes().collect()] == ["changed", "second"]
    assert session.delete_note(a) and not session.delete_note(a) and not session.update_note(99, "x")
    assert [(r.id, r.note) for r in session.notes().collect()] == [(b, "second")]
    session.search_query = "level=x"
    session.search_query = "level=y"
    session.display_name = "case"
    assert session.search_query == "level=y" and session.display_name == "case"


def test_merged_tags_and_export(spark, session, logs, tmp_path):
    load(session, "text", str(logs), FMT, RULES, ids=["a", "b", "c", "e"])
    session.add_tag("a", 0, "bad")
    session.add_tag("a", 0, "zeta")
    session.add_note("a", 0, "n1")
    session.add_note("a", 0, "n2")
    t = session.timeline()
    rows = export_rows(t, "broke", Zone.parse("+02:00")).collect()
    assert [(r.timestamp, r.tags, r.notes) for r in rows] == [("2025-06-17 12:00:00.000 +02:00", "app;bad;zeta", "n1 | n2"), ("2025-06-17 12:00:02.000 +02:00", "app;bad", "")]
    assert export_file(t, "", tmp_path / "x.csv") == 3
    with open(tmp_path / "x.csv", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == COLUMNS and got[2][-1] == 'fine, "quoted"'
    assert export_file(t, "level=ERROR", tmp_path / "x.JSON") == 1
    (one,) = json.loads((tmp_path / "x.JSON").read_text())
    assert list(one) == COLUMNS and one["message"] == "pump 4 broke"
    assert export_file(t, "level=none", tmp_path / "none.json") == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    assert (tmp_path / "none.json").read_text() == "[\n\n]\n" and not list(tmp_path.glob("*.parts-*"))
    export_folder(t, "", f"{tmp_path}/folder")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/folder")
    assert back.columns == COLUMNS and {r.message for r in back.collect()} == {"pump 4 broke", 'fine, "quoted"', "broke again"}
    with pytest.raises(ValueError):
        export_file(t, "message~(", tmp_path / "y.csv")
    assert {r.tag_value for r in t.tag_vocabulary().collect()} == {"app", "bad", "zeta"}


def test_quality_reports(spark):
    rows = [("2026-01-01 01:00:00", None), ("2026-01-01 02:00:00", ""), ("2026-01-01 03:00:00", "Failed to get x"), ("2026-01-02 01:00:00", "fine")]
    df = spark.createDataFrame(rows, "t string, message string").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS timestamp_utc", "message", "'L' AS level", "'' AS fields")
    q = message_quality(df).first()
    assert (q.total, q.empty_message, q.failed_marker, q.any_unresolved) == (4, 2, 1, 3)
    assert [(r.day, r.total, r.unresolved) for r in resolution_by_day(df).collect()] == [(datetime(2026, 1, 1), 3, 3), (datetime(2026, 1, 2), 1, 0)]
    assert sample_rows(df, 3).count() == 3


def test_labels(spark):
    rows = [("6", "journald", "/a/b.journal", "6 (info)", "b.journal"), ("9", "journald", "/x", "9", "x"), ("2", "evtx", "/a/S.evtx", "2 (Error)", "S.evtx"), ("2", "aul", "/a/db", "2", "/a/db"), (None, "evtx", "plain", None, "plain")]
    df = spark.createDataFrame(rows, "level string, sourcetype string, path string, l string, p string")
    for r in df.select(level_label(df.level, df.sourcetype).alias("a"), "l", source_label(df.path, df.sourcetype).alias("b"), "p").collect():
        assert (r.a, r.b) == (r.l, r.p)
    assert color_slot("") == 0xCBF29CE484222325 % 8 and color_slot("a") == 0xAF63DC4C8601EC8C % 8


def test_sessions_on_disk(spark, tmp_path, logs):
    for n in ("session-20260101-000000", "session-20270101-000000", "other"):
        (tmp_path / n).mkdir()
    assert list_sessions(spark, tmp_path) == ["session-20270101-000000", "session-20260101-000000"] and list_sessions(spark, tmp_path / "none") == []
    full = Session(spark, str(tmp_path / "session-20260101-000000"))
    assert full.is_empty() and full.byte_size() == 0
    load(full, "text", str(logs / "a.log"), FMT)
    assert not full.is_empty() and full.byte_size() > 0
    assert [tuple(r) for r in session_counts(spark, tmp_path).collect()] == [("session-20270101-000000", 0), ("session-20260101-000000", 1)]
    assert sweep(spark, tmp_path, keep="session-20270101-000000") == [] and sweep(spark, tmp_path) == ["session-20270101-000000"]
    assert list_sessions(spark, tmp_path) == ["session-20260101-000000"] and not delete_if_empty(full)
    full.delete()
    assert list_sessions(spark, tmp_path) == [] and session_counts(spark, tmp_path).count() == 0 and (tmp_path / "other").is_dir()
    assert epoch_text(0) == "1970-01-01 00:00:00" and epoch_text(None) == ""
    assert new_session_id(datetime(2026, 1, 2, 3, 4, 5)) == "session-20260102-030405"
    assert [size_text(n) for n in (999, 1500, 2_500_000)] == ["999 B", "1.5 KB", "2.5 MB"]


def test_stream(spark, session, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = lambda n, m: json.dumps({"timestamp_utc": f"2026-01-01T00:0{n}:00", "level": "I", "message": m, "raw": m, "fields": "{}", "seq": n}) + "\n"
    (folder / "1.json").write_text(record(0, "pump 4 broke") + record(1, "fine"))
    watch(session, str(folder), "app", RULES, f"{tmp_path}/cp", "live").awaitTermination()
    (folder / "2.json").write_text(record(2, "broke again"))
    watch(session, str(folder), "app", RULES, f"{tmp_path}/cp", "live").awaitTermination()
    t: Timeline = session.timeline()
    assert t.entries.count() == 3 and t.count("tag=bad") == 2 and t.sources.count() == 1
    stream = spark.readStream.schema("timestamp_utc timestamp_ntz, level string").json(str(folder))
    q = live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("live_counts").collect()) == 3


def test_batch_that_is_run_again_doubles_nothing(session, tmp_path, monkeypatch):
    """The first run stops after its entries, or after its tags, are stored."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("".join(json.dumps({"timestamp_utc": "2026-01-01T00:00:00", "level": "I", "message": "pump 4 broke", "raw": "r", "fields": "{}", "seq": n}) + "\n" for n in range(3)))
    for step in ("write_entries", "write_tags", "commit"):
        real = getattr(Session, step)

        def fails(self, *args, real=real, **more):
            if real.__name__ != "commit":
                real(self, *args, **more)
            raise OSError("stopped")

        monkeypatch.setattr(Session, step, fails)
        with pytest.raises(Exception, match="stopped"):
            watch(session, str(folder), "app", RULES, f"{tmp_path}/cp", "live").awaitTermination()
        monkeypatch.setattr(Session, step, real)
        assert session.entries().count() == 0 and session.import_tags().count() == 0
    watch(session, str(folder), "app", RULES, f"{tmp_path}/cp", "live").awaitTermination()
    assert session.entries().count() == 3 and session.import_tags().count() == 6


def test_one_file_from_many_parts_has_the_bytes_of_one_writer(spark, tmp_path):
    """Quotes, commas, line breaks and other characters, in rows of several partitions."""
    r = random.Random(2)
    odd = ['"', ",", "\n", "\r", "é", "日本", "🙂", "\\", "/", "\t", " ", "x", ""]
    rows = [("s", n, datetime(2026, 1, 1) + timedelta(seconds=n), "I", "".join(r.choice(odd) for _ in range(5)), "r", "{}") for n in range(300)]
    t = Timeline(spark.createDataFrame(rows, LOG_ENTRIES).repartition(6), spark.createDataFrame([("s", "/a,b", "app", None, None)], SOURCES), spark.createDataFrame([], IMPORT_TAGS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert export_file(t, "", tmp_path / "x.csv") == export_file(t, "", f"{tmp_path}/x.json") == 300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [tuple(x) for x in export_rows(t, "").collect()]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerows([COLUMNS, *want])
    assert (tmp_path / "x.csv").read_bytes() == text.getvalue().encode()
    body = ",\n".join(json.dumps(dict(zip(COLUMNS, w)), ensure_ascii=False, separators=(",", ":")) for w in want)
    assert (tmp_path / "x.json").read_bytes() == f"[\n{body}\n]\n".encode()


def test_tag_preview(session, logs):
    load(session, "text", str(logs), FMT, RULES)
    t = session.timeline()
    assert t.tag_preview(None, "broke") == 2 and t.tag_preview("level", "INFO") == 2 and t.tag_preview("host", "x y") == 0
    session.add_tag("s", 1, "z")
    session.add_tag("s", 1, "a")
    assert [r.tag_value for r in session.timeline().distinct_analyst_tags().collect()] == ["a", "z"]


def test_format_is_saved(tmp_path):
    p = FMT.save(tmp_path / "formats")
    assert p.name == "iso.toml" and TextFormat.from_toml(p.read_text()) == FMT


def test_progress_and_cancel(session, logs):
    """After the first group the load is cancelled; what it stored stays."""
    seen, groups = [], lambda: [p for p in seen if p.running is None]
    got = load(session, "text", str(logs), FMT, RULES, group=2, progress=seen.append, cancelled=lambda: bool(groups()))
    assert [(p.files, p.total_files) for p in groups()] == [(2, 4)] and 0 < groups()[0].bytes < groups()[0].total_bytes
    assert len(got.inserted) == 2 and session.entries().count() == 3 and session.activity().first().status == "cancelled"
    assert {p.running.step for p in seen if p.running} == {"reading", "storing", "tagging", "indexing"}


def _slow_log(tmp_path):
    """One file of many blocks."""
    path = tmp_path / "big.log"
    with path.open("w") as f:
        for k in range(60_000):
            f.write(f"2026-01-01 00:00:00 a line of a file that is read in many blocks, number {k}\n")
    return path


def test_rows_grow_within_one_file_and_a_running_job_ends(spark, session, logs, tmp_path):
    load(session, "text", str(logs), FMT, RULES)
    before, seen = session.entries().count(), []
    fmt = packs.text_formats()["generic_timestamp"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        path = str(_slow_log(tmp_path))
        load(session, "text", path, fmt, zone="UTC", progress=seen.append)
        reading = [p.running for p in seen if p.running and p.running.step == "reading"]
        assert all(p.total_files == 1 for p in seen) and len({d.rows_written for d in reading}) > 2 and [d.tasks for d in reading] == sorted(d.tasks for d in reading)
        assert max(d.rows_written for d in reading) >= 60_000 and max(d.bytes_read for d in reading) >= 60_000 * 50
        # the second time it is cancelled while its first jobs run
        started = []
        got = load(session, "text", path, fmt, zone="UTC", progress=lambda p: started.append(p), cancelled=lambda: any(p.running and p.running.tasks for p in started))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.inserted == {} and session.activity().first().status == "cancelled"
    last = started[-1].running
    assert last.step == "reading" and last.tasks < 60_000
    assert session.entries().count() == before + 60_000 and session.vacuum() == []
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_settings(tmp_path):
    path = tmp_path / "x" / "tidemark.toml"
    assert Settings.read(path) == Settings()
    Settings(rules_dir='r "1"', display_timezone="Europe/Berlin").write(path)
    assert Settings.read(path) == Settings(rules_dir='r "1"', display_timezone="Europe/Berlin")
    for bad in ({"display_timezone": "Nowhere"}, {"load_group": 0}):
        with pytest.raises(ValueError):
            Settings(**bad).validate()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.log").write_text("2025-06-17 12:00:00 x\n")
    Settings(sessions_dir=str(tmp_path / "s"), default_source_timezone="UTC").write(tmp_path / "t.toml")
    main(["--settings", str(tmp_path / "t.toml"), "--add-source", "generic_timestamp", str(tmp_path / "g.log"), "--cleanup-dir", "/usr/none"], spark)
    (name,) = list_sessions(spark, tmp_path / "s")
    assert Session(spark, f"{tmp_path}/s/{name}").entries().count() == 1
    main(["--settings", str(tmp_path / "t.toml"), "--ephemeral-session", "--add-source", "generic_timestamp", str(tmp_path / "g.log"), "--search", "x"], spark)
    own = tmp_path / "rules"
    own.mkdir()
    (own / "mine.toml").write_text('[rule]\nname = "mine"\n[rule.match]\nmessage_contains = "x"\n[rule.tag]\nvalue = "my"\n')
    Settings(sessions_dir=str(tmp_path / "r"), rules_dir=str(own), default_source_timezone="UTC").write(tmp_path / "u.toml")
    main(["--settings", str(tmp_path / "u.toml"), "--add-source", "generic_timestamp", str(tmp_path / "g.log")], spark)
    (name,) = list_sessions(spark, tmp_path / "r")
    assert [x.rule_name for x in Session(spark, f"{tmp_path}/r/{name}").import_tags().collect()] == ["mine"]
    assert "1 entries, 0 files skipped" in capsys.readouterr().out and len(list_sessions(spark, tmp_path / "s")) == 1
    assert not cleanup("/usr/lib") and not cleanup(tempfile.gettempdir())
