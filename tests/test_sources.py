"""Readers: time zones and formats, text logs, journal files, JSON records, discovery."""

import json
import struct
from datetime import datetime

import pyarrow as pa
import pytest

from tidemark import packs
from tidemark.functions.timezones import BadTime, TimeFormat, Zone
from tidemark.sources.columns import java_pattern
from tidemark.sources.discovery import aul_layout, byte_size, kind_of, source_files
from tidemark.sources.formats import BadFormat, TextFormat, saved_formats
from tidemark.sources.journald import BadJournal, Journal, read_journals
from tidemark.plans.scratch import Scratch
from tidemark.sources.records import RENDERED, filled, read_aul_records, read_evtx_records
from tidemark.sources.text import lines_of, parse_records, parsed_by_columns, preview, read_text, records_of


@pytest.mark.parametrize("text, want", [("UTC", "+00:00"), ("z", "+00:00"), ("+02:00", "+02:00"), ("-0530", "-05:30"), (" Europe/Berlin ", "Europe/Berlin")])
def test_zone(text, want):
    assert Zone.parse(text).spark_name() == want


@pytest.mark.parametrize("text", ["", "2:00", "+2", "+25:00x", "Nowhere/Land", "+99:00"])
def test_bad_zone(text):
    with pytest.raises(BadTime):
        Zone.parse(text)


def test_local_times_must_be_single():
    berlin = Zone.parse("Europe/Berlin")
    assert berlin.to_utc(datetime(2026, 7, 1, 12)) == datetime(2026, 7, 1, 10) and berlin.to_utc(datetime(2026, 1, 1, 12)) == datetime(2026, 1, 1, 11)
    for gap_or_fold in (datetime(2026, 3, 29, 2, 30), datetime(2026, 10, 25, 2, 30)):
        with pytest.raises(BadTime):
            berlin.to_utc(gap_or_fold)
    howe = Zone.parse("Australia/Lord_Howe")  # shifts by half an hour
    with pytest.raises(BadTime):
        howe.to_utc(datetime(2026, 10, 4, 2, 15))
    assert howe.to_utc(datetime(2026, 10, 4, 2, 45)) == datetime(2026, 10, 3, 15, 45)


@pytest.mark.parametrize(
    "fmt, text, zone, year, want",
    [
        ("%Y-%m-%dT%H:%M:%S%z", "2025-06-17T12:00:00+0200", None, None, datetime(2025, 6, 17, 10)),
        ("%Y-%m-%dT%H:%M:%S%z", "2025-06-17T12:00:00+0200", "-05:00", None, datetime(2025, 6, 17, 10)),
        ("%Y-%m-%d %H:%M:%S%.f", "2025-06-17 12:00:00.1234567", "UTC", None, datetime(2025, 6, 17, 12, 0, 0, 123456)),
        ("%Y-%m-%d %H:%M:%S%.f", "2025-06-17 12:00:00", "UTC", 1999, datetime(2025, 6, 17, 12)),
        ("%b %e %H:%M:%S", "Jul  8 12:00:00", "UTC", 2026, datetime(2026, 7, 8, 12)),
        ("%m-%d %H:%M:%S%.f", "06-17 12:00:00.5", "UTC", 2025, datetime(2025, 6, 17, 12, 0, 0, 500000)),
        ("%d/%b/%Y %I:%M:%S %p", "17/Jun/2025 12:05:00 AM", "UTC", None, datetime(2025, 6, 17, 0, 5)),
        ("%Y-%j %H:%M", "2026-032 01:02", "UTC", None, datetime(2026, 2, 1, 1, 2)),
        ("%s", "86400", None, 2026, datetime(1970, 1, 2)),
    ],
)
def test_time_formats(fmt, text, zone, year, want):
    assert TimeFormat(fmt).parse(text, Zone.parse(zone) if zone else None, year) == want


@pytest.mark.parametrize("fmt, text, zone, year", [("%H:%M", "12:00", "UTC", 2026), ("%b %e %H:%M:%S", "Jul 8 12:00:00", "UTC", None), ("%Y-%m-%d %H:%M:%S", "2025-06-17 12:00:00", None, None), ("%Y-%m-%d %H:%M:%S", "x", "UTC", None), ("%Y-%m-%d %H:%M:%S", "2026-02-30 12:00:00", "UTC", None)])
def test_times_without_meaning(fmt, text, zone, year):
    with pytest.raises(BadTime):
        TimeFormat(fmt).parse(text, Zone.parse(zone) if zone else None, year)


def test_unknown_specifiers_are_errors():
    for bad in ("%Q", "%", "%Y %"):
        with pytest.raises(BadTime):
            TimeFormat(bad)


ISO = TextFormat("iso", "app", r"^(?P<timestamp>\S+) (?P<level>[A-Z]+) (?P<message>.*?)(?: \[(?P<extra>\w+)\])?$", "%Y-%m-%dT%H:%M:%S%z", mapping={"level": "level", "message": "message"})


def _read(spark, files, fmt):
    rows = read_text(spark, [(f"s{k}", str(p)) for k, p in enumerate(files)], fmt).collect()
    return sorted(rows, key=lambda r: (r.event_id_source, r.event_id_seq))


def test_single_line_log(spark, tmp_path):
    p = tmp_path / "a b.log"
    p.write_bytes("2025-06-17T12:00:00+0200 ERROR it broke é\r\n2025-06-17T12:00:01+0200 INFO fine [x1]\n".encode())
    a, b = _read(spark, [p], ISO)
    assert (a.event_id_seq, a.timestamp_utc, a.level, a.message, a.error) == (0, datetime(2025, 6, 17, 10), "ERROR", "it broke é", None)
    assert json.loads(a.fields) == {"timestamp": "2025-06-17T12:00:00+0200", "level": "ERROR", "message": "it broke é", "extra": None}
    assert json.loads(b.fields)["extra"] == "x1" and a.raw.endswith("é") and b.event_id_seq == 1


def test_multiline_log(spark, tmp_path):
    p = tmp_path / "m.log"
    p.write_text("2025-06-17 12:00:00.5 first\n  more\n\nlast\n2025-06-17 12:00:01 second\n")
    fmt = packs.text_formats()["generic_timestamp"]
    a, b = _read(spark, [p], fmt.with_assumptions("+02:00"))
    assert a.raw == "2025-06-17 12:00:00.5 first\n  more\n\nlast" and a.message == "first\n  more\n\nlast" and a.timestamp_utc == datetime(2025, 6, 17, 10, 0, 0, 500000)
    assert (b.event_id_seq, b.message) == (1, "second")
    assert all(r.error for r in _read(spark, [p], fmt))  # no zone
    p.write_text("no start\n2025-06-17 12:00:00 x\n")
    a, b = _read(spark, [p], fmt.with_assumptions("UTC"))
    assert "line 1" in a.error and b.error is None


def test_many_blocks_keep_their_order(spark, tmp_path):
    p = tmp_path / "big.log"
    p.write_text("".join(f"2025-06-17 12:00:00 n{k}\n\tdetail {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = _read(spark, [p], packs.text_formats()["generic_timestamp"].with_assumptions("UTC"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.message for r in rows] == [f"n{k}\n\tdetail {k}" for k in range(5000)] and [r.event_id_seq for r in rows] == list(range(5000))


@pytest.mark.parametrize(
    "key, line, level, message",
    [("syslog_rfc3164", "Jul  8 12:00:00 box sshd[12]: hello there", None, "hello there"), ("logcat_brief", "06-17 12:00:00.123  100  200 E tag: oh no", "E", "oh no"), ("pacman_log", "[2025-06-17T12:00:00+0200] [ALPM] upgraded x", None, "upgraded x")],
)
def test_built_in_formats(spark, tmp_path, key, line, level, message):
    p = tmp_path / "x.log"
    p.write_text(line + "\n")
    (r,) = _read(spark, [p], packs.text_formats()[key].with_assumptions("UTC", 2026))
    assert (r.level, r.message, r.error) == (level, message, None)


def test_bytes_that_are_no_utf8_are_an_error(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"2025-06-17T12:00:00+0200 ERROR \xff\xfe\n")
    assert "UTF-8" in _read(spark, [p], ISO)[0].error


def test_formats(tmp_path):
    for change in ({"pattern": "("}, {"pattern": "^(?P<message>.*)$"}, {"mapping": {"host": "message"}}, {"mapping": {"level": "none"}}, {"assume_offset": "x"}, {"timestamp_format": "%Q"}, {"multiline_start": "["}):
        with pytest.raises(BadFormat):
            TextFormat(**{**ISO.__dict__, **change}).validate()
    full = TextFormat("n \"q\"", "s", r"^(?P<timestamp>\d+)$", "%s", "^x", "+02:00", 2026, {"message": "timestamp"})
    assert TextFormat.from_toml(full.to_toml()) == full and TextFormat.from_toml(ISO.to_toml()) == ISO
    (tmp_path / "b.toml").write_text(ISO.to_toml())
    (tmp_path / "a.toml").write_text("[")
    assert [n for n, _ in saved_formats(tmp_path)] == ["iso"] and saved_formats(tmp_path / "none") == []
    shown = preview(["2025-06-17T12:00:00+0200 ERROR a", "bad"], ISO)
    assert shown[0][1:] == ("a", None) and shown[1][1] is None and "line 2" in shown[1][2]


def _journal(entries, compact=False, flags=0, lz4=(), other=(), cut=0):
    """Bytes of a journal file with one data object for each field."""
    header = bytearray(208)
    header[:8] = b"LPKSHHRH"
    struct.pack_into("<I", header, 12, flags | (16 if compact else 0))
    struct.pack_into("<Q", header, 88, 208)
    body, tail = bytearray(), 0

    def add(kind, flag, payload):
        at = 208 + len(body)
        size = 16 + len(payload)
        body.extend(struct.pack("<BB6xQ", kind, flag, size) + payload + bytes(-size % 8))
        return at

    for n, (realtime, fields) in enumerate(entries):
        items = b""
        for k, v in fields.items():
            raw, flag = f"{k}={v}".encode() if isinstance(v, str) else k.encode() + b"=" + v, 0
            if k in lz4:
                raw, flag = struct.pack("<Q", len(raw)) + pa.compress(raw, codec="lz4_raw", asbytes=True), 2
            if k in other:
                flag = 4
            at = add(1, flag, bytes(56 if compact else 48) + raw)
            items += struct.pack("<I", at) if compact else struct.pack("<QQ", at, 0)
        tail = add(3, 0, struct.pack("<QQQ", n + 1, realtime, 7) + bytes(24) + items)
    struct.pack_into("<Q", header, 136, tail)
    data = bytes(header + body)
    return data[: len(data) - cut]


ENTRIES = [(1_750_000_000_123_456, {"MESSAGE": "hello", "PRIORITY": "6", "_COMM": "x"}), (1_750_000_001_000_000, {"MESSAGE": "long " * 50, "BIN": b"\xff"})]


@pytest.mark.parametrize("compact", [False, True])
def test_journal_entries(compact):
    a, b = Journal(_journal(ENTRIES, compact, lz4=("MESSAGE",), other=("BIN",))).entries()
    assert a == {"MESSAGE": "hello", "PRIORITY": "6", "_COMM": "x", "__REALTIME_TIMESTAMP": "1750000000123456", "__MONOTONIC_TIMESTAMP": "7", "__SEQNUM": "1"}
    assert b["MESSAGE"] == "long " * 50 and any(k.startswith("_UNSUPPORTED_COMPRESSED_FIELD@") and "ZSTD" in v for k, v in b.items())
    assert next(iter(Journal(_journal([(1, {"B": b"\xff"})])).entries()))["B"] == "�"
    assert list(Journal(_journal([])).entries()) == []


@pytest.mark.parametrize("data", [b"short", b"X" * 300, _journal(ENTRIES, flags=1 << 7), _journal(ENTRIES, cut=20)])
def test_bad_journals(data):
    with pytest.raises(BadJournal):
        list(Journal(data).entries())


def test_journal_rows(spark, tmp_path):
    (tmp_path / "a.journal").write_bytes(_journal(ENTRIES))
    (tmp_path / "b.journal").write_bytes(b"junk")
    rows = sorted(read_journals(spark, [("a", f"{tmp_path}/a.journal"), ("b", f"{tmp_path}/b.journal")]).collect(), key=lambda r: (r.event_id_source, r.event_id_seq))
    assert [(r.event_id_source, r.event_id_seq, r.level, r.error is None) for r in rows] == [("a", 0, "6", True), ("a", 1, None, True), ("b", 0, None, False)]
    assert rows[0].timestamp_utc == datetime(2025, 6, 15, 15, 6, 40, 123456) and rows[0].raw == rows[0].fields


def test_evtx_records(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    system = {"Computer": "W", "EventID": 4634, "Level": 2, "Provider_attributes": {"Name": "Microsoft-Windows-Security-Auditing"}}
    data = {"TargetUserName": "bob", "LogonType": 3}
    rows = [
        {"event_record_id": 1, "timestamp": "2026-01-01T10:00:00.5Z", "Event": {"System": system, "EventData": data}},
        {"event_record_id": 2, "timestamp": "2026-01-01T12:00:00+02:00", "Event": {"System": system, "RenderingInfo": {"Message": "given"}}},
        {"event_record_id": 3, "Event": {"System": {"EventID": 1, "TimeCreated_attributes": {"SystemTime": "2026-01-01T10:00:00Z"}}}},
    ]
    p.write_text("".join(json.dumps(r) + "\n" for r in rows) + "no json\n" + '{"event_record_id": 4}\n')
    a, b, c, d, e = sorted(read_evtx_records(spark, [("s", str(p))], packs.templates()).collect(), key=lambda r: r.event_id_seq)
    assert (a.timestamp_utc, a.level) == (datetime(2026, 1, 1, 10, 0, 0, 500000), "2")
    assert a.message == RENDERED + "An account was logged off. Account: bob (domain {TargetDomainName}), logon type {LogonType}"
    assert b.message == "given" and b.timestamp_utc == datetime(2026, 1, 1, 10) and c.message is None and c.level is None
    assert json.loads(a.fields) == {"event_record_id": 1, "Event": rows[0]["Event"]} and d.error and e.error
    one = spark.sql("""SELECT parse_json('{"Event":{"EventData":{"A":"x","B":1}}}') AS _v""")
    assert one.select(filled("{A} {B} {a b} {C}").alias("m")).first().m == "x {B} {a b} {C}"
    assert "Python" not in read_evtx_records(spark, [("s", str(p))], packs.templates())._jdf.queryExecution().executedPlan().toString()


def test_aul_records_are_ordered(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    rows = [(2e18, "b", "late"), (1.5e18, "z", "second"), (1.5e18, "a", "first")]
    p.write_text("".join(json.dumps({"time": t, "evidence": e, "message": m, "log_type": "Default", "process": "/p"}) + "\n" for t, e, m in rows))
    found = sorted(read_aul_records(spark, [("s", str(p))]).collect(), key=lambda r: r.event_id_seq)
    assert [(r.event_id_seq, r.message) for r in found] == [(0, "first"), (1, "second"), (2, "late")]
    assert found[0].timestamp_utc == datetime(2017, 7, 14, 2, 40) and found[0].level == "Default"


def test_discovery(spark, tmp_path):
    for name in ("b/x.EVTX", "b/c/y.evtx", "z.journal", "t.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("123")
    assert [f[len(str(tmp_path)) :] for f in source_files(spark, "evtx", str(tmp_path))] == ["/b/c/y.evtx", "/b/x.EVTX"]
    assert len(source_files(spark, "text", str(tmp_path))) == 4 and source_files(spark, "aul", str(tmp_path)) == [str(tmp_path)]
    assert [kind_of(spark, str(tmp_path / n)) for n in ("b", "b/x.EVTX", "z.journal", "t.log")] == ["aul", "evtx", "journald", "text"]
    assert byte_size(spark, str(tmp_path / "t.log")) == 3 and byte_size(spark, str(tmp_path)) == 0


def test_aul_layouts(tmp_path):
    raw = tmp_path / "x" / "Diagnostics"
    for n in ("Persist", "timesync"):
        (raw / n).mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        aul_layout(raw)
    (tmp_path / "x" / "uuidtext").mkdir()
    assert aul_layout(raw) == aul_layout(tmp_path / "x") and aul_layout(raw).strings.name == "uuidtext"
    (raw / "0A").mkdir()
    assert aul_layout(raw).strings is None and aul_layout(tmp_path).diagnostics == tmp_path


def test_instants_in_a_clock_change(spark, tmp_path):
    """Both hours that a zone shows twice stay apart, whatever the session's zone is."""
    stamps = ["2026-10-25T00:30:00Z", "2026-10-25T01:30:00Z", "2026-10-25T02:30:00+01:00", "2026-03-29T01:30:00Z"]
    (tmp_path / "e").write_text("".join(json.dumps({"event_record_id": k, "timestamp": t, "Event": {"System": {}}}) + "\n" for k, t in enumerate(stamps)))
    nanos = [1792888200_000000000, 1792891800_000000000]
    (tmp_path / "a").write_text("".join(json.dumps({"time": t, "log_type": "Info", "message": "m"}) + "\n" for t in nanos))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        evtx = [r.timestamp_utc for r in read_evtx_records(spark, [("s", str(tmp_path / "e"))], {}).orderBy("event_id_seq").collect()]
        aul = [r.timestamp_utc for r in read_aul_records(spark, [("s", str(tmp_path / "a"))]).orderBy("event_id_seq").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert evtx == [datetime(2026, 10, 25, 0, 30), datetime(2026, 10, 25, 1, 30), datetime(2026, 10, 25, 1, 30), datetime(2026, 3, 29, 1, 30)]
    assert aul == [datetime(2026, 10, 25, 0, 30), datetime(2026, 10, 25, 1, 30)]


def test_builtin_formats_need_no_python(spark, tmp_path):
    """Columns and the parser of records give equal rows; the plans have no Python and no window over a file."""
    logs = {
        "generic_timestamp": ["2024-03-01 10:00:00.25 first", "  more\tof it", "2024-03-01 10:00:01 with \u00a0 \"quotes\" \\ and é", "2024-03-31 02:30:00 skipped", "2024-10-27 02:30:00 twice", "2024-02-30 10:00:00 no such day"],
        "logcat_brief": ["03-01 10:00:00.123  12  34 E Tag: text: more", "03-01 10:00:00.1 1 2 I T:", "no match"],
        "pacman_log": ["[2024-03-01T10:00:00+0530] [ALPM] installed x", "[2024-03-01T10:00:00Z] [ALPM] y", "[2024-03-01T10:00:00+9900] [ALPM] z", "[yesterday] [ALPM] z"],
        "syslog_rfc3164": ["Mar  1 10:00:60 node sshd[12]: leap", "Feb 29 10:00:00 n k: no pid", "Mar 31 23:59:59 n x y: z", "Mrz  1 10:00:00 n k: m"],
    }
    for name, lines in logs.items():
        p = tmp_path / name
        p.write_text("\n".join(lines) + "\n")
        fmt = packs.text_formats()[name].with_assumptions("Europe/Berlin", 2024)
        keep = Scratch(spark).keep
        records = records_of(keep(lines_of(spark, [("s", str(p))])), fmt, keep)
        fast, slow = parsed_by_columns(records, fmt), parse_records(records, fmt)
        key = lambda r: (r.event_id_seq, r.timestamp_utc, r.level, r.message, r.raw, r.fields and json.loads(r.fields), r.error is not None)
        assert list(map(key, fast.orderBy("event_id_seq").collect())) == list(map(key, slow.orderBy("event_id_seq").collect())), name
        plan = fast._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert not any("Window" in x and "row_number" in x for x in plan.splitlines())


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """A file of many blocks, with records that cross their borders."""
    n = 3000
    (tmp_path / "x.log").write_text("".join(f"2024-03-01 10:00:00 record {k}\n" + "  more\n" * (k % 4) for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_text(spark, [("s", str(tmp_path / "x.log"))], packs.text_formats()["generic_timestamp"].with_assumptions("UTC")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.event_id_seq, r.message) for r in rows) == [(k, f"record {k}" + "\n  more" * (k % 4)) for k in range(n)]


@pytest.mark.parametrize("pattern", ["(a|b)", "(?P<timestamp>x)?", "(?:(?P<timestamp>x))*", "(?=x)y", "[a&&b]", "[[:digit:]]", r"\bx", "(?i)x", "a++", r"(?P<a>x)\1"])
def test_patterns_that_need_the_parser(pattern):
    assert java_pattern(pattern) is None


def test_a_folder_of_part_files_is_one_log(spark, tmp_path):
    """Lines are numbered over all parts, and a record may begin in one part and end in the next; single part files stay logs of their own."""
    for k, text in ((0, "1 a\n  b\n"), (1, "  c\n2 d\n"), (100_000, "  z\n"), (2, "  e\n")):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"part-{k:05d}-x.c000.txt").write_text(text)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "part-00000-x.c000.txt").write_text("1 a\n")
    found = source_files(spark, "text", str(tmp_path), ".txt")
    assert [f[len(str(tmp_path)) :] for f in found] == ["/many", "/one/part-00000-x.c000.txt"]
    assert byte_size(spark, found[0]) == 24
    fmt = TextFormat("t", "t", r"^(?P<timestamp>\d)(?P<message>.*)$", "%s", multiline_start=r"^\d")
    rows = records_of(Scratch(spark).keep(lines_of(spark, [("s", found[0]), ("t", found[1])])), fmt, Scratch(spark).keep).collect()
    assert sorted((r.event_id_source, r.event_id_seq, r.line, r.raw) for r in rows) == [("s", 0, 1, "1 a\n  b\n  c"), ("s", 1, 4, "2 d\n  e\n  z"), ("t", 0, 1, "1 a")]
