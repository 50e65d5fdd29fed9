"""Rankings by place against sorted results, and the plans of text loads."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import packs
from tidemark.model import LOG_ENTRIES
from tidemark.operators.timeline import ORDER
from tidemark.plans import ranking as R
from tidemark.plans.scratch import Scratch, scratch, shared_dir
from tidemark.plans.session import Session
from tidemark.sources.records import read_aul_records
from tidemark.sources.text import read_text

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    """3,000 entries of three sources, many with equal times."""
    s = Session(spark, str(tmp_path_factory.mktemp("s") / "s"))
    for k in range(3):
        rows = [(f"s{k}", n, START + timedelta(seconds=(n * 7 + k) // 5 * 5), "I", f"line {n % 10}", "r", "{}") for n in range(1000)]
        s.append_entries(spark.createDataFrame(rows, LOG_ENTRIES), "app")
        s.append("sources", [(f"s{k}", f"/p/{k}", "app", None, None)])
    return s


@pytest.mark.parametrize("text", ["", "line source_id!=s1", '"line 3"', "nothing"])
def test_pages_and_places_equal_the_sorted_result(session, text, monkeypatch):
    r, t = session.ranking(text, ranges=7), session.timeline()
    want = [tuple(x) for x in t.search(text).select(*ORDER).orderBy(*ORDER).collect()]
    assert r.total == len(want) and len(r.ranges) <= 7
    for offset, limit in [(0, 5), (1, 700), (r.total // 2, 200), (max(0, r.total - 3), 10), (r.total + 5, 3)]:
        assert sorted(tuple(x) for x in r.keys(offset, limit).collect()) == want[offset : offset + limit]
    page = lambda rows: [(x.event_id_source, x.event_id_seq, x.message, x.source) for x in rows.collect()]
    assert page(r.window(37, 40)) == page(t.window(text, 37, 40))
    monkeypatch.setattr(R, "FILTERED_ROWS", 10)
    assert page(r.window(37, 40)) == page(t.window(text, 37, 40))
    for seconds in (-5, 0, 3, 1001, 3500, 6995, 99999):
        at = START + timedelta(seconds=seconds)
        assert r.place_at(at) == sum(w[0] < at for w in want)


def test_a_deep_page_reads_its_own_files_only(spark, session):
    r = session.ranking(ranges=7)
    assert r.keys(1500, 50).inputFiles() and len(r.keys(1500, 50).inputFiles()) <= 2 < len({x.file for x in r.ranges})
    spark.conf.set("spark.sql.maxMetadataStringLength", "9000")
    plan = r.window(1500, 3)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(event_id_seq" in plan
    again = session.ranking(ranges=3)  # nothing has changed: the stored one
    assert again.ranges == r.ranges
    session.append_entries(session.entries().where("event_id_seq < 2"), "app")
    assert session.ranking().total == r.total + 6


def _columns_of_exchanges(plan) -> list[str]:
    found, kids = [], plan.children()
    if plan.nodeName() == "Exchange":
        found.append(plan.output().mkString(","))
    return found + [x for k in range(kids.size()) for x in _columns_of_exchanges(kids.apply(k))]


def test_lines_of_one_line_records_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"[2026-01-01T00:00:{k:02}+0000] [ALPM] line {k}\n" for k in range(60)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = read_text(spark, [("s", str(tmp_path / "a.log"))], packs.text_formats()["pacman_log"])
        plan = rows._jdf.queryExecution().sparkPlan()
        physical = rows._jdf.queryExecution().executedPlan()
        assert not any("value" in c or "raw" in c for c in _columns_of_exchanges(physical)) and "SortMergeJoin" not in physical.toString()
        assert "FileScan text" not in plan.toString()  # the file is read once, when its lines are written
        assert rows.count() == 60 and rows.where("error is not null").count() == 0
        assert [r.event_id_seq for r in rows.orderBy("event_id_seq").collect()] == list(range(60))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_unified_log_records_are_numbered_without_a_window(spark, tmp_path):
    for k in range(2):
        Path(tmp_path / f"{k}").write_text("".join(f'{{"time":{(n * 37 % 50) * 1000},"evidence":"{n % 3}","message":"m{n}"}}\n' for n in range(400)))
    rows = read_aul_records(spark, [(str(k), str(tmp_path / f"{k}")) for k in range(2)])
    assert "Window" not in rows._jdf.queryExecution().toString()
    want = sorted(range(400), key=lambda n: (n * 37 % 50, str(n % 3), n))
    for k in "01":
        assert [r.message for r in rows.where(F.col("event_id_source") == k).orderBy("event_id_seq").collect()] == [f"m{n}" for n in want]
        assert rows.where(F.col("event_id_source") == k).agg(F.min("event_id_seq"), F.max("event_id_seq")).first() == (0, 399)


def test_scratch_folders(spark, tmp_path):
    with scratch(spark) as s:
        assert s.keep(spark.range(3)).count() == 3 and s.folder.startswith(shared_dir(spark))
        inside = Path(s.folder.removeprefix("file://"))
        assert inside.is_dir()
    assert not inside.exists()
    own = Scratch(spark, str(tmp_path / "x"))
    own.keep(spark.range(1))
    own.clear()
    assert not (tmp_path / "x").exists()


