"""Every registered timeline query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.operators.tagging import Rule, tag_entries
from tidemark.plans import catalog
from tidemark.plans.export import read_array
from tidemark.plans.session import Session, utc_now

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("left_over", [False, True])
def test_registry_without_the_optional_folders(tmp_path, left_over):
    """A copy of the repository without them, or with the empty folder that compiled files leave."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if left_over:
        (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), e.queries().keys() == e.oracle_sql().keys())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.queries())), "True"], said.stderr


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_are_the_broadcast_side(spark, tmp_path):
    """However small the entries' compressed files are, and however unknown the size of the sources."""
    entries = spark.range(100).selectExpr("'s' AS event_id_source", "id AS event_id_seq", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS timestamp_utc", "'x' AS level", "'m' AS message", "'r' AS raw", "'{}' AS fields")
    session = Session(spark, str(tmp_path / "session"))
    session.append_entries(entries, "app")
    session.append("sources", [("s", "/a", "app", None, None)])
    session.retag([Rule("all", "t", (("message_contains", "m"),))])
    rows, t = session.entries(), session.timeline()
    for plan in (_plan(tag_entries(rows, session.sources(), [Rule("all", "t", (("message_contains", "m"),))], utc_now())), _plan(t.with_sources(t.entries))):
        assert "BuildRight" in plan and "SortMergeJoin" not in plan
    assert "SortMergeJoin" in _plan(t.search("tag=t")) and t.count("tag=t") == 100


def test_an_exported_array_is_read_by_lines(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('[\n{"level":"a,"},\n{"message":"b\\n"}\n]\n')
    rows = read_array(spark, str(path), "level string, message string")
    assert [tuple(r) for r in rows.collect()] == [("a,", None), (None, "b\n")] and "multiLine" not in _plan(rows)
    path.write_text("[\n\n]\n")
    assert read_array(spark, str(path), "level string, message string").count() == 0
