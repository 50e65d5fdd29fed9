"""Counts that are kept with loads, retaggings and streamed batches, against counts of the tables."""

import json
import random

import pytest

from tidemark import packs
from tidemark.operators.tagging import Rule
from tidemark.operators.timeline import Timeline
from tidemark.plans.load import load
from tidemark.plans.session import Session
from tidemark.streaming.ingest import watch

FMT = packs.text_formats()["pacman_log"]
RULES = [Rule("lines", "line", (("message_contains", "line"),)), Rule("sevens", "seven", (("message_contains", "7"),)), Rule("all", "line", ())]


def menus(t: Timeline, sources: list[str]) -> list:
    rows = [t.tag_counts(), t.level_counts(), t.source_counts(), t.rule_counts(sources), t.rule_counts([]), t.distinct_levels(), t.distinct_tags(), t.tag_vocabulary(), t.level_labels()]
    return [sorted(map(tuple, r.collect()), key=repr) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_menus_equal_full_counts_after_any_order(spark, tmp_path, seed):
    r, s = random.Random(seed), Session(spark, str(tmp_path / "s"))
    steps = ["load", "retag", "load", "stream", "retag", "load"]
    r.shuffle(steps)
    for k, step in enumerate(steps):
        if step == "load":
            at = tmp_path / f"l{k}.log"
            at.write_text("".join(f"[2026-01-01T00:00:{n:02}+0000] [{r.choice('AB')}] line {n}\n" for n in range(r.randint(1, 30))))
            load(s, "text", str(at), FMT, r.sample(RULES, 2))
        elif step == "retag":
            s.retag(r.sample(RULES, r.randint(0, 3)))
        else:
            (tmp_path / "in").mkdir()
            (tmp_path / "in/1.json").write_text("".join(json.dumps({"timestamp_utc": "2026-01-01T00:00:00", "level": r.choice(["I", None]), "message": f"line {n}", "raw": "", "fields": "{}", "seq": n}) + "\n" for n in range(5)))
            watch(s, str(tmp_path / "in"), "app", RULES, f"{tmp_path}/cp", "live").awaitTermination()
    s.add_tag("live", 0, "own")
    t = s.timeline()
    sources = [x.source_file_id for x in s.sources().collect()][:2]
    kept = menus(t, sources)
    assert t.counts is not None
    t.counts = None
    assert kept == menus(t, sources) and kept[2]


def test_menus_scan_no_entries(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"))
    (tmp_path / "a.log").write_text("[2026-01-01T00:00:00+0000] [A] line\n")
    load(s, "text", str(tmp_path / "a.log"), FMT, RULES)
    t = s.timeline()
    for rows in (t.tag_counts(), t.level_counts(), t.source_counts(), t.rule_counts(["x"]), t.distinct_levels(), t.distinct_tags()):
        plan = rows._jdf.queryExecution().toString()
        assert "log_entries" not in plan and "load_tags" not in plan
        assert all("_counts" in f or "load_sources" in f for f in rows.inputFiles())
