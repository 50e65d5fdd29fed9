"""Logs that grow chunk by chunk, against the same log read whole."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark import packs
from tidemark.operators.tagging import Rule
from tidemark.plans.load import load
from tidemark.plans.session import Session
from tidemark.streaming.growing import Assembler, watch_text

FMT = packs.text_formats()["generic_timestamp"]
RULES = [Rule("ends", "end", (("message_contains", "first"),))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# a", "b", "", "# c\r", "  d"]), max_size=12), st.lists(st.integers(0, 40), max_size=6), st.booleans())
def test_any_cuts_give_the_same_records(lines, cuts, ended):
    text = "\n".join(lines) + ("\n" if ended and lines else "")
    whole = Assembler("^#", None)
    whole.add(text)
    whole.flush()
    edges, state, out = sorted({0, len(text), *(c for c in cuts if c < len(text))}), None, []
    for a, z in zip(edges, edges[1:]):
        part = Assembler("^#", state)
        part.add(text[a:z])
        out, state = out + part.out, part.state()
    last = Assembler("^#", state)
    last.flush()
    assert out + last.out == whole.out
    assert [s for s, _, _ in whole.out] == list(range(len(whole.out)))


def rows(session):
    return sorted((r.path.rsplit("/", 1)[1], r.event_id_seq, str(r.timestamp_utc), r.raw) for r in session.timeline().with_sources(session.entries()).collect())


def test_records_that_span_batches_come_out_once(spark, tmp_path, monkeypatch):
    """Chunks cut anywhere, one batch each, a stop before and one after a commit, and a new query over the same checkpoint each time."""
    r = random.Random(8)
    logs = {n: "".join(f"2026-01-01 00:00:{k:02} first of {n} {k}\n" + "  more\n" * (k % 3) for k in range(12)) for n in ("a", "b")}
    session, folder = Session(spark, str(tmp_path / "s")), tmp_path / "in"
    parts = {n: sorted(r.sample(range(1, len(t)), 3)) for n, t in logs.items()}
    watch = lambda: watch_text(session, str(folder), FMT, RULES, f"{tmp_path}/cp", "live", zone="UTC", idle_ms=30_000)
    for k in range(4):
        for n, text in logs.items():
            (folder / n).mkdir(parents=True, exist_ok=True)
            edges = [0, *parts[n], len(text)]
            (folder / n / f"{k}.log").write_text(text[edges[k] : edges[k + 1]])
        if k in (1, 2):
            real = Session.commit

            def fails(self, *args, real=real, after=k == 2, **more):
                if after:
                    real(self, *args, **more)
                raise OSError("stopped")

            monkeypatch.setattr(Session, "commit", fails)
            with pytest.raises(Exception, match="stopped"):
                watch().awaitTermination()
            monkeypatch.setattr(Session, "commit", real)
        watch().awaitTermination()
    # the last record of each log waits for what may follow it; a batch after the idle time ends it
    whole = Session(spark, str(tmp_path / "w"))
    for n, text in logs.items():
        (tmp_path / n).write_text(text)
        load(whole, "text", str(tmp_path / n), FMT, RULES, zone="UTC")
    want = rows(whole)
    got = rows(session)
    assert got == [w for w in want if w[1] < 11]
    q = watch_text(session, str(folder), FMT, RULES, f"{tmp_path}/cp", "live", zone="UTC", idle_ms=1, trigger={"processingTime": "0 seconds"})
    (folder / "a/9.log").write_text("2026-01-01 00:01:00 bad time follows\n2026-13-01 00:00:00 first\n")
    until = time.time() + 90
    while time.time() < until and session.entries().count() < len(want) + 1:
        time.sleep(1)
    q.stop()
    got = rows(session)
    assert [g for g in got if g[1] < 12] == want and [g[:2] for g in got if g[1] >= 12] == [("a", 12)]
    assert session.import_tags().count() == len(want) and session.sources().count() == 2
    (said,) = [a for a in session.activity().collect() if a.operation == "stream"]
    assert len(said.skipped) == 1
