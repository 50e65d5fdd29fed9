"""Requirements of queries, and searches with the trigram index against searches of everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import packs
from tidemark.operators import required
from tidemark.operators.grammar import parse
from tidemark.plans import ngrams
from tidemark.plans.load import load
from tidemark.plans.session import STORED, Session


def holds(need, text: bytes) -> bool:
    if need is None:
        return True
    if isinstance(need, bytes):
        return need in text
    return (all if need[0] == "all" else any)(holds(n, text) for n in need[1])


@pytest.mark.parametrize(
    "pattern,need",
    [
        ("pump", b"pump"),
        ("ab", None),
        ("^pump [0-9]+ broke$", ("all", [b"pump ", b" broke"])),
        ("(?i)pump", None),
        ("(?i:pump) broke", b" broke"),
        ("pump|valve", ("any", [b"pump", b"valve"])),
        ("pump|v", None),
        ("(pump)+x?", b"pump"),
        ("(pump)*valve", b"valve"),
        ("[[:alpha:]]pump", None),
        (r"\Qpump\E", None),
        ("a.*", None),
        (r"héllo\.", "héllo.".encode()),
    ],
)
def test_needs_of_patterns(pattern, need):
    assert required.of_pattern(pattern) == need


def test_needs_never_rule_out_a_match():
    r = random.Random(6)
    atoms = ["abc", "b", "c+", "(ab|bc)", "(abc|cab)+", "[ab]", ".", "a?", "(bca)*", "^", "$", "(?:cab){2}", "(?i:AB)"]
    for _ in range(3000):
        pattern = "".join(r.choice(atoms) for _ in range(r.randint(1, 5)))
        need = required.of_pattern(pattern)
        text = "".join(r.choice("abcAB") for _ in range(r.randint(0, 12)))
        assert not re.search(pattern, text) or holds(need, text.encode()), (pattern, text)


@pytest.mark.parametrize(
    "query,need",
    [
        ("pump", b"pump"),
        ("-pump", None),
        ("pump valve", ("all", [b"pump", b"valve"])),
        ("pump OR valve", ("any", [b"pump", b"valve"])),
        ("pump OR level=x", None),
        ("pump OR valve host=a broke", ("all", [("any", [b"pump", b"valve"]), b"broke"])),
        ("message~pum[pq]+s raw=line", ("all", [b"pum", b"line"])),
        ("level=ERROR", None),
    ],
)
def test_needs_of_queries(query, need):
    assert required.of_query(parse(query)) == need


FMT = packs.text_formats()["generic_timestamp"]
WORDS = [f"{a}{b}{c}" for a in ("pump", "valve", "motor", "é", "x") for b in ("", "_on", "-off") for c in ("", "7", " ok")]


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    """Eight files of 300 lines, each with words of its own, in three loads, and one load without an index."""
    folder, r = tmp_path_factory.mktemp("logs"), random.Random(9)
    s = Session(spark, str(tmp_path_factory.mktemp("session") / "s"))
    for part in range(4):
        at = folder / f"l{part}"
        at.mkdir()
        for k in range(2):
            some = r.sample(WORDS, 6)
            lines = [f"2026-01-01 00:{n // 60:02}:{n % 60:02} {r.choice(some)} {r.choice(some)} n{n} f{part}{k}" for n in range(300)]
            (at / f"{k}.log").write_text("\n".join(lines) + "\n")
        load(s, "text", str(at), FMT, zone="UTC", index=part < 3)
    return s


def test_searches_with_the_index_equal_those_without(session, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 16_384)
    r, t = random.Random(10), session.timeline()
    assert t.index is not None
    plain = session.timeline()
    plain.index = None
    terms = [*WORDS, "f10", "n299", "none of them", "ab", "-pump", "message=motor", "raw~valve.(on|off)", "message~^x_on", "message~(?i)PUMP", "level=x"]
    skipped = 0
    for _ in range(25):
        picked = [r.choice(terms) for _ in range(r.randint(1, 3))]
        text = r.choice([" ", " OR "]).join(x if "~" in x or "=" in x or x[0] == "-" else f'"{x}"' for x in picked)
        assert sorted(t.search(text).select("event_id_source", "event_id_seq").collect()) == sorted(plain.search(text).select("event_id_source", "event_id_seq").collect()), text
        pruned = t.index.prune(required.of_query(parse(text)))
        skipped += 0 if pruned is None else pruned.files - pruned.files_read
    assert skipped > 20


def test_files_and_row_groups_are_skipped(spark, tmp_path, monkeypatch):
    """One file of 4,000 lines with a rare word: only its stretch is asked for, and the scan reads few rows."""
    monkeypatch.setattr(ngrams, "BLOCK", 100)
    (tmp_path / "logs").mkdir()
    for k in range(3):
        rare = 1234 if k == 1 else None
        (tmp_path / f"logs/{k}.log").write_text("".join(f"2026-01-01 00:00:00 line {n} of file {k}{' needle' if n == rare else ''}\n" for n in range(4000)))
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    spark._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "200")
    try:
        s = Session(spark, str(tmp_path / "s"))
        load(s, "text", str(tmp_path / "logs"), FMT, zone="UTC")
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")
    index = s.timeline().index
    pruned = index.prune(required.of_query(parse("needle")))
    assert (pruned.files, pruned.files_read, pruned.stretches) == (3, 1, 1)
    assert len(pruned.entries.inputFiles()) == 1
    found = s.timeline().search("needle")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = s.timeline().search("needle")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(event_id_seq,1200)" in plan and "LessThanOrEqual(event_id_seq,1299)" in plan
    assert found.count() == 1
    query = found.select("message")._jdf.queryExecution()
    query.toRdd().count()
    scan = [p for p in _leaves(query.executedPlan()) if "Scan" in p.nodeName()][0]
    assert scan.metrics().apply("numOutputRows").value() <= 400  # of 12,000
    none = index.prune(required.of_query(parse("nowhere")))
    assert none.files_read == 0 and none.entries.count() == 0 and none.entries.schema.names == STORED.names


def _leaves(plan):
    kids = plan.children()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return _leaves(plan.executedPlan())
    return [plan] if kids.isEmpty() else [x for k in range(kids.size()) for x in _leaves(kids.apply(k))]


def test_texts_of_all_lengths_have_their_trigrams(spark):
    rows = [(7, k // 5, m, w) for k, (m, w) in enumerate([("", "ab"), ("abc", ""), ("é", "x"), ("ab", "c"), ("abcd", "zzz"), ("日本", "aaaa"), ("", ""), ("q", "rs")])]
    df = spark.createDataFrame(rows, "file long, block long, message string, raw string").coalesce(1)
    got = {(r.block, r.gram) for r in df.mapInArrow(ngrams._trigram_rows, ngrams.GRAMS).collect()}
    assert got == {(b, g) for _, b, m, w in rows for t in (m, w) for g in required.trigrams(t.encode())}


def test_a_load_that_stops_leaves_nothing_and_is_done_again(spark, tmp_path, monkeypatch):
    """After each step of a load: no entry, source, tag or file of the index is seen; the next attempt replaces what is left."""
    from tidemark.operators.tagging import Rule

    rules = [Rule("all", "any", ())]
    (tmp_path / "logs").mkdir()
    for k in range(2):
        (tmp_path / f"logs/{k}.log").write_text("2026-01-01 00:00:00 pump\n" * 3)
    s = Session(spark, str(tmp_path / "s"))
    seen = lambda: (s.entries().count(), s.sources().count(), s.import_tags().count(), s.timeline().count("pump"), len(s.loaded_sources()))
    steps = [(Session, "write_entries"), (Session, "write_sources"), (Session, "write_tags"), (ngrams, "write"), (Session, "commit")]
    for owner, step in steps:
        for before in (True, False):
            real = getattr(owner, step)

            def fails(*args, real=real, before=before, **more):
                if not before and real.__name__ != "commit":
                    real(*args, **more)
                raise OSError("stopped")

            monkeypatch.setattr(owner, step, fails)
            with pytest.raises(OSError, match="stopped"):
                load(s, "text", str(tmp_path / "logs"), FMT, rules, zone="UTC", name="again")
            monkeypatch.setattr(owner, step, real)
            assert seen() == (0, 0, 0, 0, 0)
    first = load(s, "text", str(tmp_path / "logs"), FMT, rules, zone="UTC", name="again")
    assert seen() == (6, 2, 6, 6, 2)
    assert load(s, "text", str(tmp_path / "logs"), FMT, rules, zone="UTC", name="again") == first and seen() == (6, 2, 6, 6, 2)
    load(s, "text", str(tmp_path / "logs"), FMT, rules, zone="UTC")
    assert seen() == (12, 4, 12, 12, 4)
    assert s.entries().join(s.sources(), F.col("event_id_source") == F.col("source_file_id"), "left_anti").isEmpty()
    s.write_entries(s.entries(), "text", "left-over")
    assert seen()[0] == 12 and s.vacuum() == ["left-over"] and seen() == (12, 4, 12, 12, 4)
    assert s.retag([]) == {} and s.import_tags().count() == 0
    load(s, "text", str(tmp_path / "logs"), FMT, rules, zone="UTC")
    assert s.import_tags().count() == 6 and s.retag(rules) == {"all": 18}
