"""Rules: matching by type, packs, rule files, and the ways to apply them."""

import json
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import packs
from tidemark.operators import rulefiles
from tidemark.operators.tagging import BadRule, Rule, apply_rules, evaluate, matches, matches_in_one_pass, owner_of_tag, retag_summary, tag_entries, taggable

DOCS = [
    ("evtx", "2", "msg one", {"Event": {"System": {"EventID": 4625, "Computer": "W", "Provider_attributes": {"Name": "P"}}}}),
    ("evtx", "2", "msg two", {"Event": {"System": {"EventID": "4625"}}}),
    ("evtx", None, None, {"Event": {"System": {"EventID": 4625.0}}}),
    ("evtx", None, "flat", {"event_id": 4625}),
    ("journald", "6", "session opened", {"SYSLOG_IDENTIFIER": "sshd", "_COMM": "x", "_HOSTNAME": "h"}),
    ("journald", "6", "by comm", {"_COMM": "su"}),
    ("journald", "6", "present but null", {"SYSLOG_IDENTIFIER": None, "_COMM": "su"}),
    ("syslog", "E", "text 100%", {"process": "sshd", "n": 5, "x": 5.5, "b": True, "s": "5", "o": {"k": 1}, "quo'te": "q"}),
    ("aul", "Default", "Arrived% there", {"category": "MediaRemote", "subsystem": "s", "process": "/p"}),
    ("aul", "Default", "nothing", None),
]


def _value_at(fields, path):
    for p in path:
        if not isinstance(fields, dict) or p not in fields:
            return None, False
        fields = fields[p]
    return fields, True


def _brute(rule, doc):
    """The rule engine, one row at a time."""
    kind, level, message, fields = doc
    fields = fields if isinstance(fields, dict) else {}
    own = {
        ("evtx", "event_id"): [["Event", "System", "EventID"]],
        ("evtx", "provider"): [["Event", "System", "Provider_attributes", "Name"]],
        ("evtx", "subsystem"): [["Event", "System", "Provider_attributes", "Name"]],
        ("evtx", "host"): [["Event", "System", "Computer"]],
        ("journald", "host"): [["_HOSTNAME"]],
        ("journald", "process"): [["SYSLOG_IDENTIFIER"], ["_COMM"]],
    }

    def equal(e, a):
        if isinstance(e, bool) or isinstance(a, bool):
            return isinstance(e, bool) and isinstance(a, bool) and e == a
        if isinstance(e, str):
            return isinstance(a, str) and a == e
        if isinstance(e, int):
            return isinstance(a, int) and a == e
        return isinstance(e, float) and isinstance(a, (int, float)) and a == e

    for key, e in rule.match:
        if key in ("sourcetype", "level", "message"):
            if {"sourcetype": kind, "level": level, "message": message}[key] != e or not isinstance(e, str):
                return False
        elif key == "message_contains":
            if message is None or not any(n in message for n in rule.needles()):
                return False
        else:
            found = next((v for p in [*own.get((kind, key), []), [key]] if (v := _value_at(fields, p))[1]), (None, False))
            if not found[1] or not equal(e, found[0]):
                return False
    return True


@pytest.fixture(scope="module")
def rows(spark):
    data = [("s" if d[0] != "aul" else "a", k, d[1], d[2], None if d[3] is None else json.dumps(d[3]), d[0]) for k, d in enumerate(DOCS)]
    return spark.createDataFrame(data, "event_id_source string, event_id_seq long, level string, message string, fields string, sourcetype string").cache()


def _rule(k, **match):
    return Rule.from_dict({"rule": {"name": f"r{k}", "tag": {"value": f"t{k % 3}"}, "match": match}})


RULES = [
    _rule(k, **m)
    for k, m in enumerate(
        [
            {},
            {"event_id": 4625},
            {"event_id": "4625"},
            {"event_id": 4625.0},
            {"sourcetype": "evtx", "event_id": 4625},
            {"process": "sshd"},
            {"process": "su"},
            {"host": "h"},
            {"host": "W"},
            {"provider": "P", "subsystem": "P"},
            {"category": "MediaRemote"},
            {"n": 5},
            {"n": 5.0},
            {"x": 5.5},
            {"x": 5},
            {"b": True},
            {"b": 1},
            {"s": 5},
            {"o": "k"},
            {"quo'te": "q"},
            {"level": "6", "message_contains": ["opened", "closed"]},
            {"level": 6},
            {"message": "nothing"},
            {"message_contains": "Arrived%"},
            {"message_contains": ""},
            {"message_contains": 7},
            {"message_contains": [7, "two"]},
        ]
    )
]


def test_rules_by_columns_and_in_one_pass(rows):
    want = sorted((r.name, k) for r in RULES for k, d in enumerate(DOCS) if _brute(r, d))
    for apply in (matches, matches_in_one_pass):
        assert sorted((r.rule_name, r.event_id_seq) for r in apply(rows, RULES).collect()) == want, apply
    assert matches(rows, []).count() == 0 == matches_in_one_pass(rows, []).count()


def test_packs_by_columns_and_in_one_pass(spark):
    needles = [n for r in packs.all_rules() for n in r.needles()]
    docs = [("aul", None, f"x {n} y", {"category": "other"}) for n in needles[:60]]
    docs += [("evtx", None, None, {"Event": {"System": {"EventID": e}}}) for e in (4624, 4648, 4776, 1)]
    docs += [("journald", None, "Linux version 6", {"_TRANSPORT": "kernel"}), ("journald", None, "session closed for user x", {"_COMM": "sshd"})]
    data = [("s", k, d[1], d[2], json.dumps(d[3]), d[0]) for k, d in enumerate(docs)]
    df = spark.createDataFrame(data, "event_id_source string, event_id_seq long, level string, message string, fields string, sourcetype string")
    found = sorted((r.rule_name, r.event_id_seq) for r in matches_in_one_pass(df, packs.all_rules()).collect())
    assert found == sorted((r.name, k) for r in packs.all_rules() for k, d in enumerate(docs) if _brute(r, d))


def test_needles_that_overlap(spark):
    """Needles within, beginning like and crossing each other, on random messages."""
    r = random.Random(3)
    needles = ["a", "ab", "abc", "bc", "b.c", "é", "éa", "日本", "(", "a\nb", "🙂", "🙂a", "\\Q"]
    rules = [Rule(f"n{k}", "t", (("message_contains", n),)) for k, n in enumerate(needles)]
    rules += [Rule(f"s{k}", "t", (("sourcetype", r.choice(["evtx", "x"])), ("message_contains", tuple(r.sample(needles, 3))), ("level", r.choice("AB")))) for k in range(20)]
    data = [("s", k, r.choice(["A", "B", None]), r.choice([None, "".join(r.choice(needles + list("abc.(")) for _ in range(r.randint(0, 6)))]), None, r.choice(["evtx", "x", "other"])) for k in range(400)]
    df = spark.createDataFrame(data, "event_id_source string, event_id_seq long, level string, message string, fields string, sourcetype string")
    want = Counter((x.rule_name, x.event_id_seq) for x in matches(df, rules).collect())
    assert want == Counter((x.rule_name, x.event_id_seq) for x in matches_in_one_pass(df, rules).collect()) and len({n for n, _ in want}) == 33


def test_packs_need_no_python_and_no_code_of_their_own(spark):
    df = spark.createDataFrame([("s", 1, "1", "m", "{}", "evtx")], "event_id_source string, event_id_seq long, level string, message string, fields string, sourcetype string")
    plan = apply_rules(df, packs.all_rules())._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Exchange")) and plan.count("regexp_extract_all") < 20


def test_packs_are_complete():
    assert [len(packs.rules(p)) for p in packs.RULE_PACKS] == [37, 35, 15]
    names = [r.name for r in packs.all_rules()]
    assert len(set(names)) == len(names) == 87
    assert all(dict(r.match)["sourcetype"] == p for p in packs.RULE_PACKS for r in packs.rules(p))
    assert len(packs.templates()) == 18 and set(packs.text_formats()) == {"generic_timestamp", "logcat_brief", "pacman_log", "syslog_rfc3164"}
    assert all(f.validate() for f in packs.text_formats().values())
    table = rulefiles.reference_table(packs.rules("journald"))
    assert table.count("\n") == 17 and "`process` = `sshd`" in table


def test_ways_to_apply(spark, rows):
    from datetime import datetime

    entries = rows.drop("sourcetype").selectExpr("*", "TIMESTAMP_NTZ '2026-01-01' AS timestamp_utc", "'' AS raw")
    sources = spark.createDataFrame([("s", "/p", "evtx")], "source_file_id string, path string, sourcetype string")
    assert {r.event_id_source for r in taggable(entries, sources).collect()} == {"s"}  # no source row, no tags
    tags = tag_entries(entries, sources, [RULES[1], RULES[4]], datetime(2026, 1, 2))
    assert {r.applied_at for r in tags.collect()} == {datetime(2026, 1, 2)}
    assert {r.rule_name: r.n for r in retag_summary(tags).collect()} == {"r1": 2, "r4": 2}
    assert evaluate(entries, sources, [RULES[1], RULES[4]]).count() == 2 and evaluate(entries, sources, []).count() == 0
    assert owner_of_tag(RULES, "t0") is None and owner_of_tag([RULES[0]], "t0") is RULES[0] and owner_of_tag([], "t0") is None


def test_bad_rules():
    for text in ("x = ", "[rule]\nname = 1", "[rule]\nname = 'a'\n[rule.tag]\n"):
        with pytest.raises(BadRule):
            Rule.from_toml(text)


def test_rule_files(tmp_path):
    rulefiles.create_contains(tmp_path / "b.toml", "b", 'say "hi" \\', "t")
    rulefiles.create_equals(tmp_path / "a.toml", "a", "evtx", "event_id", "4624", "t")
    rulefiles.create_equals(tmp_path / "c.toml", "c", "journald", "process", "sshd", "t")
    (tmp_path / "note.txt").write_text("")
    found = rulefiles.scan(tmp_path)
    assert [p.name for p in found] == ["a.toml", "b.toml", "c.toml"]
    a, b, c = rulefiles.load(found)
    assert dict(a.match) == {"sourcetype": "evtx", "event_id": 4624} and dict(c.match)["process"] == "sshd" and b.needles() == ['say "hi" \\']
    rulefiles.append_needle(tmp_path / "b.toml", "more")
    rulefiles.append_needle(tmp_path / "b.toml", "more")
    assert rulefiles.load([tmp_path / "b.toml"])[0].needles() == ['say "hi" \\', "more"]
    with pytest.raises(FileNotFoundError):
        rulefiles.scan(tmp_path / "none")
    (tmp_path / "bad.toml").write_text("[")
    with pytest.raises(BadRule):
        rulefiles.load(rulefiles.scan(tmp_path))


@pytest.mark.parametrize("body", ['message_contains = "one" # why', "message_contains = ['one', # first\n  \"two\" # last ]\n]", "message_contains = [ 'one' ]", "message_contains = []", "level = \"E\"", "message_contains = ['one',\n]"])
def test_needles_are_added_and_comments_stay(tmp_path, body):
    p = tmp_path / "r.toml"
    p.write_text(f"# top\n[rule]\nname = \"n\"\n[rule.match] # m\n{body}\n[rule.tag]\nvalue = \"t\"\n")
    before = Rule.from_toml(p.read_text())
    rulefiles.append_needle(p, 'new "x"')
    after = Rule.from_toml(p.read_text())
    assert sorted(after.needles()) == sorted([*before.needles(), 'new "x"']) and dict(after.match).get("level") == dict(before.match).get("level")
    assert all(comment in p.read_text() for comment in ("# top", "# m"))
    if "# why" in body or "# last" in body:
        assert ("# why" in p.read_text()) == ("# why" in body) and ("# last" in p.read_text()) == ("# last" in body)


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=12).filter(lambda s: s.encode("utf-8", "ignore").decode() == s and "\r" not in s))
def test_any_needle_round_trips(tmp_path, needle):
    p = tmp_path / "r.toml"
    rulefiles.create_contains(p, "n", needle, "t")
    rulefiles.append_needle(p, needle + "!")
    assert Rule.from_toml(p.read_text()).needles() == [needle, needle + "!"]


@pytest.mark.parametrize("name, want", [("My Rule!", "my_rule"), ("  a--b  ", "a_b"), ("é", "rule"), ("", "rule"), ("Wi-Fi 2", "wi_fi_2")])
def test_slug(name, want):
    assert rulefiles.slug(name) == want
