"""Composed crcs against strings, and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORD.findall(lowered(text))
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)


def brute(docs, target, longest=1, buckets=resample.BUCKETS, seed=2024, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, t, *features(t, longest)) for i, t in docs]
    s, t = (Counter(bucket(f) for fs in x for f in fs) for x in ([o[2] for o in own], [features(x, longest)[0] for x in target]))
    big_s, big_t = float(s.total() + buckets), float(t.total() + buckets)
    rows = []
    for i, _, fs, n in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    ready = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    ranks = {id(r): k for k, r in enumerate(ready[: percent * len(ready) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9 z,\né日\x7f🙂"), max_size=60), st.integers(1, 5))
def test_composed_crcs_equal_those_of_the_strings(text, longest):
    crcs, n = resample.feature_crcs(text, longest)
    want, words = features(text, longest)
    assert crcs.tolist() == [zlib.crc32(f.encode()) for f in want] and n == words


def test_shifts_over_long_strings():
    r = random.Random(1)
    pairs = [(r.randbytes(r.randint(0, 50)), r.randbytes(n)) for n in (0, 1, 7, 255, 256, 4097, 70_001)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert resample.combined(first, second, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_rows_equal_brute_force(spark, messy, messy_rows, none, longest):
    target = spark.createDataFrame([("Hello world this is fine",), (None,), ("beta gammas deltaed",)], "text string")
    got = resample.resample(messy, target, longest, buckets=97, least_words=5, percent=40).collect()
    want = brute([(i, t) for i, t, *_ in messy_rows], [r.text for r in target.collect()], longest, 97, least=5, percent=40)
    assert Counter(map(tuple, got)) == want
    assert resample.resample(none, target, longest).count() == 0
    assert resample.resample(messy, target.limit(0), longest).count() == len(messy_rows)


def test_query_equals_brute_force_and_needs_no_window(spark):
    base = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{base}/documents.parquet").collect(), spark.read.parquet(f"{base}/benchmark.parquet").collect()
    found = resample.op13_resample(spark, base)
    assert Counter(map(tuple, found.collect())) == brute([(d.doc_id, d.text) for d in docs], [t.text for t in target])
    assert "Window" not in found._jdf.queryExecution().toString()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, "one two three four five") for k in range(50)] * 2
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("one",)], "text string"), least_words=3, percent=30).collect()
    assert Counter(map(tuple, got)) == brute(rows, ["one"], least=3, percent=30)
