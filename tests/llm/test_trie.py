"""The trie of sorted conversations against one built turn by turn."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """``convs``: id -> list of (role, text)."""
    members, ended = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ended[tuple(turns)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ended[p])) for p, m in members.items())


def originals(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    return {c: [t[3] for t in sorted(own[c])] for c in own}


def rebuild(own):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def rows_of(convs):
    return [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]


def random_convs(seed, n, alphabet, deepest):
    r = random.Random(seed)
    return {r.randrange(10**6) * 10 + k % 10: [("u", r.choice(alphabet)) for _ in range(r.randint(1, deepest))] for k in range(n)}


def found(spark, convs, blocks):
    turns = trie.ordered_turns(spark.createDataFrame(rows_of(convs), SCHEMA))
    return Counter(map(tuple, trie.prefix_trie(turns, blocks).collect()))


@pytest.mark.parametrize("seed,n,alphabet,deepest,blocks", [(1, 150, ["a", "bb", ""], 6, 7), (2, 90, ["a"], 40, 9), (3, 200, list("abcdefghij"), 3, 5), (4, 60, ["x", "yyy"], 12, 40), (5, 1, ["a"], 3, 4), (6, 300, ["p", "q"], 2, 13)])
def test_tries_equal_brute_force(spark, seed, n, alphabet, deepest, blocks):
    convs = random_convs(seed, n, alphabet, deepest)
    assert found(spark, convs, blocks) == brute(convs)


def test_nearest_smaller_blocks_and_minima_of_stretches():
    r = random.Random(5)
    for _ in range(200):
        values = np.array([-1, *(r.randrange(5) for _ in range(r.randint(1, 40)))])
        minima = trie.RangeMinima(values)
        for k in range(len(values)):
            for value in range(-1, 6):
                assert minima.before(k, value) == max((j for j in range(k) if values[j] < value), default=-1)
                assert minima.after(k, value) == min((j for j in range(k + 1, len(values)) if values[j] < value), default=len(values))
            for j in range(k, len(values) + 1):
                assert minima.least(k, j) == (None if j == k else values[k:j].min())


def test_copies_of_one_conversation_span_many_blocks(spark):
    convs = random_convs(7, 60, ["a", "b"], 5)
    convs |= {10**8 + k: [("u", "same"), ("a", "answer")] for k in range(150)} | {10**9: [("u", "same")], 10**9 + 1: [("u", "same"), ("a", "answer"), ("u", "more")]}
    assert found(spark, convs, 16) == brute(convs)
    only = {k: [("u", "same")] for k in range(40)}
    assert found(spark, only, 6) == brute(only)


def test_messy_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, None, None, "first"), (1, 1, "user", None), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 5, "assistant", "x" * 5000),
        (3, 2, None, None), (3, 1, "", ""), (100, 0, "user", "hi"), (101, 3, "user", "é🙂"), (101, 3, "user", "a"), (None, 0, "user", "lost"), (250, 0, "user", "no head"), (7, 0, "us", "er"), (8, 0, "u", "ser"),
    ]
    rows += [(300 + k, d, "user", f"t{d % (k + 1)}") for k in range(30) for d in range(8)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", digest string, block int").repartition(3)
    turns = trie.ordered_turns(frame)
    own = originals(rows)
    assert {r.conv_id: [t.chars for t in r.turns] for r in turns.collect()} == {c: [len(t[1]) for t in x] for c, x in own.items()}
    assert Counter(map(tuple, trie.prefix_trie(trie.rebuilt(turns), 5).collect())) == brute(rebuild(own))
    assert trie.prefix_trie(turns.limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    turns = spark.createDataFrame([(5, []), (3, []), (9, [("00" * 16, 4)])], "conv_id long, turns array<struct<digest:string,chars:int>>")
    rows = sorted(map(tuple, trie.prefix_trie(turns, 3).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows == [(3, 0, None, 3, 1, 1, 0, sha("3,5")), (9, 1, 3, 1, 0, 1, 0, sha("9"))]
    assert sorted(map(tuple, trie.prefix_trie(turns.where(F.size("turns") == 0), 3).collect())) == [(3, 0, None, 2, 0, 1, 0, sha("3,5"))]


def test_query_equals_brute_force(spark):
    base = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, trie.op11_prefix_trie(spark, base).collect())) == brute(rebuild(originals(rows)))
