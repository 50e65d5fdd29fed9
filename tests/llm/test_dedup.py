"""SimHash links, near-duplicates and exact deduplication against brute force."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from conftest import words

from tidemark.llm import exact, graph, simhash
from tidemark.llm._base import Scratch


def _brute_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(messy, messy_rows, none):
    rows = simhash.near_groups(messy).collect()
    fps = {(i, t): _brute_fingerprint(t) for i, t, *_ in messy_rows}
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((i, f"{_brute_fingerprint(t):016x}") for i, t, *_ in messy_rows)
    known = list(fps.items())
    group = _brute_components([(a, b) for a, x in enumerate(known) for b, y in enumerate(known) if (x[1] ^ y[1]).bit_count() <= 2], range(len(known)))
    least = {g: min([known[k][0][0] for k in group if group[k] == g and known[k][0][0] is not None], default=None) for g in set(group.values())}
    want = Counter()
    for i, t, *_ in messy_rows:
        want[i, least[group[list(fps).index((i, t))]]] += 1
    assert Counter((r.doc_id, r.component_id) for r in rows) == want
    assert simhash.near_groups(none).count() == 0


def test_links_by_tables_and_by_crowded_entries(spark):
    r = np.random.default_rng(5)
    fps = {int(x) for x in r.integers(0, 2**63, 40, dtype=np.int64)}
    for base in list(fps)[:6]:
        for _ in range(25):
            fps.add(base ^ sum(1 << int(k) for k in r.choice(64, r.integers(1, 5), replace=False)))
    fps = sorted(fps)
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    want = _brute_components([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2], range(len(fps)))
    for bucket in (0, 3, 1000):
        links = simhash.links_within_two(spark.createDataFrame(signed, "node long, fp long").select("fp"), Scratch(spark), bucket).collect()
        place = {f: k for k, f in signed}
        assert _brute_components([(place[r.u], place[r.v]) for r in links], range(len(fps))) == want, bucket
        assert all((fps[place[r.u]] ^ fps[place[r.v]]).bit_count() <= 2 for r in links)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(600, 650)] + [(900 + k, 900 + (k + 1) % 7) for k in range(7)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 100 for k in range(100, 161)} | {500: 500} | {k: 500 for k in range(600, 650)} | {900 + k: 900 for k in range(7)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_recall(spark):
    """Copies with a few changed words are found; texts of the same words in other orders are left alone."""
    r, rows = np.random.default_rng(3), []
    for k in range(60):
        base = words(k, 300).split()
        rows.append((2 * k, " ".join(base)))
        copy = list(base)
        for at in r.choice(300, 4, replace=False):
            copy[at] = "changed"
        rows.append((2 * k + 1, " ".join(copy)))
    found = {x.doc_id: x.keep_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * k] == 2 * k for k in range(60))
    assert np.mean([found[2 * k + 1] == 2 * k for k in range(60)]) >= 0.9


def _closure(rows, similarity=0.8):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return links, _brute_components(links, sets)


def test_near_duplicates_among_texts_of_a_template(spark):
    """All texts share a passage; the copies stand far apart in doc_id, with other texts of the template between them."""
    passage, rows = words(1, 205), []
    for k in range(300):
        rows.append((k, f"{passage} {words(1000 + k, 65)}"))
        if k % 3 == 0:
            copy = rows[-1][1].split()
            copy[210:270:12] = ["changed"] * 5
            rows.append((9000 - k, " ".join(copy)))
    links, want = _closure(rows)
    assert {(k, 9000 - k) for k in range(0, 300, 3)} == set(links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.keep_id for r in simhash.near_duplicates(docs).collect()} == want


def test_near_duplicates_on_both_sides_of_the_limit(spark):
    """Similarities from 0.70 to 0.86: exactly those of 0.8 or more are linked."""
    rows = []
    for k in range(90):
        base = words(2000 + k, 270).split()
        copy = list(base)
        at = range(5, 270, 26)[: 4 + k % 6]
        for x in at:
            copy[x] = f"changed{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    links, want = _closure(rows)
    assert 25 < len(links) < 60 and len(_closure(rows, 0.69)[0]) == 90
    assert {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_duplicates_of_messy_rows(messy, none):
    found = {r.doc_id: r.keep_id for r in simhash.near_duplicates(messy).collect()}
    assert found[8] == 7 and found[300] == 200 and found[9] == 9 and found[None] is None
    assert simhash.near_duplicates(none).count() == 0


def test_exact_dedup(messy, messy_rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in messy_rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in messy_rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep))
    for counters in (1, 2, 1024):
        rows = exact.resolve(messy, counters).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == Counter(want)
    assert exact.resolve(none).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    stream = ["hot"] * 500 + [f"t{k}" for k in range(400)] + ["warm"] * 100
    np.random.default_rng(0).shuffle(stream)
    summary = Counter()
    for k in range(0, 1000, 90):
        summary = exact.absorb(summary, Counter(stream[k : k + 90]), 9)
    assert len(summary) <= 9 and 400 <= summary["hot"] <= 500


def test_candidates_are_bounded(spark):
    df = spark.createDataFrame([(f"d{k % 50}",) for k in range(2000)] + [("hot",)] * 1500, "digest string").repartition(5)
    found = {r.digest for r in exact.frequent_candidates(df, 4).collect()}
    assert "hot" in found and len(found) <= 5


def test_near_duplicates_with_repeated_and_null_ids(spark):
    """Texts that share an id are documents of their own; the smallest id stays, and of one id the smallest text hash."""
    a, b, c = words(1, 200), words(2, 200), words(3, 200)
    rows = [(1, a), (3, a + " more"), (3, c), (5, b), (None, b + " more"), (None, words(4, 200)), (7, None), (8, ""), (9, words(5, 200)), (9, words(5, 200) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id) for r in found) == Counter([(1, 1), (3, 1), (3, 3), (5, 5), (None, 5), (None, None), (7, 7), (8, 7), (9, 9), (9, 9)])
    assert sorted(str(r.doc_id) for r in found if r.kept) == sorted(["1", "3", "5", "None", "7", "9"])
    left = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in left} >= {(1, a), (3, c), (5, b), (7, None)} and len(left) == 6


def test_exact_copies_of_one_id(spark):
    """Rows that repeat id and text leave one, chosen by a hash of all columns; white space counts as one space."""
    rows = [(1, "a  b", "x"), (1, "a b", "y"), (1, "a b", "z"), (2, "a b", "w"), (3, "c", "v"), (3, "d", "u"), (None, "a b", "t"), (None, "e", "s"), (None, "e", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(str, exact.drop_copies(docs).collect()))
    assert len(first) == 4 and first == sorted(map(str, exact.drop_copies(docs.repartition(3)).collect()))
    assert Counter(r.doc_id for r in exact.drop_copies(docs).collect()) == Counter([1, 3, 3, None])


def test_near_duplicates_of_a_family_without_its_base(spark):
    """Copies of a base that is not there: links go between the copies, and a similar passage of others links nothing."""
    r, rows, base = np.random.default_rng(12), [], words(77, 260).split()
    for k in range(60):
        copy = list(base)
        for at in r.choice(260, 3, replace=False):
            copy[at] = f"edit{k}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(base[:120]) + " " + words(900 + k, 200)) for k in range(30)]
    _, want = _closure(rows)
    assert {x.doc_id: x.keep_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def _texts_of_a_template(n, seed):
    """Similarity of about 0.73 by a long common passage: nothing to link but one planted pair."""
    passage = words(seed, 230)
    rows = [(k, f"{passage} {words(seed + 1 + k, 36)}") for k in range(n)]
    return [*rows, (n, rows[0][1] + " and more")]


def test_frequencies_count_every_text(spark, monkeypatch):
    """Of more texts than any sample of them; those beyond the number kept are the rarest."""
    n = 24_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('one two three four five ', CASE WHEN id % 3 = 0 THEN 'six' ELSE concat('own', id) END) AS text")
    scratch = Scratch(spark)
    often = {simhash.shingle_hashes("one two three four five", 5)[0]: n, simhash.shingle_hashes("two three four five six", 5)[0]: n // 3}
    hashes, counts = simhash._frequencies(docs, 5, scratch)
    assert dict(zip(hashes, counts)) == often and sorted(hashes) == list(hashes)
    monkeypatch.setattr(simhash, "KEPT", 1)
    assert simhash._frequencies(docs, 5, scratch)[1].tolist() == [n]
    scratch.clear()


def test_templates_without_known_frequencies_stay_near_linear(spark, monkeypatch):
    """A frequency list that knows none of the shared shingles: pairs grow with the texts, not with their square."""
    monkeypatch.setattr(simhash, "KEPT", 0)
    compared, narrowed = [], simhash._narrowed

    def counted(pairs, *rest):
        compared[-1] += pairs.count()
        return narrowed(pairs, *rest)

    monkeypatch.setattr(simhash, "_narrowed", counted)
    for n in (150, 300):
        rows = _texts_of_a_template(n, 31)
        compared.append(0)
        links, want = _closure(rows)
        assert links == [(0, n)]
        found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id: r.keep_id for r in found} == want
    assert compared[1] <= 2.2 * compared[0], compared


def test_frequencies_shuffle_ranges_not_shingles(spark):
    """A row for each range and batch goes through the shuffle, however many shingles there are."""
    docs = spark.createDataFrame([(k, words(k, 400)) for k in range(300)] + [(300, None)], "doc_id long, text string").repartition(2)
    want = Counter(h for r in docs.collect() for h in simhash.shingle_set(r.text or "", 5).tolist())
    scratch, sc = Scratch(spark), spark.sparkContext
    docs = scratch.keep(docs, "docs")
    sc.setJobGroup("frequencies", "")
    hashes, counts = simhash._frequencies(docs, 5, scratch)
    sc._jsc.clearJobGroup()
    assert dict(zip(hashes.tolist(), counts.tolist())) == {h: n for h, n in want.items() if n > 1}
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("frequencies") for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 2000 < len(want) / 50
    scratch.clear()
