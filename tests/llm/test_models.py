"""Toxicity and language ID: exact search against brute force, held-out accuracy, defined results for odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm._base import in_fold

SYLLABLES = {"en": "th er on an in the ed nd ha ea", "de": "sch ein ge ver ung keit lich ber en au", "fr": "eau oi eux ai ou que ment elle é ç"}


def _text(lang, r, n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r, docs, labels = random.Random(1), [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = _text("en", r).split()
        if toxic:
            for _ in range(4):
                t[r.randrange(len(t))] = r.choice(["vile", "rotten", "wretch"])
        docs.append((i, " ".join(t), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        ids = np.sort(r.choice(50, r.integers(0, 8), replace=False))
        w = r.random(len(ids))
        vectors.append((ids, w / np.sqrt((w * w).sum()) if len(ids) else w))
    index = toxicity.BlockMaxIndex(vectors, 50, block=16)
    dense = np.zeros((300, 50))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    for q in vectors[:80]:
        if not len(q[0]):
            continue
        near, cos = index.nearest(*q, 10)
        row = np.zeros(50)
        row[q[0]] = q[1]
        want = dense @ row
        order = [i for i in np.lexsort((np.arange(300), -want)) if want[i] > 0][:10]
        assert np.allclose(cos, want[order]) and np.allclose(want[near], cos)


def test_isotonic_is_monotone():
    x, y = np.array([0.0, 0.1, 0.1, 0.5, 0.9, 1.0]), np.array([0.0, 1, 0, 0, 1, 1])
    at, v = toxicity.isotonic(x, y, np.ones(6))
    assert (np.diff(v) >= 0).all() and v[-1] == 1 and at[0] == 0


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    held = in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, labels.where(~held))
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    caught = [rows[i].score >= 0.7 for i, y in truth.items() if y]
    wrong = [rows[i].score >= 0.7 for i, y in truth.items() if not y]
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.02
    assert all(0 <= r.score <= 1 for r in rows.values())
    toxic = next(i for i, y in truth.items() if y)
    assert [e.toxic for e in rows[toxic].evidence].count(1) >= 2
    kept = {r.doc_id for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in rows.items() if r.score < 0.7}


def test_document_frequencies_cover_all_rows(labelled):
    df, n = toxicity.document_frequencies(labelled[0], {"vile": 0, "no such": 1})
    assert n == 400 and df[1] == 0 and df[0] == labelled[0].where("text rlike '\\\\bvile\\\\b'").count()


def test_toxicity_of_odd_rows(labelled, messy, none):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(messy, model).collect()
    assert len(rows) == messy.count() and all(r.score < 0.7 for r in rows)
    assert toxicity.reject(messy, model).columns == messy.columns
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.train(none, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_documents(messy, None).collect()} == {0.0}


def _grams(text, alphabet):
    """Brute force: n-grams of mapped characters, gaps collapsed."""
    mapped, out = [], set()
    for c in text.lower():
        m = c if c in alphabet else "?" if c.isalpha() else " "
        if m != " " or not mapped or mapped[-1] != " ":
            mapped.append(m)
    s = " " + "".join(mapped) + " "
    for n in (1, 2, 3):
        out |= {s[k : k + n] for k in range(len(s) - n + 1)}
    return out


def test_kernel_equals_shared_ngrams():
    r = random.Random(4)
    texts = [_text(g, r, 30) for g in SYLLABLES for _ in range(5)]
    alphabet = "".join(sorted({c for t in texts for c in t if c.isalpha()}))
    spectrum = langid.Spectrum(alphabet)
    chosen = [texts[k] for k in (5, 6, 0, 1, 10, 11)]
    model = langid.Model(sorted(SYLLABLES), alphabet, [spectrum.grams(t) for t in chosen])
    got = model.kernel([spectrum.grams(t) for t in texts])
    for i, t in enumerate(texts):
        for j, landmark in enumerate(chosen):
            a, b = _grams(t, model.alphabet), _grams(landmark, model.alphabet)
            assert abs(got[i, j] - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-5


def test_language_held_out_and_odd_rows(spark, messy, none):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, _text(g, r), g) for i, g in enumerate(list(SYLLABLES) * 60)], "doc_id long, text string, lang string")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~held))
    got = langid.identify(docs.where(held), model).join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    rows = {(r.doc_id): r for r in langid.identify(messy, model).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {4, 5, 6} and rows[4].score == 0
    assert all(r.lang_pred in SYLLABLES and 0 <= r.score <= 1 for r in rows.values() if r.lang_pred != "und")
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(messy, empty).collect()} == {"und"}


def test_languages_of_many_scripts(spark):
    """More letters than fit a small alphabet; each script keeps its own letters, the rarer ones of short texts too."""
    scripts = {"latin": (0x61, 26), "greek": (0x3B1, 25), "cyrillic": (0x430, 32), "hebrew": (0x5D0, 27), "thai": (0xE01, 46), "hindi": (0x915, 37), "chinese": (0x4E00, 300), "korean": (0xAC00, 300), "japanese": (0x3041, 80)}
    r, rows = random.Random(8), []
    for i in range(360):
        lang = list(scripts)[i % len(scripts)]
        at, n = scripts[lang]
        long = 60 if lang in ("latin", "greek", "cyrillic") else 15
        rows.append((i, " ".join("".join(chr(at + r.randrange(n)) for _ in range(4)) for _ in range(long)), lang))
    model = langid.train(spark.createDataFrame(rows[:270], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(rows[270:], "doc_id long, text string, lang string"), model).collect()
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in got) >= 0.95 * len(got)


def test_every_language_is_learned(spark):
    """More languages than landmarks were asked for, one of them mostly copies of one text; sums do not depend on the partitions."""
    r = random.Random(11)
    rows = [(i, " ".join("".join(chr(0x4E00 + 40 * (i % 30) + r.randrange(40)) for _ in range(3)) for _ in range(20)), f"l{i % 30}") for i in range(300)]
    rows += [(1000 + i, rows[0][1], "l0") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.repartition(5), per_language=8, landmarks=10)
    assert model.languages == sorted({x[2] for x in rows}) and len(model.weights) <= 31
    got = langid.identify(docs, model).collect()
    assert sum(x.lang_pred == (rows[x.doc_id][2] if x.doc_id < 300 else "l0") for x in got) >= 0.95 * len(got)
    again = langid.train(docs.repartition(2), per_language=8, landmarks=10)
    assert np.allclose(model.weights, again.weights, atol=1e-6)


def test_all_words_are_in_the_cosine(labelled):
    """The neighbours of a text are those of the full vectors of all words, weighted as the module says."""
    docs, labels = labelled
    model = toxicity.train(docs, labels, k=7)
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = sorted({w for i in model.ids for w in texts[i].lower().split()})
    df = {w: sum(w in t.lower().split() for t in texts.values()) for w in names}
    y = dict(zip(model.ids, model.labels))

    def ratio(w):
        out = 0
        for has in (True, False):
            for v in (0, 1):
                group = [i for i in model.ids if y[i] == v]
                n = sum((w in texts[i].split()) == has for i in group)
                want = len(group) * sum((w in texts[i].split()) == has for i in model.ids) / len(model.ids)
                out += n * np.log(n / want) if n else 0
        return out

    idf = {w: (np.log(401 / (df[w] + 1)) + 1) * (1 if ratio(w) > 10.83 else 0.2) for w in names}

    def vector(t):
        words = t.lower().split()
        v = np.array([(1 + np.log(words.count(w))) * idf[w] if w in words else 0 for w in names])
        return v / np.sqrt((v * v).sum())

    assert list(model.vocabulary) == names
    full = np.array([vector(texts[i]) for i in model.ids])
    for i in model.ids[:12]:
        ((_, near, cos),) = model.scores([texts[i]])
        want = full @ vector(texts[i])
        assert np.allclose(cos, np.sort(want)[::-1][:7]) and np.allclose(want[near], cos)


def test_only_leading_candidates_are_sorted(monkeypatch):
    """Examples that all share a term with the text are not sorted, only those that the k-th cosine leaves."""
    r, vectors = np.random.default_rng(3), []
    for _ in range(900):
        ids = np.unique(np.append(r.choice(400, 12), 0))
        w = r.random(len(ids)) + 0.1
        vectors.append((ids, w / np.sqrt((w * w).sum())))
    index, sizes, sort = toxicity.BlockMaxIndex(vectors, 400), [], np.lexsort
    monkeypatch.setattr(toxicity.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    near, cos = index.nearest(*vectors[5], 8)
    dense = np.zeros((900, 400))
    for row, (ids, w) in zip(dense, vectors):
        row[ids] = w
    want = np.sort(dense @ dense[5])[::-1][:8]
    assert near[0] == 5 and np.allclose(cos, want) and sizes == [8]


def test_terms_of_a_text_are_those_that_are_counted():
    known = {"a": 0, "b": 1, "c": 2}
    text = "B a b x b"
    assert sorted(toxicity.terms_of(known, text)) == toxicity.term_counts(known, text)[0].tolist() == [0, 1]
