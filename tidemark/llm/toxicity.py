"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled rows (about ``per_class`` of each label, drawn by a hash of the id; of several
texts of one id the smallest counts).  Terms are lower-case words; the vocabulary is that of all examples, none is left
out, and document frequencies are those of the whole corpus.  A text is its vector of (1 + ln tf) * idf over the
vocabulary, where the idf of a word whose presence does not depend on the label (log-likelihood ratio up to 10.83 among
the examples) counts a fifth: with plain idf the topic's words hide the few that matter (see the README's figures).  A
text's neighbours are the ``k`` examples of highest cosine, found exactly: postings are held in blocks of examples with
the largest weight of each term in each block, and blocks whose bound is below the k-th cosine are not read.  Neighbours
vote by 1 / (1 - cosine + 0.1); the share of toxic votes is calibrated by isotonic regression on the examples' own
leave-one-out votes, weighted to the label frequencies of all labelled rows.

Null and empty texts and texts without a word of the vocabulary have no neighbours; their vote is calibrated like any
other.  Without labelled rows of both kinds every score is 0.  Labels of several rows for one id count as toxic if any is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import in_fold, text_or_empty, unpacked

_WORD = re.compile(r"\w+")
_NONE = -0.01  # the vote of a text without neighbours: below any share of votes
#: The 0.1 % point of the log-likelihood ratio, and the weight of words below it.
_SIGNIFICANT, _FAINT = 10.83, 0.2


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def term_counts(vocabulary: dict[str, int], text: str) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text, ascending, and how often each occurs."""
    words = _WORD.findall(text.lower())
    found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
    return np.unique(found[found >= 0], return_counts=True)


def terms_of(vocabulary: dict[str, int], text: str) -> np.ndarray:
    """The terms of a text, each once, in any order: a repeated word is looked up once."""
    words = set(_WORD.findall(text.lower()))
    found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
    return found[found >= 0]


def likelihood_ratios(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """Of each term the log-likelihood ratio between its presence in a text and the text's label."""
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    k = np.zeros((terms, 2))
    for (ids, _), y in zip(counts, labels):
        k[ids, y] += 1
    share = k.sum(1, keepdims=True) / n.sum()

    def part(a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0).sum(1)

    return part(k, share * n) + part(n - k, (1 - share) * n)


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


class BlockMaxIndex:
    """An inverted index of unit vectors.

    Examples stand in blocks.  A term has an entry for each block with an example that has it: the largest weight there,
    rounded up, and its postings in that block.  Terms of at least one example in ``common`` have their postings as a
    row of all examples, as every block would be read for them.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64, common: int = 24):
        self.block, self.blocks = block, -(-len(vectors) // block)
        self.size = self.block * self.blocks
        # examples with the same strongest term share blocks, which keeps the bounds tight
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i)), np.int64)
        none = np.empty(0, np.int64)
        term = np.concatenate([none, *(vectors[i][0] for i in self.order)])
        slot = np.repeat(np.arange(len(vectors)), [len(vectors[i][0]) for i in self.order]) if vectors else none
        weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in self.order)])
        often = np.flatnonzero(np.bincount(term, minlength=terms) * common >= max(1, len(vectors)))
        self.row = np.full(terms, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.size))
        whole = self.row[term] >= 0
        self.rows[self.row[term[whole]], slot[whole]] = weight[whole]
        term, slot, weight = term[~whole], slot[~whole], weight[~whole]
        by = np.lexsort((slot, term))
        term, self.slot, self.weight = term[by], slot[by], weight[by]
        entry = term * max(1, self.blocks) + self.slot // block
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        self.entry_at, self.entry_size = first, np.diff(first, append=len(entry))
        self.entry_block = self.slot[first] // block if len(first) else none
        self.bound = np.nextafter(np.maximum.reduceat(self.weight, first).astype(np.float32), np.float32(2)).astype(np.float64) if len(first) else np.empty(0)
        self.term_at = np.searchsorted(term[first], np.arange(terms + 1))

    def of_common_terms(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosines of each vector (a row) with each example: one matrix product."""
        dense = np.zeros((len(vectors), len(self.rows)))
        for k, (ids, weights) in enumerate(vectors):
            row = self.row[ids]
            dense[k, row[row >= 0]] = weights[row >= 0]
        return dense @ self.rows

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k highest positive cosines; ties go to the smaller example number.

        ``scores``: the vector's row of :meth:`of_common_terms`, which is changed.
        """
        scores = self.of_common_terms([(ids, weights)])[0] if scores is None else scores
        rare = self.row[ids] < 0
        ids, weights = ids[rare], weights[rare]
        count = self.term_at[ids + 1] - self.term_at[ids]
        entries, w = _stretches(self.term_at[ids], count), np.repeat(weights, count)
        block = self.entry_block[entries]
        bounds = scores.reshape(self.blocks, self.block).max(1) + np.bincount(block, w * self.bound[entries], self.blocks)
        ranked = np.argsort(-bounds, kind="stable")
        done, least, at, step = np.zeros(self.blocks, bool), 0.0, 0, max(1, self.blocks // 8)
        while at < self.blocks:
            part = ranked[at : at + step]
            part = part[(bounds[part] > 0) & (bounds[part] >= least - 1e-9)]
            if not len(part):
                break
            read = np.zeros(self.blocks, bool)
            read[part] = True
            some = read[block]
            own = entries[some]
            size = self.entry_size[own]
            posting = _stretches(self.entry_at[own], size)
            scores += np.bincount(self.slot[posting], np.repeat(w[some], size) * self.weight[posting], self.size)
            done |= read
            found = scores.reshape(self.blocks, self.block)[done].ravel()
            least = max(0.0, np.partition(found, -k)[-k]) if len(found) >= k else 0.0
            at, step = at + step, self.blocks
        # only what the k-th cosine leaves is sorted; ``least`` is 0 as long as fewer were found
        slots = np.flatnonzero((scores > 0) & (scores >= least) & np.repeat(done, self.block))
        found = self.order[slots]
        top = np.lexsort((found, -scores[slots]))[:k]
        return found[top], scores[slots][top]


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """Share of toxic votes among neighbours, each weighted by the inverse of its distance."""
    if not len(cosines):
        return _NONE
    w = 1 / (1 - np.minimum(cosines, 1) + 0.1)
    return float((w * labels).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit as knots (x, value) for linear interpolation."""
    at = np.unique(x)
    pools = [[(w[x == v] * y[x == v]).sum(), w[x == v].sum(), v, v] for v in at]
    done: list[list[float]] = []
    for p in pools:
        done.append(p)
        while len(done) > 1 and done[-2][0] * done[-1][1] >= done[-1][0] * done[-2][1]:
            a, b = done[-2], done.pop()
            done[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    knots = [(v, p[0] / p[1]) for p in done for v in ((p[2], p[3]) if p[2] < p[3] else (p[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Vocabulary, idf, index of examples, their labels and ids, and the calibration."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list[int], weights: np.ndarray, k: int):
        self.vocabulary, self.labels, self.ids, self.k = vocabulary, labels, ids, k
        self.idf = idf * np.where(likelihood_ratios(counts, labels, len(vocabulary)) > _SIGNIFICANT, 1, _FAINT)
        vectors = [self.unit(*c) for c in counts]
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        votes = []
        for i, v in enumerate(vectors):
            near, cos = self.index.nearest(*v, k + 1) if len(v[0]) else (np.empty(0, np.int64), np.empty(0))
            other = near != i
            votes.append(vote(labels[near[other][:k]], cos[other][:k]))
        self.knots = isotonic(np.array(votes), labels.astype(float), weights)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, n = term_counts(self.vocabulary, text)
        return self.unit(ids, n.astype(float))

    def unit(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of terms (ascending) and their counts."""
        w = (1 + np.log(n)) * self.idf[ids]
        return ids, w / np.sqrt((w * w).sum()) if len(ids) else w

    def scores(self, texts: Iterable[str], together: int = 64) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated score of each text, and its neighbours with their cosines; ``together`` texts make one matrix product."""
        for part in batched(texts, together):
            vectors = [self.vector(t) for t in part]
            for (ids, w), common in zip(vectors, self.index.of_common_terms(vectors)):
                near, cos = self.index.nearest(ids, w, self.k, common) if len(ids) else (np.empty(0, np.int64), np.empty(0))
                yield float(np.clip(np.interp(vote(self.labels[near], cos), *self.knots), 0, 1)), near, cos


def examples(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[pa.Table | None, dict[int, int]]:
    """doc_id, toxic, words and their counts (n) of the sample in order of doc_id, and the number of labelled ids of each label.

    The words are counted by the executors; what the driver gets is bounded by the number of examples and their distinct words.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None, totals
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / totals[1])).otherwise(min(1.0, per_class / totals[0]))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [word_counts(t.as_py()) for t in b.column(2)]
            words, n = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words, n], ["doc_id", "toxic", "words", "n"])

    return texts.mapInArrow(run, "doc_id long, toxic int, words array<string>, n array<long>").toArrow().sort_by("doc_id"), totals


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Of each term over all rows of ``docs``, and the number of rows; a partition sends one row per term that it has."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(sent.value), np.int64), 0
        for b in batches:
            n += b.num_rows
            for t in b.column(0):
                df[terms_of(sent.value, t.as_py())] += 1
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, -1)), pa.array(np.append(df[have], n))], ["term", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    term, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, k: int = 16) -> Model | None:
    """A model from the rows of ``labels`` (doc_id, toxic) and the texts of ``docs``; None without rows of both labels."""
    rows, totals = examples(docs, labels, per_class)
    y = np.empty(0, np.int64) if rows is None else rows["toxic"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    each = [totals[v] / (y == v).sum() for v in (0, 1)]
    words = rows["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    vocabulary = {w: i for i, w in enumerate(sorted(known))}
    term = np.array([vocabulary[w] for w in known], np.int64)[coded.indices.to_numpy()]
    n, ends = rows["n"].combine_chunks().flatten().to_numpy().astype(float), np.cumsum(pc.list_value_length(words).to_numpy())[:-1]
    counts = [(t[by], c[by]) for t, c in zip(np.split(term, ends), np.split(n, ends)) for by in (np.argsort(t),)]
    df, total = document_frequencies(docs, vocabulary)
    return Model(vocabulary, np.log((total + 1) / (df + 1)) + 1, counts, y, rows["doc_id"].to_pylist(), np.array([each[v] for v in y]), k)


_SCORED = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))])


def scorer(spark, model: Model | None, evidence: int = 3):
    """A UDF from text to (score, evidence): the nearest examples with their label and cosine. The model is bounded by its parameters and broadcast."""
    sent = spark.sparkContext.broadcast(model)

    def shown(m: Model, score: float, near: np.ndarray, cos: np.ndarray) -> dict:
        return {"score": score, "evidence": [{"doc_id": int(m.ids[i]), "toxic": int(m.labels[i]), "cosine": float(c)} for i, c in zip(near[:evidence], cos)]}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            m = sent.value
            found = [{"score": 0.0, "evidence": []}] * len(texts) if m is None else [shown(m, *x) for x in m.scores(t.as_py() or "" for t in texts)]
            yield pa.array(found, _SCORED)

    return F.arrow_udf(run, "score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, evidence for every row of ``docs``."""
    udf = scorer(docs.sparkSession, model)
    return docs.select("doc_id", udf("text").alias("s")).select("doc_id", "s.score", "s.evidence")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``; their columns stay."""
    udf = scorer(docs.sparkSession, model, 0)
    return unpacked(docs.select(F.struct("*").alias("row"), udf("text").alias("s")).where(F.col("s.score") < threshold), docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = in_fold(F.col("doc_id"), 3, 1)
    model = train(docs, labels.where(~held))
    udf = scorer(spark, model)
    scored = docs.select("doc_id", held.alias("held_out"), udf("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.7).cast("int").alias("predicted"), F.to_json("s.evidence").alias("evidence"))
