"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum presence kernel: the number of distinct character n-grams of 1 to 3
characters they share, over the square root of the product of their numbers of distinct n-grams.  Characters are the
letters of a learned alphabet in lower case, all letters of the training texts; other letters are one symbol, and runs
of anything else one gap.  Landmark texts give the Nyström features, one-versus-rest kernel ridge regression their
weights, and batches of texts are scored by matrix products.

Every language of the training rows is learned.  Training rows: for each language up to ``per_language`` distinct texts
with letters, drawn by a hash of the text (fewer, but one at least, where the languages would give more than
``most_texts`` in all); everything is scored.  Their n-grams and the sums of the regression are computed by the
executors; the driver holds the landmarks (about ``landmarks`` texts, one of each language at least) and square matrices
of that size.  ``und`` (score 0) is for null texts, texts without letters, and for all texts when there is nothing to
learn from.  Ties go to the first language in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._base import Scratch, in_fold

#: Up to this number of symbols a flag for every n-gram is faster than sorting.
_DENSE = 64
#: Numbers in a block of the product of texts and vocabulary.
_PRODUCT = 8_000_000


class Spectrum:
    """Codes of the n-grams of a text over a learned alphabet."""

    def __init__(self, alphabet: str):
        self.base = max(_DENSE, len(alphabet) + 2)
        self.codes = np.zeros(0x110000, np.int32)
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.codes[letters] = self.base - 1
        for k, c in enumerate(alphabet):
            self.codes[ord(c)] = k + 1
        self.seen = np.zeros(_DENSE + _DENSE**2 + _DENSE**3, np.uint8) if self.base == _DENSE else None

    def grams(self, text: str) -> np.ndarray | None:
        """Distinct n-gram codes in ascending order, or None for a text without letters."""
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        if not c.any():
            return None
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        base, kind = self.base, np.int64 if self.seen is None else np.int32
        c = np.concatenate([[0], c[keep], [0]]).astype(kind)
        two = c[:-1] * base + c[1:]
        three = two[:-1] * base + c[2:]
        if self.seen is None:
            return np.unique(np.concatenate([c, two + base, three + base + base**2]))
        self.seen[c] = 1
        self.seen[two + base] = 1
        self.seen[three + base + base**2] = 1
        found = np.flatnonzero(self.seen)
        self.seen[found] = 0
        return found


class Model:
    """Landmarks' n-grams, Nyström map and ridge weights; plain arrays, so it can be sent to the executors."""

    def __init__(self, languages: list[str], alphabet: str, landmarks: list[np.ndarray]):
        self.languages, self.alphabet = languages, alphabet
        self.weights = None
        if not landmarks:
            return
        self.vocabulary = np.unique(np.concatenate(landmarks))
        self.matrix = np.zeros((len(self.vocabulary), len(landmarks)), np.float32)
        for k, g in enumerate(landmarks):
            self.matrix[np.searchsorted(self.vocabulary, g), k] = 1 / np.sqrt(len(g))
        among = self.kernel(landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6 * values[-1]
        self.root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel of texts (rows) with the landmarks (columns)."""
        out, step = [], max(1, _PRODUCT // len(self.vocabulary))
        for a in range(0, len(grams), step):
            part = grams[a : a + step]
            here = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for k, g in enumerate(part):
                at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
                here[k, at[self.vocabulary[at] == g]] = 1 / np.sqrt(len(g))
            out.append(here @ self.matrix)
        return np.concatenate(out)

    def features(self, grams: list[np.ndarray]) -> np.ndarray:
        """Nyström features of texts (rows) and a constant."""
        z = (self.kernel(grams) @ self.root).astype(np.float64)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def fit(self, products: np.ndarray, sums: np.ndarray, ridge: float = 1e-3) -> Model:
        """Ridge weights from the weighted sum of z z' and, for each language (columns), of its own texts' z."""
        targets = 2 * sums - sums.sum(1, keepdims=True)
        self.weights = np.linalg.solve(products + ridge * np.eye(len(products)), targets)
        return self

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest margins (rows: texts)."""
        return self.features(grams) @ self.weights


def training_sample(docs: DataFrame, per_language: int, most_texts: int) -> DataFrame:
    """lang, place, text: distinct texts, up to about twice ``per_language`` of each language, drawn by ``place``, a hash of the text."""
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    each = max(1, min(per_language, most_texts // max(1, len(counts))))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * each / max(1, n))) for lang, n in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.withColumn("place", place).join(F.broadcast(share), "lang").where("place < share").dropDuplicates(["lang", "text"])
    first = Window.partitionBy("lang").orderBy("place", "text")
    return some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("lang", "place", "text")


def _letters(sample: DataFrame) -> str:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for b in batches:
            for t in b.column(0):
                found.update(t.as_py().lower())
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in found if c.isalpha()], pa.int32())], ["c"])

    return "".join(sorted(chr(r["c"]) for r in sample.select("text").mapInArrow(run, "c int").distinct().collect()))


def train(docs: DataFrame, per_language: int = 256, most_texts: int = 51_200, landmarks: int = 96) -> Model:
    """A model from the text and non-null lang of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.keep(training_sample(docs, per_language, most_texts), "sample")
    alphabet = _letters(sample)

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(alphabet)
        for b in batches:
            for lang, place, text in zip(*b.columns):
                g = spectrum.grams(text.as_py())
                if g is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([place.as_py()]), pa.array([g.astype(np.int64)], pa.list_(pa.int64()))], ["lang", "place", "grams"])

    known = scratch.keep(sample.select("lang", "place", "text").mapInArrow(spectra, "lang string, place double, grams array<long>"), "spectra")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(count)
    if not languages:
        scratch.clear()
        return Model([], alphabet, [])
    first = Window.partitionBy("lang").orderBy("place", F.hash("grams"))
    chosen = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max(1, landmarks // len(languages))).orderBy("lang", "k")
    model = Model(languages, alphabet, [np.array(r["grams"]) for r in chosen.select("grams").collect()])
    number = {lang: k for k, lang in enumerate(languages)}
    size = model.root.shape[1] + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, own = np.zeros((size, size)), {}
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                langs = part.column(0).to_pylist()
                z = model.features([g.values.to_numpy() for g in part.column(1)])
                w = np.array([1 / count[x] for x in langs])[:, None]
                products += (z * w).T @ z
                for lang, row in zip(langs, z * w):
                    own[lang] = own.get(lang, 0) + row
        at = [np.arange(size * size), *(size * (size + number[x]) + np.arange(size) for x in own)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate([products.ravel(), *own.values()]))], ["at", "v"])

    total = known.select("lang", "grams").mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(size * (size + len(languages)))
    flat[total.column(0).to_numpy()] = total.column(1).to_numpy()
    scratch.clear()
    return model.fit(flat[: size * size].reshape(size, size), flat[size * size :].reshape(len(languages), size).T)


_PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predictor(model: Model, batch: int = 256):
    """A UDF from text to (lang_pred, score); the score is the softmax of the margins to 9 digits."""
    spectra: list[Spectrum] = []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not spectra and model.languages:
            spectra.append(Spectrum(model.alphabet))
        for texts in batches:
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for k in range(0, len(texts) if model.languages else 0, batch):
                found = [(i, g) for i, t in enumerate(texts[k : k + batch].to_pylist(), k) if t and (g := spectra[0].grams(t)) is not None]
                if not found:
                    continue
                m = np.round(model.scores([g for _, g in found]) * 4, 9)
                e = np.exp(m - m.max(1, keepdims=True))
                best = m.argmax(1)
                for (i, _), b, p in zip(found, best, e[np.arange(len(found)), best] / e.sum(1)):
                    lang[i], score[i] = model.languages[b], round(float(p), 9)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], fields=list(_PREDICTED))

    return F.arrow_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """``docs``' doc_id with lang_pred and score."""
    udf = predictor(model)
    return docs.select("doc_id", udf(F.col("text") if text is None else text).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = train(docs.where(~held))
    udf = predictor(model)
    return docs.select("doc_id", held.alias("held_out"), udf("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
