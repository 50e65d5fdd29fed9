"""Target-distribution importance resampling over hashed word n-grams.

Words are the runs of digits, a-z and characters from U+0080 on after A-Z is lower-cased; features are all runs of 1 to
``longest`` consecutive words, joined by one space, repeats counted.  A feature's bucket is the unsigned crc32 of its
bytes modulo the number of buckets.

No n-gram string is ever made.  crc32 is affine over GF(2): ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where the
shift by a number of bytes is a product of the matrices for 1, 2, 4, ... bytes.  Each word's crc is taken once; those of
longer runs follow from it by the matrices, for all runs of a document at once.  A document's distinct buckets and their
counts are written once; the counts of the corpus and the weights of documents are both taken from there.

A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus.  A document's weight is the
sum of the gains of its features, its score adds Gumbel noise that depends on a seed and its id alone, so the documents
of the highest scores are a sample without replacement in proportion to their importance.

Null text has no words.  A null id counts as the empty string in the noise and comes after all other ids; rows that
repeat an id and a text have one score and take places side by side.  No documents, or an empty target, give no rows, or
gains of an empty target.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import materialise, table, text_or_empty
from tidemark.operators.places import with_places

#: The complement of the excluded characters in UTF-8: bytes from 0x80 on stand in other characters only.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The reflected generator polynomial of crc32 (a fixed value).
_POLYNOMIAL = 0xEDB88320
BUCKETS = 10_000


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """GF(2) products of a 32 x 32 ``matrix`` (columns as words) with ``vectors`` (words)."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def shift_table(power: int) -> np.ndarray:
    """The matrix that appends ``2 ** power`` zero bytes to a crc, as its products with each value of each of the four bytes."""
    if power == 0:
        one_bit = np.array([_POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
        matrix = one_bit
        for _ in range(3):
            matrix = _times(matrix, matrix)
    else:
        before = shift_table(power - 1)
        matrix = _shifted(before, np.array([before[k // 8, 1 << k % 8] for k in range(32)], np.uint32))
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, values << np.uint32(8 * k)) for k in range(4)])


def _shifted(products: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return products[0, crcs & 255] ^ products[1, crcs >> 8 & 255] ^ products[2, crcs >> 16 & 255] ^ products[3, crcs >> 24]


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each first string followed by the second one, whose ``length`` is in bytes."""
    out, power = first.astype(np.uint32), 0
    while (length >> power).any():
        odd = np.flatnonzero(length >> power & 1)
        out[odd] = _shifted(shift_table(power), out[odd])
        power += 1
    return out ^ second


def feature_crcs(text: str, longest: int) -> tuple[np.ndarray, int]:
    """crc32 of every run of 1 to ``longest`` words, and the number of words."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    n = len(words)
    each = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    if longest == 1 or n < 2:
        return each, n
    lengths = np.fromiter(map(len, words), np.int64, n)
    space = np.full(n, zlib.crc32(b" "), np.uint32)
    spaced, run, out = combined(space, each, lengths), each, [each]
    for size in range(2, min(longest, n) + 1):
        run = combined(run[:-1], spaced[size - 1 :], lengths[size - 1 :] + 1)
        out.append(run)
    return np.concatenate(out), n


def hashed_features(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_features, buckets (distinct, ascending) and their counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, which, counts = [], [], [], []
            for t in b.column(1):
                crcs, n = feature_crcs(t.as_py(), longest)
                found, times = np.unique(crcs % np.uint32(buckets), return_counts=True)
                words.append(n)
                features.append(len(crcs))
                which.append(found.astype(np.int32))
                counts.append(times)
            ends = pa.array(np.cumsum([0, *map(len, which)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *own]))) for own, kind in ((which, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists], [id_col, "n_words", "n_features", "buckets", "counts"])

    src = docs.select(F.col(id_col).cast("long"), text_or_empty().alias("text"))
    return src.mapInArrow(run, f"{id_col} long, n_words long, n_features long, buckets array<int>, counts array<long>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: one number a bucket reaches the driver."""
    each = features.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source) of every bucket, in doubles."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weigh(features: DataFrame, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_features, weight: the sum of gains over the features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, counts = b.column(3), b.column(4)
            ends = which.offsets.to_numpy().astype(np.int64)
            first = ends[0] if len(ends) else 0
            own = np.concatenate([[0], np.cumsum(gain[which.flatten().to_numpy()] * counts.flatten().to_numpy())])
            weight = own[ends[1:] - first] - own[ends[:-1] - first]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], [id_col, "n_words", "n_features", "weight"])

    return features.select(id_col, "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"{id_col} long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel variate) from the first 32 bits of sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for the documents that are not drawn.

    Of the N documents with ``least_words`` words or more the floor(``percent`` * N / 100) highest scores are drawn, ties to
    the smaller doc_id.  The counts by bucket (``buckets`` numbers) are all that the driver sees of the corpus; places come
    from range partitions, so no task sees all scores.
    """
    features = materialise(hashed_features(docs, longest, buckets), "features")
    aim = bucket_counts(hashed_features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), buckets)
    gain = gains(aim, bucket_counts(features, buckets))
    scored = weigh(features, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    keep = lambda df: materialise(df, "scored")
    # rows below the least number of words stand after all others
    order = [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = with_places(scored, order, keep)
    n = features.where(F.col("n_words") >= least_words).count()
    drawn = (F.col("n_words") >= least_words) & (F.col("place") < percent * n // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of each distinct word by its table of 256 remainders, which the first query makes from the polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
used AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM docs) GROUP BY ALL),
every AS (SELECT w FROM used UNION SELECT w FROM aim),
bucket AS (
  SELECT w, xor(list_reduce(list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::UBIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS b
  FROM every, tab),
source AS (SELECT b, sum(n) AS s FROM used JOIN bucket USING (w) GROUP BY b),
goal AS (SELECT b, count(*) AS t FROM aim JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM source) + 10000)::DOUBLE
      / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM goal) + 10000)::DOUBLE)))::BIGINT AS g
  FROM source FULL JOIN goal USING (b)),
weighed AS (
  SELECT doc_id, len(words) AS n_features, coalesce((SELECT sum(u.n * g.g) FROM used u JOIN bucket USING (w) JOIN gain g USING (b) WHERE u.doc_id = d.doc_id), 0)::BIGINT AS weight
  FROM docs d),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN n_features >= 20 AND r <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN r END AS rank
FROM ranked
"""
