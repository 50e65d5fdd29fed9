"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one space (null counts as
empty); equality is that of the SHA-256 of the normalised UTF-8 text.  Of equal texts the smallest doc_id stays; null
ids are larger than any other, and rows that repeat id and text all report the same decision.

Each partition keeps a Misra-Gries summary of ``counters`` digests, summaries add up, and the digests whose sum exceeds
rows / (counters + 1) are candidates: at most ``counters`` + 1 of them, among them every digest with more than twice that
many rows.  Their exact counts and winners are verified by a grouped count and broadcast, so no row of a hot group is
shuffled; all other digests are grouped and joined by an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import materialise, sized, text_hash, text_or_empty, unpacked, without_rows

SPACE_RUN = r"[\x20\x09-\x0D]+"


def digest_column(text_col: str = "text") -> Column:
    return F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " "), 256)


def absorb(summary: Counter, counts: Counter, counters: int) -> Counter:
    """Merge exact ``counts`` into a Misra-Gries ``summary``: add, then take the counter after the last kept one off all."""
    summary.update(counts)
    if len(summary) > counters:
        cut = sorted(summary.values(), reverse=True)[counters]
        summary = Counter({k: v - cut for k, v in summary.items() if v > cut})
    return summary


def frequent_candidates(each: DataFrame, counters: int = 1024) -> DataFrame:
    """digest: at most ``counters`` + 1 digests of ``each``, with all that hold over 2 * rows / (counters + 1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            summary = absorb(summary, Counter(b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array([None, *summary], pa.string()), pa.array([rows, *summary.values()], pa.int64())], ["digest", "n"])

    sums = materialise(each.select("digest").mapInArrow(run, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n")), "summary")
    rows = sums.where("digest is null").agg(F.sum("n")).first()[0] or 0
    return sums.where("digest is not null").where(F.col("n") > F.lit(rows / (counters + 1))).select("digest")


def resolve(docs: DataFrame, counters: int = 1024, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the columns ``carry``: one row per row of ``docs``."""
    each = materialise(docs.select("doc_id", digest_column().alias("digest"), *carry), "digests")
    found = frequent_candidates(each, counters)
    decide = (F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = each.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(*decide)
    winners = F.broadcast(materialise(winners, "winners"))
    hot = each.join(winners, "digest")
    rest = each.join(winners, "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*decide), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"), *carry)


def drop_copies(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id; of rows that repeat id and text, that of the smallest hash over all columns.

    Only ids and hashes are shuffled, and the rows (rare, it is hoped) that repeat id and text.
    """
    named = docs.withColumn("text_hash", text_hash()).select("doc_id", "text", "text_hash")
    decided = materialise(resolve(named, counters, ["text_hash"]), "decided")
    gone = materialise(decided.where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "gone")
    # one id with several kept rows: equal but for their white space
    kept = decided.where("kept")
    repeated = kept.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    several = kept.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left_semi")
    several = materialise(several.select("doc_id", "text_hash").distinct(), "several")
    left = without_rows(docs, gone)
    rows = left.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), text_hash().alias("_hash"))
    known = sized(several.select(F.col("doc_id").alias("_many_id"), F.col("text_hash").alias("_many_hash")))
    many = rows.join(known, F.col("_id").eqNullSafe(F.col("_many_id")) & (F.col("_hash") == F.col("_many_hash")), "left_semi")
    one = many.groupBy("_id", digest_column("row.text").alias("_sha")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return without_rows(left, several).unionByName(unpacked(one, docs.columns))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return resolve(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
