"""A content-addressed store of token ids.

A rolling hash over the last 16 ids cuts a document's id stream (its ids and the end id 0) into chunks whose borders
depend on content alone, so shared passages become shared chunks.  The store is a folder:

* ``chunks/``: digest (SHA-256 of ``data``), n, data (16-bit little-endian ids); each distinct chunk once;
* ``recipes/``: doc_id, part, row (a number), digests, lengths, n_tokens, root, in ascending order of doc_id (nulls first);
* ``parts/``: part, first (ids of all earlier parts), n_tokens, docs: one row for each recipe part.

A document's manifest is the Merkle root of its chunk digests.  Reading back
re-hashes every stored chunk, recomputes every root, and joins recipes with chunks by digest.  A document's crc32 is
combined from its chunks' crc32, so no ids are shuffled for it.

Null text counts as empty: one chunk with the end id.  Repeated rows are documents of their own with equal chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._base import materialise, new_path, text_or_empty, write
from tidemark.llm.tokens import hub_encoder

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def rolling_hits(ids: np.ndarray, mean: int) -> np.ndarray:
    """Ends of chunks asked for by content: after each id where the hash of the last 16 ids is below 2**64 / mean."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + h[:-step] * np.uint64(pow(_MULTIPLIER, step, 1 << 64)) if len(h) > step else h[step:]
    return np.flatnonzero(h < np.uint64(_MASK // mean)) + 1


def limited(hits: list[int], length: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``length`` ids: the ``hits`` that leave ``least`` ids, and wherever ``most`` ids have gone by."""
    ends, begin = [], 0
    for end in [*hits, length]:
        while end - begin > most:
            begin += most
            ends.append(begin)
        if end - begin >= least or end == length > begin:
            begin = end
            ends.append(end)
    return ends


def cut_points(ids: np.ndarray, mean: int, least: int, most: int) -> list[int]:
    """Ends of a document's chunks. With ``least`` of 16 or more no cut depends on ids before the document."""
    return limited(rolling_hits(ids, mean).tolist(), len(ids), least, most)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a partner moves up, no leaves give 32 zero bytes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [bytes(32)]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) & ~1 :]
    return level[0]


#: Bits of each byte.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)


class CrcJoin:
    """crc32 of joined byte strings from the crc32 of each and the lengths (the linear map of a length is kept)."""

    def __init__(self):
        self.tables: dict[int, list[list[int]]] = {}

    def _table(self, length: int) -> list[list[int]]:
        if length not in self.tables:
            # crc32 is affine: what each starting bit becomes after ``length`` zero bytes
            zeros = bytes(length)
            base = zlib.crc32(zeros)
            columns = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.int64).reshape(4, 1, 8)
            self.tables[length] = np.bitwise_xor.reduce(np.where(_BITS, columns, 0), axis=2).tolist()
        return self.tables[length]

    def join(self, parts: Iterator[tuple[int, int]]) -> int:
        total = 0
        for crc, length in parts:
            a, b, c, d = self._table(length)
            total = a[total & 255] ^ b[total >> 8 & 255] ^ c[total >> 16 & 255] ^ d[total >> 24] ^ crc
        return total


_crc = CrcJoin()  # its tables are shared by the tasks of a worker


def build(docs: DataFrame, mean: int = 512, least: int = 64, most: int = 2048, tokenizer: str | None = None) -> str:
    """Write the store of ``docs`` and return its path; ``least`` is 16 at least."""
    if least < 16:
        raise ValueError("chunks of fewer than 16 ids would depend on what stands before a document")
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hub_encoder(tokenizer)
        for b in batches:
            digests, starts, lengths, data, roots, sizes = [], [], [], [], [], []
            for _, ids, n in encoder.streams(b.column(1)):
                stops = np.cumsum(n)
                hits = rolling_hits(ids, mean)
                split = np.searchsorted(hits, np.concatenate([[0], stops]), "right").tolist()
                stream, hits, begin = ids.tobytes(), hits.tolist(), 0
                for stop, x, y in zip(stops.tolist(), split, split[1:]):
                    raw = stream[2 * begin : 2 * stop]
                    ends = limited([h - begin for h in hits[x:y]], stop - begin, least, most)
                    begins = [0, *ends[:-1]]
                    own = [hashlib.sha256(raw[2 * a : 2 * z]).digest() for a, z in zip(begins, ends)]
                    digests.append(own)
                    starts.append(begins)
                    lengths.append([z - a for a, z in zip(begins, ends)])
                    data.append(raw)
                    roots.append(merkle_root(own))
                    sizes.append(stop - begin)
                    begin = stop
            cols = [b.column(0), pa.array(digests, pa.list_(pa.binary())), pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(sizes, pa.int64()), pa.array(roots, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digests", "begins", "lengths", "n_tokens", "root", "data"])

    src = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    staged = materialise(src.mapInArrow(run, "doc_id long, digests array<binary>, begins array<int>, lengths array<int>, n_tokens long, root binary, data binary"), "staged")
    path = new_path(spark, "store")

    cut = staged.select("data", F.explode(F.arrays_zip("digests", "begins", "lengths")).alias("c"))
    cut = cut.select(F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"), F.expr("substring(data, 2 * c.begins + 1, 2 * c.lengths)").alias("data"))
    write(cut.dropDuplicates(["digest"]), f"{path}/chunks")

    recipes = staged.drop("data", "begins").orderBy("doc_id", "root").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    write(recipes, f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, root: every document of a store, from its files.

    ``verified``: all its chunks are there, hash to their digests and have their lengths, and the root is that of its digests.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            at = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))]).tolist()
            raw = b"".join(column.to_pylist())
            wide, raw = memoryview(np.frombuffer(raw[: len(raw) & ~1], "<u2").astype("<u4").tobytes()), memoryview(raw)
            digests, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            good = [hashlib.sha256(raw[x:y]).digest() == d and y - x == 2 * n for x, y, d, n in zip(at, at[1:], digests, sizes)]
            crcs = [zlib.crc32(wide[2 * x : 2 * y]) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64()), pa.array(good)], ["digest", "crc", "good"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            parts = lists.flatten()
            order = np.lexsort((parts.field("pos").to_numpy(), np.repeat(np.arange(len(lists)), np.diff(at))))
            digests = parts.field("digest").take(pa.array(order)).to_pylist()
            crcs, sizes = (parts.field(f).fill_null(0).to_numpy()[order].tolist() for f in ("crc", "n"))
            good = parts.field("good").to_numpy(zero_copy_only=False)[order]
            out, fine, edges = [], [], at.tolist()
            for a, z, root in zip(edges, edges[1:], b.column(4).to_pylist()):
                out.append(_crc.join(zip(crcs[a:z], [4 * n for n in sizes[a:z]])))
                fine.append(bool(good[a:z].all()) and merkle_root(digests[a:z]) == root)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64()), pa.array(fine), b.column(4)], ["doc_id", "start", "n_tokens", "ids_crc32", "verified", "root"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "n", "data").mapInArrow(check, "digest binary, crc long, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes").join(F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "first")), "part")
    before = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    each = placed.select("doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("digests", "lengths")).alias("pos", "c"))
    each = each.select("doc_id", "start", "n_tokens", "root", "pos", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"))
    joined = each.join(chunks, "digest", "left")
    # every document has an id at least, so its start is its own
    rows = joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("pos", "digest", "n", "crc", F.coalesce("good", F.lit(False)).alias("good"))).alias("chunks"))
    return rows.select("doc_id", "start", "n_tokens", "chunks", "root").mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean, root binary")


def reconstruct(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (binary, 16-bit little-endian): the id stream of every document whose doc_id is in ``wanted``.

    An id of several rows gives one stream for each; null ids are found by a null.
    """
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    recipes = spark.read.parquet(f"{path}/recipes").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    each = recipes.select("row", "doc_id", F.posexplode("digests").alias("pos", "digest")).join(spark.read.parquet(f"{path}/chunks"), "digest")
    parts = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("p"))
    # Latin-1 has a character for each byte, so that text functions join the bytes in one pass
    joined = F.array_join(F.transform("p", lambda x: F.decode(x["data"], "ISO-8859-1")), "")
    return parts.select("doc_id", F.encode(joined, "ISO-8859-1").alias("ids"))


def op8_content_store(spark, sf_dir: str) -> DataFrame:
    path = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified", F.lower(F.hex("root")).alias("merkle_root"))
