"""An index of byte trigrams: which files, and which stretches of entries in them, a text term can match.

A load writes, beside its entries, the distinct trigrams of message and raw of each block of :data:`BLOCK` entries of a
file, sorted by trigram, so that a search reads the row groups of its own trigrams only.  A block has a match at most if
it has all trigrams of the literals that a match must hold (:mod:`tidemark.operators.required`).  A search then reads the
files with such blocks; where the blocks are few, it also asks for their stretches of entry numbers, which the scan skips
row groups and pages by.  The terms themselves are still tested, so the index decides what is read, never what is found.
Files without an index (streams, loads without one) are always read.

The index holds about as many numbers as its blocks have distinct trigrams, a few in a hundred of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.required import Need, literals, trigrams

#: Entries of a block, by their numbers.
BLOCK = 16_384
#: Blocks up to which their stretches are asked for; more are found by their files.
STRETCHES = 128
#: Trigrams of a query that are looked up: a bit of a long each.
MOST_GRAMS = 62
GRAMS = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("file", T.LongType()), T.StructField("block", T.LongType())])
FILES = T.StructType([T.StructField("file", T.LongType()), T.StructField("path", T.StringType()), T.StructField("source", T.StringType())])


def _file_name(path: Column) -> Column:
    """The part of a path below the table; the names of part files alone repeat in the folders of sources."""
    return F.regexp_extract(path, r"/(load=.*)$", 1)


def _distinct_trigrams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Trigrams of texts that stand one after the other; none goes over the end of a text."""
    if len(data) < 3:
        return np.empty(0, np.int32)
    wide = data.astype(np.int32)
    grams, valid = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:], np.ones(len(data), bool)
    for back in (1, 2):
        at = ends - back
        valid[at[at >= 0]] = False
    return np.unique(grams[valid[: len(grams)]])


def _of_column(column: pa.Array, a: int, z: int) -> np.ndarray:
    part = column.slice(a, z - a).cast(pa.large_binary())
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = part.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return _distinct_trigrams(raw, offsets[1:] - offsets[0])


def _trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, file, block of rows that come file by file in the order of their numbers."""
    for b in batches:
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            if a < z:
                grams = np.union1d(_of_column(b.column(2), a, z), _of_column(b.column(3), a, z)).astype(np.int32)
                file, block = (np.full(len(grams), key[k, a]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(file), pa.array(block)], ["gram", "file", "block"])


def write(session, load: str, schema: T.StructType) -> None:
    """The index of the entries (``schema``) of a load that is under way."""
    entries = session.spark.read.schema(schema).parquet(session.folder("log_entries", load))
    path = F.col("_metadata.file_path")
    rows = entries.select(F.xxhash64(_file_name(path)).alias("file"), F.floor(F.col("event_id_seq") / BLOCK).alias("block"), F.coalesce("message", F.lit("")).alias("message"), F.coalesce("raw", F.lit("")).alias("raw"))
    grams = rows.mapInArrow(_trigram_rows, GRAMS).distinct()
    grams.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file", "block").write.parquet(session.folder("ngrams", load))
    files = entries.select(path.alias("path"), F.col("event_id_source").alias("source")).distinct()
    files.select(F.xxhash64(_file_name(F.col("path"))).alias("file"), "path", "source").coalesce(1).write.parquet(session.folder("ngram_files", load))


def _chosen(need: Need) -> dict[bytes, list[int]]:
    """Trigrams of each literal, :data:`MOST_GRAMS` in all at most; fewer ask for less."""
    found = {x: trigrams(x) for x in literals(need)[:MOST_GRAMS]}
    share = max(1, MOST_GRAMS // max(1, len(found)))
    return {x: g if len(g) <= share else [g[k * len(g) // share] for k in range(share)] for x, g in found.items()}


def _holds(need: Need, masks: dict[bytes, int]) -> Column | None:
    """Whether the bits of a block's trigrams allow a match; None if every block does."""
    if isinstance(need, bytes):
        return (F.col("bits").bitwiseAND(F.lit(masks[need])) == F.lit(masks[need])) if need in masks else None
    parts = [_holds(n, masks) for n in need[1]]
    if need[0] == "any" and any(p is None for p in parts):
        return None
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p if need[0] == "all" else out | p
    return out


@dataclass
class Pruned:
    """Entries that a requirement leaves, and how much of the data that is."""

    entries: DataFrame
    files: int
    files_read: int
    stretches: int | None


class NgramIndex:
    """The index of a session's committed loads."""

    def __init__(self, session, schema: T.StructType):
        self.session, self.schema = session, schema

    def blocks(self, need: Need) -> DataFrame | None:
        """file, block: the blocks that can match; None if the requirement rules out none."""
        chosen = _chosen(need)
        order = sorted({g for gs in chosen.values() for g in gs})
        bit = {g: 1 << k for k, g in enumerate(order)}
        masks = {x: sum(bit[g] for g in gs) for x, gs in chosen.items()}
        holds = _holds(need, masks) if need is not None else None
        if holds is None:
            return None
        grams = self.session.loaded("ngrams", GRAMS).where(F.col("gram").isin(order))
        bits = F.element_at(F.create_map(*[F.lit(x) for g in order for x in (g, bit[g])]), F.col("gram"))
        return grams.groupBy("file", "block").agg(F.bit_or(bits).alias("bits")).where(holds).select("file", "block")

    def prune(self, need: Need) -> Pruned | None:
        """The entries in files (and stretches) that can match; None if nothing is known about the query.

        What reaches the driver are names of files, as for any scan of them, and up to :data:`STRETCHES` stretches.
        """
        blocks = self.blocks(need)
        if blocks is None:
            return None
        s = self.session
        known = s.loaded("ngram_files", FILES)
        below = lambda path: path.rsplit("/load=", 1)[1]
        indexed = {below(r.path) for r in known.select("path").collect()}
        everything = s.loaded("log_entries", self.schema).inputFiles()
        unknown = [f for f in everything if below(f) not in indexed]
        found = blocks.join(known, "file").groupBy("path", "source").agg(F.array_sort(F.slice(F.collect_set("block"), 1, STRETCHES + 1)).alias("blocks")).collect()
        read = [*unknown, *(r.path for r in found)]
        if not read:
            return Pruned(s.spark.createDataFrame([], self.schema), len(everything), 0, 0)
        base = f"{s.path}/log_entries"
        rows = s.spark.read.schema(self.schema).option("basePath", base).parquet(*map(unquote, read)).select(*self.schema.names)
        stretches = None
        if not unknown and sum(len(r.blocks) for r in found) <= STRETCHES:
            wanted = None
            each = sorted({(r.source, b) for r in found for b in r.blocks})
            for source, block in each:
                one = (F.col("event_id_source") == source) & F.col("event_id_seq").between(block * BLOCK, (block + 1) * BLOCK - 1)
                wanted = one if wanted is None else wanted | one
            rows, stretches = rows.where(wanted), len(each)
        return Pruned(rows, len(everything), len(read), stretches)
