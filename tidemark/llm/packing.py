"""Packing of token streams into windows by bounded-space online best fit.

A document is its ids and the end id 0.  Whole windows are cut off its front; the rest goes to the open window with the
least room that still holds it.  Each partition has a fixed number of open windows: if none fits and all are open, the
fullest is emitted.  The windows open at a partition's end are leftovers: they carry their ids, and those of ``group``
partitions (at most ``group`` * ``open_windows`` windows, whatever the input) are laid end to end and cut into full
windows; one partly filled window remains for each such group.

Every piece carries its ids, so the pieces of a sequence in order of offset are the sequence.

Null text counts as empty: one piece with the end id.  Repeated rows and null ids are packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import materialise, text_or_empty
from tidemark.llm.tokens import hub_encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
#: Ids of merged windows start here; those of a partition's windows are partition * 2**33 + n.
_MERGED = 1 << 62


def crc(ids: bytes) -> int:
    """crc32 of 16-bit ids widened to 32 bits."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


class Packer:
    """Open windows of one partition; ``add`` yields the finished pieces, ``left`` what is open at the end."""

    def __init__(self, partition: int, window: int, open_windows: int):
        self.window, self.most, self.next, self.open = window, open_windows, partition << 33, []

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        size, total, at = self.window, len(ids) // 2, 0
        while total - at >= size:
            part = ids[2 * at : 2 * (at + size)]
            yield (doc_id, at, size, crc(part), total, self._number(), 0, part)
            at += size
        need = total - at
        if not need:
            return
        fits = [w for w in self.open if w[0] >= need]
        if fits:
            best = min(fits, key=lambda w: w[0])
        else:
            if len(self.open) == self.most:
                fullest = min(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                yield from self._close(fullest)
            best = [size, self._number(), []]
            self.open.append(best)
        best[0] -= need
        best[2].append((doc_id, at, ids[2 * at :], total))
        if not best[0]:
            self.open.remove(best)
            yield from self._close(best)

    def _close(self, w: list) -> Iterator[tuple]:
        offset = 0
        for doc_id, at, ids, total in w[2]:
            yield (doc_id, at, len(ids) // 2, crc(ids), total, w[1], offset, ids)
            offset += len(ids) // 2

    def left(self) -> Iterator[tuple]:
        for w in sorted(self.open, key=lambda w: w[1]):
            offset = 0
            for doc_id, at, ids, total in w[2]:
                yield (doc_id, at, len(ids) // 2, None, total, w[1], offset, ids)
                offset += len(ids) // 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    cols = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _FIELDS)


def cut_leftovers(table: pa.Table, group: int, window: int) -> pa.Table:
    """Lay the pieces of leftover windows end to end, in order of window and offset, and cut them into windows."""
    rows, seq, used = [], _MERGED + (group << 31), 0
    for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
        ids, at = r["ids"], 0
        while at < r["length"]:
            n = min(r["length"] - at, window - used)
            part = ids[2 * at : 2 * (at + n)]
            rows.append((r["doc_id"], r["start"] + at, n, crc(part), r["doc_tokens"], seq, used, part))
            at, used = at + n, used + n
            if used == window:
                seq, used = seq + 1, 0
    return pa.Table.from_batches([_batch(rows)])


def pack(docs: DataFrame, window: int = 1024, open_windows: int = 32, group: int = 8, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 16-bit little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = hub_encoder(tokenizer, 3_000_000), Packer(TaskContext.get().partitionId(), window, open_windows)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for k, ids, n in encoder.streams(b.column(1)):
                rows, raw, ends = [], ids.tobytes(), (2 * np.cumsum(n)).tolist()
                for doc_id, begin, end in zip(doc_ids[k:], [0, *ends], ends):
                    rows += packer.add(doc_id, raw[begin:end])
                yield _batch(rows)
        yield _batch(list(packer.left()))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return cut_leftovers(table, key[0].as_py(), window)

    src = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    placed = materialise(src.mapInArrow(run, PIECE), "pieces", "4m")
    left = placed.where("ids_crc32 is null").groupBy(F.floor(F.shiftright("sequence_id", 33) / group).alias("g")).applyInArrow(merge, PIECE)
    return placed.where("ids_crc32 is not null").unionByName(left)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
