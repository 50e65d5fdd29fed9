"""systemd journal files: header, objects and entries of the regular and the compact layout."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.text import PARSED, metadata_path

#: Fixed values of the file format.
SIGNATURE = b"LPKSHHRH"
LEAST_HEADER = 144
DATA, ENTRY = 1, 3
XZ, LZ4, ZSTD = 1, 2, 4
COMPACT = 1 << 4
KNOWN_FLAGS = 0b11111


class BadJournal(ValueError):
    """A file that cannot be read without guessing."""


class Journal:
    def __init__(self, data: bytes):
        if len(data) < LEAST_HEADER:
            raise BadJournal(f"{len(data)} bytes are too few for a journal header")
        if data[:8] != SIGNATURE:
            raise BadJournal("not a journal file")
        (flags,) = struct.unpack_from("<I", data, 12)
        if flags & ~KNOWN_FLAGS:
            raise BadJournal(f"unknown incompatible flags {flags & ~KNOWN_FLAGS:#x}")
        (self.begin,) = struct.unpack_from("<Q", data, 88)
        (self.tail,) = struct.unpack_from("<Q", data, 136)
        if not LEAST_HEADER <= self.begin <= len(data):
            raise BadJournal(f"header size {self.begin} is impossible")
        self.data, self.compact = data, bool(flags & COMPACT)

    def header(self, at: int) -> tuple[int, int, int]:
        """Type, flags and size of the object at an offset."""
        if at + 16 > len(self.data):
            raise BadJournal(f"object at {at}: the file ends before its header")
        kind, flags, size = struct.unpack_from("<BB6xQ", self.data, at)
        if size < 16 or at + size > len(self.data):
            raise BadJournal(f"object at {at}: impossible size {size}")
        return kind, flags, size

    def entries(self) -> Iterator[dict[str, str]]:
        """The fields of every entry, in file order."""
        at = -(-self.begin // 8) * 8
        while self.tail and at <= self.tail:
            kind, _, size = self.header(at)
            if kind == ENTRY:
                yield self.entry(at, size)
            at = -(-(at + size) // 8) * 8

    def entry(self, at: int, size: int) -> dict[str, str]:
        if size < 64:
            raise BadJournal(f"entry at {at}: too small")
        seqnum, realtime, monotonic = struct.unpack_from("<QQQ", self.data, at + 16)
        shape = struct.Struct("<I" if self.compact else "<Q8x")
        area = self.data[at + 64 : at + size]
        if len(area) % shape.size:
            raise BadJournal(f"entry at {at}: {len(area)} bytes are no whole number of items")
        fields = dict(self.field(offset) for (offset,) in shape.iter_unpack(area))
        return fields | {"__REALTIME_TIMESTAMP": str(realtime), "__MONOTONIC_TIMESTAMP": str(monotonic), "__SEQNUM": str(seqnum)}

    def field(self, at: int) -> tuple[str, str]:
        kind, flags, size = self.header(at)
        if kind != DATA:
            raise BadJournal(f"object at {at} is no data object but of type {kind}")
        begin = at + (72 if self.compact else 64)
        if begin > at + size:
            raise BadJournal(f"data object at {at}: too small")
        payload = self.data[begin : at + size]
        if flags & LZ4:
            try:
                (length,) = struct.unpack_from("<Q", payload)
                payload = pa.decompress(payload[8:], decompressed_size=length, codec="lz4_raw").to_pybytes() if length else b""
            except (struct.error, OSError, pa.ArrowException, OverflowError) as e:
                raise BadJournal(f"data object at {at}: LZ4: {e}") from None
        elif flags & (XZ | ZSTD):
            # the name is inside the payload, so the gap gets a name of its own
            return f"_UNSUPPORTED_COMPRESSED_FIELD@{at}", f"<{'XZ' if flags & XZ else 'ZSTD'}-compressed field, {len(payload)} bytes, not decompressed>"
        name, equals, value = payload.decode("utf-8", "replace").partition("=")
        if not equals:
            raise BadJournal(f"data object at {at}: no '=' in its payload")
        return name, value


def read_journals(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """:data:`PARSED` rows of journal files (source id, path); a file that cannot be read gives one row with its error.

    Objects point anywhere in a file, so a file is read whole by one task; journald itself keeps files below 128 MB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in b.itertuples(index=False):
                rows = []
                try:
                    for seq, e in enumerate(Journal(content).entries()):
                        text = json.dumps(e, ensure_ascii=False, separators=(",", ":"))
                        at = datetime(1970, 1, 1) + timedelta(microseconds=int(e["__REALTIME_TIMESTAMP"]))
                        rows.append((source, seq, at, e.get("PRIORITY"), e.get("MESSAGE"), text, text, None))
                except (BadJournal, OverflowError) as e:
                    rows = [(source, 0, None, None, None, "", None, str(e))]
                yield pd.DataFrame(rows, columns=["event_id_source", "event_id_seq", "timestamp_utc", "level", "message", "raw", "fields", "error"]).astype({"timestamp_utc": "datetime64[us]"})

    names = spark.createDataFrame([(i, metadata_path(spark, p)) for i, p in files], "event_id_source string, _path string")
    content = spark.read.format("binaryFile").load([p for _, p in files]).select(F.col("_metadata.file_path").alias("_path"), "content")
    return content.join(F.broadcast(names), "_path").select("event_id_source", "content").mapInPandas(run, PARSED)
