"""GIF media columns: payloads stored as 8-bit samples, and media decoded to timed frames with colour histograms.

A payload is a text's UTF-8 bytes (null: none), filled with bytes 255 up to a positive multiple of 576.  It is stored as
the samples of a GIF of 576 columns, 64 rows a frame, over a grey palette; the stored bytes are written to the shared
folder and read back from there.  Media that cannot be decoded has a null payload and no frames; ``error`` says why.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gif
from tidemark.llm._base import materialise, text_or_empty

WIDTH, ROWS, DELAY = 576, 64, 4
#: Bytes of canvases in a batch, and what a broken medium raises.
_BATCH, _BAD = 16 << 20, (ValueError, IndexError, gif.struct.error)


def _error(m: bytes) -> str | None:
    """Why a medium cannot be decoded."""
    try:
        for _ in gif.frames(m):
            pass
    except _BAD as e:
        return str(e)
    return None


def to_gif(raw: bytes) -> bytes:
    padded = raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return gif.encode([(0, 0, rows[k : k + ROWS]) for k in range(0, len(rows), ROWS)], WIDTH, min(ROWS, len(rows)), DELAY)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of each of 4 x 4 x 4 colour cells and, last, undrawn pixels."""
    if not canvas.size:
        return np.zeros(65, np.int64)
    c = canvas >> 6
    cell = (c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]).astype(np.int64)
    return np.bincount(np.where(canvas[..., 3] == 0, 64, cell).ravel(), minlength=65)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): the GIF of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(to_gif, raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialise(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_cs, delay_cs, left, top, width, height, disposal, transparent, histogram, rgba (the canvas as shown)."""
    names = [id_col, "frame", "start_cs", "delay_cs", "left", "top", "width", "height", "disposal", "transparent", "histogram", "rgba"]
    kinds = [pa.int64()] * 10 + [pa.list_(pa.int64()), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(*b.columns):
                # a medium that fails has no frames at all: look before the first is sent
                m = m.as_py() or b""
                if _error(m) is not None:
                    continue
                rows, size, start = [], 0, 0
                for k, f in enumerate(gif.frames(m)):
                    h, w = f.samples.shape
                    rows.append((i.as_py(), k, start, f.delay, f.left, f.top, w, h, f.disposal, f.transparent, histogram(f.canvas).tolist(), f.canvas.tobytes()))
                    start, size = start + f.delay, size + f.canvas.nbytes
                    if size > _BATCH:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = f"{id_col} long, " + ", ".join(f"{n} long" for n in names[1:10]) + ", histogram array<long>, rgba binary"
    return media.select(F.col(id_col).cast("long"), media_col).mapInArrow(run, schema)


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, histogram, error from the stored bytes.

    ``feature`` has frames, total time in 1/100 s, and the non-empty cells of the summed colour histogram.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "histogram", "error"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def one(m: bytes) -> tuple:
        """Frame by frame: one canvas is held, whatever the length."""
        stored = len(m), hashlib.sha256(m).hexdigest()
        size, sha, tail, count, time, h = 0, hashlib.sha256(), b"", 0, 0, np.zeros(65, np.int64)
        try:
            for f in gif.frames(m):
                part = f.samples.tobytes()
                sha.update(part)
                size, tail, count, time, h = size + len(part), (tail + part[-32:])[-32:], count + 1, time + f.delay, h + histogram(f.canvas)
        except _BAD as e:
            return (None, None, None, *stored, None, None, str(e))
        feature = f"frames={count};cs={time};" + ",".join(f"{k}:{n}" for k, n in enumerate(h.tolist()) if n)
        return (size, sha.hexdigest(), zlib.crc32(tail), *stored, feature, h.tolist(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i.as_py(), n.as_py(), *one(m.as_py() or b"")) for i, n, m in zip(*b.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 10, kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, histogram array<long>, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op5_gif_media(spark, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("histogram", "error")
