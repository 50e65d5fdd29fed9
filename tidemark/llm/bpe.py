"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The model's pieces are the vocabulary's byte strings, each byte written as one printable character; a piece's
score is its negative rank, so that sentencepiece merges in rank order; normalisation is the identity.  Ids are
ranks.  Pre-tokens are encoded one by one, decoding is the inverse mapping of ids to byte strings.

Null text counts as empty and has no ids.  Rows are kept one to one, repeated ones and null ids included.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import text_or_empty
from tidemark.llm.tokens import PieceEncoder

RANK_FILE = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A distinct printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is the byte string of rank i, the unknown piece comes last."""
    letters = byte_characters()
    by_rank = sorted(ranks, key=ranks.get)
    out = []
    for rank, piece in enumerate(by_rank):
        name = "".join(letters[b] for b in piece).encode()
        out.append(_bytes(1, _bytes(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1)))
    unknown = len(by_rank)
    out.append(_bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    none = (1 << 64) - 1  # -1 as a varint: no such piece
    trainer = _number(3, 2) + _number(4, unknown + 1) + _number(40, unknown) + _number(41, none) + _number(42, none) + _number(43, none)
    normalizer = _bytes(1, b"identity") + _bytes(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _bytes(2, trainer) + _bytes(3, normalizer)


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.translate = dict(enumerate(byte_characters()))
        self.strings = sorted(self.ranks, key=self.ranks.get)
        self.pieces = PieceEncoder(self.encode_words)
        self.lengths = np.array([len(x) for x in self.strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(self.strings), np.uint8)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        raw = [w.encode() for w in words]
        ids = self.processor.encode([w.decode("latin-1").translate(self.translate) for w in raw], num_threads=1)
        rank = self.ranks.get
        return [[whole] if (whole := rank(w)) is not None else own for w, own in zip(raw, ids)]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pieces.encode(text), "<u2")

    def decode(self, ids: np.ndarray) -> bytes:
        """The byte strings of ``ids``, joined; gathered at once from the flat table of all strings."""
        if not len(ids):
            return b""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.starts[ids] - (ends - length), length) + np.arange(ends[-1])
        return self.flat[at].tobytes()


_loaded: dict[str, ByteBpe] = {}


def codec(path: str | None = None) -> ByteBpe:
    path = path or public_tokenizers.path(RANK_FILE)
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    src = docs.select("doc_id", text_or_empty().alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, bytes: the inverse of :func:`encode`; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for b in batches:
            out = [c.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: each text encoded, its ids decoded, both digested in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file)
        for b in batches:
            n, a, d, size = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                back = c.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                size.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    src = docs.select("doc_id", text_or_empty().alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("n_bytes"))
