"""Byte-level BPE ids of whole texts by the ``tokenizers`` library, with a bounded memo of text pieces.

A space that stands before a non-space always begins a new pre-token of the GPT-2 pattern, whatever stands
around it.  Text is therefore cut at those spaces and each distinct piece is encoded once per worker.  The
memo only saves work: it is emptied when full and never changes a result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A space before white space or at the end of the text, where a plain split at spaces would be wrong.
_LOOSE = re.compile(r" (?=\s|\Z)")
#: The same for RE2; a NUL is the mark of further cuts.
_LOOSE_RE2 = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)|\x00"
_CUT = re.compile(r"(?= (?=\S))")


@cache
def differing_characters() -> dict[int, str]:
    """Code points that the ``regex`` library and tiktoken class differently, each with a character that both class as tiktoken does.

    The two libraries follow different Unicode versions.  tiktoken drops what its pattern does not match, so a
    vocabulary of single bytes and a pattern of one class show which characters it has in that class.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single, out = {bytes([b]): b for b in range(256)}, {}
    theirs, ours = {}, {}
    for name, stands in (("\\p{L}", "a"), ("\\p{N}", "1"), ("\\s", "\t")):
        found = bytes(tiktoken.Encoding(name, pat_str=f"{name}+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        theirs |= dict.fromkeys(found, stands)
        ours |= dict.fromkeys("".join(regex.findall(f"{name}+", every)), stands)
    for c in theirs.keys() | ours.keys():
        if theirs.get(c) != ours.get(c):
            out[ord(c)] = theirs.get(c, "!")
    return out


class Splitter:
    """Pre-tokens of a text by the GPT-2 pattern, with the character classes that tiktoken has."""

    def __init__(self):
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.stands = differing_characters()
        self.differs = frozenset(map(chr, self.stands))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.differs.isdisjoint(text):
            return self.pattern.findall(text)
        # one character stands for one, so the places of the matches are those of the text
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stands))]


class _Memo(dict):
    """Bytes by string, of a bounded number of bytes: emptied when full, and without strings of over ``LONGEST`` characters."""

    LONGEST, OVERHEAD = 64, 160

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0

    def learn(self, found: dict[str, bytes]) -> None:
        short = {k: v for k, v in found.items() if len(k) <= self.LONGEST}
        more = sum(4 * len(k) + len(v) + self.OVERHEAD for k, v in short.items())
        if self.size + more > self.most:
            self.clear()
            self.size = 0
        if more <= self.most:
            self.update(short)
            self.size += more


class PieceEncoder:
    """ids of a text as little-endian unsigned 16-bit bytes (the vocabulary has fewer than 65,536 ids).

    ``encode_words(list of pre-tokens) -> list of id lists`` is the library underneath.  Special-token strings
    in a text are ordinary text.  Three memos of ``memo_bytes`` at most save work and never change a result.
    """

    def __init__(self, encode_words, memo_bytes: int = 80 << 20):
        self.encode_words, self.split = encode_words, Splitter()
        self.words, self.first, self.later = (_Memo(memo_bytes) for _ in range(3))

    def _encode(self, pieces: set[str], lead: str) -> dict[str, bytes]:
        cut = {p: self.split(lead + p) for p in pieces}
        words = self.words
        new = list({w for ws in cut.values() for w in ws if w not in words})
        found = {w: pack("<%dH" % len(ids), *ids) for w, ids in zip(new, self.encode_words(new))}
        out = {p: b"".join([found[w] if w in found else words[w] for w in ws]) for p, ws in cut.items()}
        words.learn(found)
        return out

    def _all(self, memo: _Memo, parts: list[str], lead: str) -> bytes:
        try:
            return b"".join([memo[p] for p in parts])
        except KeyError:
            found = self._encode({p for p in parts if p not in memo}, lead)
            out = b"".join([found[p] if p in found else memo[p] for p in parts])
            memo.learn(found)
            return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _LOOSE.search(text):
            return self._all(self.first, _CUT.split(text), "")
        head, *parts = text.split(" ")
        return (self._all(self.first, [head], "") if head else b"") + self._all(self.later, parts, " ")


class HubEncoder:
    """ids of texts as little-endian unsigned 16-bit integers, by the ``tokenizers`` library.

    The pieces of a slice of texts are cut and numbered by Arrow.  Each distinct piece is encoded once: the distinct
    pieces are joined in groups, encoded in one call and told apart again by the byte lengths of their tokens.  The ids
    of all pieces are then gathered at once.  No Python object is made for a piece.
    """

    def __init__(self, path: str, slice_bytes: int = 16_000_000, group: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.sizes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.slice_bytes, self.group = slice_bytes, group

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct piece with a space before it, one after the other, and where each ends.

        A letter and the punctuation after it, and a line break and what stands before it, are always different
        pre-tokens.  Pieces are cut there, too, and their parts encoded once each.
        """
        marked = pc.replace_substring_regex(distinct, r"(\p{L})([^\p{L}\p{N}\s])", "\\1\0\\2")
        marked = pc.replace_substring_regex(marked, r"([^\s\x00])\x00?(\n)", "\\1\0\\2")
        cut = pc.split_pattern(marked, "\0")
        first = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        parts, part = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        leads = np.zeros(len(part), bool)
        leads[first[:-1]] = True
        # each part in two forms: after a space (at the beginning of a piece), and as it is
        used = np.zeros((2, len(parts)), bool)
        used[0, part[leads]] = used[1, part[~leads]] = True
        begins_line = np.array(pc.match_substring_regex(parts, r"^\n[^\s]").to_numpy(zero_copy_only=False), bool)
        groups = [
            self._joined(parts, np.flatnonzero(used[0]), " "),
            self._joined(parts, np.flatnonzero(used[1] & begins_line), ""),
            self._single(parts, np.flatnonzero(used[1] & ~begins_line)),
        ]
        where = np.full((2, len(parts)), -1, np.int64)
        flat, ends, known = [], [0], 0
        for form, (which, ids, stops) in zip((0, 1, 1), groups):
            where[form, which] = known + np.arange(len(which))
            flat.append(ids)
            ends.extend((ends[-1] + stops).tolist() if len(stops) else [])
            known += len(which)
        flat, ends = np.concatenate(flat), np.array(ends, np.int64)
        place, size = ends[:-1], np.diff(ends)
        own = where[np.where(leads, 0, 1), part]
        return _gathered(flat, place, size, own), np.cumsum(np.add.reduceat(size[own], first[:-1])) if len(distinct) else np.empty(0, np.int64)

    def _joined(self, parts: pa.Array, which: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``which``, the ids of those parts with ``lead`` before each, and where each ends; they are encoded side by side."""
        chosen = parts.take(pa.array(which))
        edges = [*range(0, len(chosen), self.group), len(chosen)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), chosen), lead)
        ids = np.concatenate([np.empty(0, "<u2"), *self._whole([lead + t for t in joined.to_pylist()])])
        lengths = pc.binary_length(chosen).to_numpy(zero_copy_only=False).astype(np.int64) + len(lead)
        return which, ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths), "left") + 1

    def _single(self, parts: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = self._whole(parts.take(pa.array(which)).to_pylist())
        return which, np.concatenate([np.empty(0, "<u2"), *each]), np.cumsum([len(x) for x in each]).astype(np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, one after the other, and the number of ids of each."""
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy().astype(np.int64)
        head = first[:-1]
        coded = cut.values.dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        flat, ends = self._pieces(coded.dictionary)
        heads = self._whole(cut.values.take(pa.array(head)).to_pylist())
        number[head] = len(ends) + np.arange(len(heads))
        flat = np.concatenate([flat, *heads])
        size = np.diff(np.concatenate([[0], ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(h) for h in heads])]))
        place = np.cumsum(size) - size
        total = np.concatenate([[0], np.cumsum(size[number])])
        return _gathered(flat, place, size, number), total[first[1:]] - total[head]

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of ``texts`` (no nulls): the index of the first text, all ids and the number of ids of each text."""
        loose = pc.match_substring_regex(texts, _LOOSE_RE2).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // self.slice_bytes
        # a slice ends before and after each text that cannot be cut at all spaces
        part = part + np.cumsum(loose) + np.concatenate([[0], np.cumsum(loose)[:-1]]) if len(texts) else part
        for a, z in _runs(part):
            if loose[a]:
                for k in range(a, z):
                    ids = self._whole([texts[k].as_py()])[0]
                    yield k, ids, np.array([len(ids)])
            else:
                yield (a, *self._slice(texts[a:z].take(pa.array(range(z - a)))))

    def streams(self, texts: pa.Array, end: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As :meth:`encode_many`, with the id ``end`` after each text; counts include it."""
        for k, ids, n in self.encode_many(texts):
            yield k, np.insert(ids, np.cumsum(n), end).astype("<u2"), n + 1

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, ids, _ in self.encode_many(pa.array([text], pa.string())))


def _gathered(flat: np.ndarray, place: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` named by ``number``, one after the other, in steps of bounded memory."""
    out = [np.empty(0, flat.dtype)]
    for k in range(0, len(number), 1 << 20):
        n = number[k : k + (1 << 20)]
        own = size[n]
        stop = np.cumsum(own)
        out.append(flat[np.arange(stop[-1]) + np.repeat(place[n] - (stop - own), own)])
    return np.concatenate(out)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    yield from ((a, z) for a, z in zip(edges, edges[1:]) if a < z)


_encoders: dict[tuple[str, int], HubEncoder] = {}


def hub_encoder(path: str | None = None, slice_bytes: int = 16_000_000) -> HubEncoder:
    """One encoder per worker process, vocabulary file and size of slices; a slice takes about 20 times its bytes of memory."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if (path, slice_bytes) not in _encoders:
        _encoders[path, slice_bytes] = HubEncoder(path, slice_bytes)
    return _encoders[path, slice_bytes]
