"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library merges adjacent symbols by the best score, leftmost first.  The same ids follow without merging the text: a
sequence of pieces is what merging gives exactly when every two neighbours are what merging gives for their own joined
characters.  So the encoder goes through the text once, takes at each place the longest piece that begins there, and
checks it with the piece before it by re-merging the two alone (a bounded memo holds the answers).  If they do not fit, the
next shorter piece is tried; if none is left, the place is marked in a bitfield as one that no encoding passes, and the
encoder goes back by one piece.  No place is given up twice, so the work is linear in the text.

The pieces that begin at a place, longest first, are the matches that end there of an Aho-Corasick automaton of the
reversed pieces over the reversed text.  Pieces that merging cannot build take no part.  A character that is in no piece
is one symbol of its own and is written as the pieces of its bytes.

Two characters that stand together in no piece are never merged across.  Texts are cut into parts at such places, and
each distinct part is encoded once and held in a memo bounded by bytes, which saves work and changes no result.

The text is normalised as the model says: the identity with escaped spaces and one space put before a text, which is
what the operator requires of a model.  Null text counts as empty and has no ids.  Rows are kept one to one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._base import table, text_or_empty

MODEL_FILE = "piece_bpe_32k.model"
_SPACE = "▁"
#: Types of pieces in a model (fixed values): those that merging uses, and those of single bytes.
_NORMAL, _USER, _BYTE = 1, 4, 6


class Vocabulary:
    """Pieces and scores of a model, with merging as the definition of an encoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, normal = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte pieces is required")
        if normal.name != "identity" or normal.precompiled_charsmap or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("a model with identity normalisation, a leading space and escaped spaces is required")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.of_byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.pieces = [p.piece for p in model.pieces]
        # "ab" for every two characters that stand together in a piece
        self.together = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """The symbols that merging leaves of ``text``: best score first, leftmost of equal scores."""
        symbols, left, right = list(text), [*range(-1, len(text) - 1)], [*range(1, len(text) + 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols) and (both := symbols[a] + symbols[b]) in self.scores:
                heapq.heappush(heap, (-self.scores[both], a, both))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if not symbols[a] or b >= len(symbols) or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b], right[a] = both, "", right[b]
            if right[a] < len(symbols):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]


class Backtracker:
    """Encoder of parts of text over one vocabulary."""

    #: Answers held about pairs of pieces; all are dropped when there are more.
    MOST_PAIRS = 500_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, {}
        self.automaton = ahocorasick.Automaton()
        built = {p for p in vocabulary.ids if len(p) == 1 or vocabulary.merged(p) == [p]}
        for piece in built:
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        #: The next shorter piece that begins like a piece; in the end its first character, which is a symbol in any case.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in built), p[0]) for p in built if len(p) > 1}

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the characters of both gives ``a`` and ``b`` again."""
        if a[-1] + b[0] not in self.vocabulary.together:
            return True  # no piece goes across
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.vocabulary.merged(a + b) == [a, b]
        return known

    def encode(self, text: str) -> list[str]:
        """The symbols of ``text``."""
        size = len(text)
        # matches with one end come longest first, so the longest piece at each place is the last to be set
        longest = {size - 1 - end: piece for end, piece in reversed(list(self.automaton.iter(text[::-1])))}
        if size == 1 or len(longest.get(0, "")) == size:
            return [text]  # a piece that merging builds, or a single symbol
        failed, fits, shorter = bytearray(size // 8 + 1), self.fits, self.shorter
        taken: list[str] = []
        at, piece = 0, longest.get(0) or text[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not taken or fits(taken[-1], piece)):
                taken.append(piece)
                if end == size:
                    return taken
                at, piece = end, longest.get(end) or text[end]
                continue
            while (following := shorter.get(piece)) is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
            piece = following


class Memo(dict):
    """ids as text by part, in a bounded number of bytes: emptied when full, and without parts of over ``LONGEST`` characters."""

    LONGEST, OVERHEAD = 64, 200

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


def part_pattern(together: set[str]) -> re.Pattern[str]:
    """Parts of a text that no piece goes across: spaces and a run of characters that stand together in pieces, at most.

    Characters that pieces join, directly or by way of others, are one class; a space joins what follows it only.
    """
    head: dict[str, str] = {}

    def root(c: str) -> str:
        while head.setdefault(c, c) != c:
            head[c] = c = head[head[c]]
        return c

    for a, b in together:
        if b == _SPACE != a:
            return re.compile(".+", re.DOTALL)  # pieces go on after a space: texts are not cut at all
        if a != _SPACE:
            head[root(a)] = root(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(head):
        classes.setdefault(root(c), []).append(c)
    runs = [f"[{''.join(map(re.escape, cs))}]+" for cs in sorted(classes.values(), key=len, reverse=True)]
    return re.compile(f"{_SPACE}*(?:{'|'.join([*runs, f'[^{_SPACE}]'])})|{_SPACE}+", re.DOTALL)


class PieceCodec:
    """ids and decoded text of whole texts: parts are encoded once each and put together.

    The memo holds a part's ids as decimal text, each after a comma, if the part decodes to itself.
    """

    def __init__(self, path: str, memo_bytes: int = 200 << 20):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.backtracker = Backtracker(self.vocabulary)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo = Memo(memo_bytes)
        self.pattern = part_pattern(self.vocabulary.together)
        # an id before each keeps the library from dropping a leading space
        lead, of_byte = self.vocabulary.ids["a"], set(self.vocabulary.of_byte.values())
        decoded = self.processor.decode([[lead, i] for i in range(len(self.vocabulary.pieces))])
        #: What the library makes of each id; ids of bytes have a text only together.
        self.surface = {i: d[1:] for i, d in enumerate(decoded) if i not in of_byte}
        self.lead = lead

    def ids_of(self, symbols: list[str]) -> list[int]:
        ids, of_byte, out = self.vocabulary.ids, self.vocabulary.of_byte, []
        for s in symbols:
            known = ids.get(s)
            if known is None:
                out.extend(of_byte[b] for b in s.encode())
            else:
                out.append(known)
        return out

    def part_ids(self, part: str) -> list[int]:
        return self.ids_of(self.backtracker.encode(part))

    def decoded_part(self, ids: list[int]) -> str:
        try:
            return "".join([self.surface[i] for i in ids])
        except KeyError:
            return self.processor.decode([self.lead, *ids])[1:]

    def split(self, text: str) -> list[str]:
        """The normalised text in parts that no piece goes across."""
        return self.pattern.findall(_SPACE + text.replace(" ", _SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.part_ids(part)]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """The ids as decimal text with commas between, and the text that they decode to."""
        parts, memo = self.split(text), self.memo
        try:
            # all parts are known to decode to themselves
            return b"".join([memo[p] for p in parts])[1:], text.replace(_SPACE, " ")
        except KeyError:
            pass
        new, odd = {}, {}
        for p in {p for p in parts if p not in memo}:
            ids = self.part_ids(p)
            new[p] = ("," + ",".join(map(str, ids))).encode()
            back = self.decoded_part(ids)
            if back != p.replace(_SPACE, " "):
                odd[p] = back
        out = b"".join([new[p] if p in new else memo[p] for p in parts])[1:]
        # the space that was put before the text is no part of the decoded text
        decoded = "".join([odd[p] if p in odd else p.replace(_SPACE, " ") for p in parts])[1:] if odd else text.replace(_SPACE, " ")
        memo.learn({p: ids for p, ids in new.items() if p not in odd})
        return out, decoded

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the sha256 of the ids as decimal text and that of the decoded text."""
        ids, decoded = self.encode_and_decode(text)
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_loaded: dict[str, PieceCodec] = {}


def codec(path: str | None = None) -> PieceCodec:
    """One codec per worker process and model file."""
    path = path or public_tokenizers.path(MODEL_FILE)
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    src = docs.select("doc_id", text_or_empty().alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: the decoded text of ``ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            n, ids, decoded = [list(x) for x in zip(*[c.round_trip(t.as_py()) for t in b.column(1)])] or ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select("doc_id", text_or_empty().alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
