"""Piece encoding by backtracking against the library, and plain merging as the definition."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces

TEXT = st.lists(st.sampled_from([" ", "  ", " " * 20, "\n", "\t", "a", "the", " The", "ing", "12", "½", "é", "日本", "🙂", "...", "\x00", "▁", "<s>", "<0x41>", "aaaa", "　"]) | st.text(max_size=4), max_size=12).map("".join).filter(lambda s: s.encode("utf-8", "ignore").decode() == s)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL_FILE))


def digests(library, text):
    ids = library.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(library, text):
    c = pieces.codec()
    assert c.encode(text) == library.encode(text)
    assert c.round_trip(text) == digests(library, text)


def test_joined_vocabulary_pieces_and_letter_soup_equal_the_library(library):
    c, r = pieces.codec(), random.Random(3)
    known = [p.replace("▁", " ") for p in c.vocabulary.ids]
    for _ in range(1500):
        text = "".join(r.choice(known) for _ in range(r.randint(1, 12)))
        assert c.encode(text) == library.encode(text), text
    for letters in ("ab", "aeinrst", " \n.", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(r.choice(letters) for _ in range(20_000))
        assert c.encode(text) == library.encode(text)


def test_backtracking_gives_what_merging_gives():
    c, r = pieces.codec(), random.Random(4)
    went_back = 0
    for _ in range(2000):
        text = "".join(r.choice("aeinrsthou▁ld") for _ in range(r.randint(1, 14)))
        found = c.backtracker.encode(text)
        assert found == c.vocabulary.merged(text), text
        first = max((p for p in c.vocabulary.ids if text.startswith(p)), key=len)
        went_back += found[0] != first
    assert went_back > 50  # the longest piece is often not the one


def test_full_memos_change_nothing(library):
    small = pieces.PieceCodec(public_tokenizers.path(pieces.MODEL_FILE), memo_bytes=900)
    small.backtracker.MOST_PAIRS = 3
    for text in ("one two three four one two", "a\nb  c", "", "seventeen eighteen nineteen", " lead", "tail "):
        assert small.round_trip(text) == digests(library, text)


def test_parts_are_cut_where_no_piece_goes_across():
    c = pieces.codec()
    assert c.split("the end.\nnow") == ["▁the", "▁end", ".", "\n", "now"]
    for text in ("the 'end'.\nnow  日本 1", "a<b>c", "  x▁▁y ", "½🙂"):
        parts = c.split(text)
        assert "".join(parts) == "▁" + text.replace(" ", "▁")
        assert all(a[-1] + b[0] not in c.vocabulary.together for a, b in zip(parts, parts[1:]))
    assert pieces.part_pattern({"a▁", "bc"}).findall("abc a▁") == ["abc a▁"]


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path(pieces.MODEL_FILE), "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(str(tmp_path / "m"))


def test_rows(spark, messy, messy_rows, none, library):
    rows = pieces.round_trip(messy).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted((str(i), *digests(library, t or "")) for i, t, *_ in messy_rows)
    assert pieces.round_trip(none).count() == 0
    encoded = pieces.encode(messy)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == sorted((str(i), library.encode(t or "")) for i, t, *_ in messy_rows)
    back = pieces.decode(encoded).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, *_ in messy_rows)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = pieces.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, *digests(library, d.text or "")) for d in docs)
