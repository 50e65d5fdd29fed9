"""GIF codec: round trips, a plain table-driven decoder as reference, and frame composition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import gif, media


def _plain_decode(stream, bits):
    """Table of strings, one code at a time."""
    clear, width, at, out = 1 << bits, bits + 1, 0, bytearray()
    table, before = None, None
    value = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, before = {k: bytes([k]) for k in range(clear)} | {clear: b"", clear + 1: b""}, bits + 1, None
            continue
        if code == clear + 1:
            break
        now = table[code] if code in table else before + before[:1]
        out += now
        if before is not None and len(table) < 4096:
            table[len(table)] = before + now[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        before = now
    return bytes(out)


@pytest.mark.parametrize("kind", ["random", "two", "same"])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 300, 576, 40_000])
def test_lzw_round_trip(kind, n):
    r = random.Random(n)
    data = bytes({"random": lambda: r.randrange(256), "two": lambda: r.choice(b"ab"), "same": lambda: 7}[kind]() for _ in range(n))
    stream = gif.lzw_encode(data)
    assert _plain_decode(stream, 8) == data
    assert gif.lzw_decode(stream, 8, n).tobytes() == data


def test_lzw_small_samples():
    data = bytes(random.Random(1).randrange(4) for _ in range(9000))
    assert gif.lzw_decode(gif.lzw_encode(data, 2), 2, len(data)).tobytes() == data == _plain_decode(gif.lzw_encode(data, 2), 2)


def test_codes_after_a_full_table_without_clear():
    """An encoder may go on with 12-bit codes when the table is full."""
    data = bytes(random.Random(3).randrange(256) for _ in range(9000))
    table, codes, now = {bytes([k]): k for k in range(256)}, [256], b""
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        codes.append(table[now])
        if len(table) + 2 < 4096:
            table[now + bytes([b])] = len(table) + 2
        now = bytes([b])
    codes += [table[now], 257]
    bits, at, seen = 0, 0, 0
    for c in codes:
        width = 9 if seen < 2 else min(12, (256 + seen).bit_length())
        bits |= c << at
        at += width
        seen += 1
    stream = bits.to_bytes(-(-at // 8), "little")
    assert _plain_decode(stream, 8) == data == gif.lzw_decode(stream, 8, len(data)).tobytes()


def test_bad_streams_are_errors():
    with pytest.raises(ValueError):
        gif.decode(b"JPEG....")
    with pytest.raises(ValueError):
        gif._expand(np.array([300, 65]), 256)


def _image(frames, **kw):
    return gif.decode(gif.encode(frames, 4, 3, delay=7, **kw))[2]


def test_disposal_and_transparency():
    full, patch = np.full((3, 4), 10, np.uint8), np.array([[20, 99], [99, 20]], np.uint8)
    a, b = _image([(0, 0, full), (1, 1, patch)], transparent=99)
    assert a.delay == 7 and (a.canvas[..., 0] == 10).all()
    want = np.full((3, 4), 10)
    want[1, 1] = want[2, 2] = 20
    assert (b.canvas[..., 0] == want).all()
    a, b, c = _image([(0, 0, full), (1, 1, patch), (0, 0, patch[:1, :1])], disposal=2)
    assert (b.canvas[..., 3] == 0).sum() == 12 - 4  # the first frame was cleared
    assert (c.canvas[..., 3] > 0).sum() == 1
    a, b, c = _image([(0, 0, full), (1, 1, patch), (0, 0, patch[:1, :1])], disposal=3)
    assert (b.canvas[..., 3] > 0).sum() == 4 and (c.canvas[..., 3] > 0).sum() == 1


def test_interlaced_rows_and_local_palette():
    samples = np.arange(40, dtype=np.uint8).reshape(10, 4)
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    b = bytearray(gif.encode([(0, 0, samples[order])], 4, 10))
    at = b.index(b"\x2c", 13 + 768)
    red = bytes(v for k in range(256) for v in (k, 0, 0))
    b[at + 9] = 64 | 128 | 7
    b[at + 10 : at + 10] = red
    frame = gif.decode(bytes(b))[2][0]
    assert (frame.samples == samples).all() and (frame.canvas[..., 0] == samples).all() and not frame.canvas[..., 1].any()


def test_media_rows(messy, messy_rows, none):
    stored = media.store(messy)
    rows = media.features(stored).collect()
    want = []
    for i, t, *_ in messy_rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert all(r.error is None and sum(r.histogram) >= r.payload_bytes for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    frames = media.frames(stored).where("doc_id = 9").orderBy("frame").collect()
    assert [f.start_cs for f in frames] == [4 * k for k in range(len(frames))] and frames[0].width == 576
    assert media.features(media.store(none)).count() == 0


def test_media_that_is_no_gif(spark):
    df = spark.createDataFrame([(1, 3, b"abc"), (2, None, None), (3, 1, gif.encode([(0, 0, np.zeros((1, 1), np.uint8))], 1, 1)[:40])], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.payload_sha256 is None for r in media.features(df).collect())
    assert media.frames(df).count() == 0
