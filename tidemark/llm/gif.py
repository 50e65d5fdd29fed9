"""GIF: LZW code streams, palettes, disposal and transparency, in numpy.

The decoder extracts all codes of a stretch between two clear codes at once, because the width of the i-th code after a
clear code depends on i alone.  The string of table entry ``first + j`` is the output of code j and the byte after it,
so lengths and bytes follow by pointer jumping instead of a table of strings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np


def _widths(first: int, begin: int, n: int) -> np.ndarray:
    """Bits of the codes begin .. begin+n-1 after a clear code."""
    entries = np.maximum(first + np.arange(begin, begin + n) - 1, first)
    return np.minimum(12, np.frexp(entries.astype(np.float64))[1]).astype(np.int64)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of ``data`` (samples below 2**bits): a clear code, codes, a clear code when the table is full, the end code."""
    clear, first = 1 << bits, (1 << bits) + 2
    runs, out = [], []
    if data:
        table, code = {}, first
        get, put = table.get, out.append
        samples = iter(data)
        now = next(samples)
        for b in samples:
            key = now << 8 | b
            known = get(key)
            if known is not None:
                now = known
                continue
            put(now)
            now = b
            if code < 4096:
                table[key] = code
                code += 1
            else:
                put(clear)
                runs.append(out)
                table, code, out = {}, first, []
                get, put = table.get, out.append
        out.append(now)
    out.append(clear + 1)
    runs.append(out)
    values = np.concatenate([[clear], *map(np.array, runs)]).astype(np.int64)
    widths = np.concatenate([[bits + 1], *(_widths(first, 0, len(r)) for r in runs)])
    at = np.arange(12)
    planes = (values[:, None] >> at & 1).astype(np.uint8)
    return np.packbits(planes[at < widths[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of codes between two clear codes."""
    n, first = len(codes), clear + 2
    own = np.arange(n)
    literal = codes < clear
    source = np.where(literal, own, codes - first)
    if n and ((source > own).any() or (source[~literal] >= own[~literal]).any() or (source < 0).any()):
        raise ValueError("LZW code beyond the table")
    extra, up = (~literal).astype(np.int64), source.copy()
    while True:
        above = up[up]
        if (above == up).all():
            extra = extra + np.where(up == own, 0, extra[up])
            break
        extra, up = extra + np.where(up == own, 0, extra[up]), above
    lengths = extra + 1
    begins = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    at = np.arange(total) + np.repeat(np.where(literal, 0, begins[source] - begins), lengths)
    while True:
        further = at[at]
        if (further == at).all():
            break
        at = further
    values = np.zeros(total, np.uint8)
    values[begins[literal]] = codes[literal]
    return values[at]


def lzw_decode(stream: bytes, bits: int, most: int) -> np.ndarray:
    """At most ``most`` samples of a code stream."""
    clear, first = 1 << bits, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out, have = 8 * len(stream), 0, [], 0
    while have < most:
        begin, part, ended = 0, [], True
        while True:
            widths = _widths(first, begin, 4096 if not begin else 65536)
            offsets = at + np.cumsum(widths) - widths
            widths = widths[: np.searchsorted(offsets + widths, total, "right")]
            offsets = offsets[: len(widths)]
            codes = words[offsets >> 3] >> (offsets & 7) & (1 << widths) - 1
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops):
                k = int(stops[0])
                part.append(codes[:k])
                at, ended = int(offsets[k] + widths[k]), codes[k] == clear + 1
                break
            part.append(codes)
            if not len(widths):
                break
            at, begin = int(offsets[-1] + widths[-1]), begin + len(codes)
        own = _expand(np.concatenate(part), clear)
        out.append(own)
        have += len(own)
        if ended:
            break
    return np.concatenate(out)[:most] if out else np.empty(0, np.uint8)


@dataclass
class Frame:
    """One image of a GIF: its samples in its rectangle, and the composed canvas as it is shown."""

    left: int
    top: int
    samples: np.ndarray
    delay: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray = field(repr=False, default=None)


def _blocks(b: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = b[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(b[at : at + n])
        at += n


def _palette(b: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(b, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode(b: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and all frames, each with a copy of its canvas."""
    found = [replace(f, canvas=f.canvas.copy()) for f in frames(b)]
    width, height = struct.unpack_from("<HH", b, 6)
    return width, height, found


def frames(b: bytes) -> Iterator[Frame]:
    """The frames one by one; the canvas (four channels, alpha 0 where nothing has been drawn) holds until the next one is asked for."""
    if b[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", b, 6)
    at, common = 13, None
    if flags & 128:
        common, at = _palette(b, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(b):
        kind = b[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = b[at]
            body, at = _blocks(b, at + 1)
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", b, at)
        at += 9
        palette = common
        if bits & 128:
            palette, at = _palette(b, at, bits)
        size = b[at]
        stream, at = _blocks(b, at + 1)
        samples = lzw_decode(stream, size, w * h)
        if len(samples) < w * h:
            raise ValueError("GIF image too short")
        samples = samples.reshape(h, w)
        if bits & 64:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(rows, kind="stable")]
        before = canvas.copy() if disposal == 3 else None
        seen = samples[: max(0, height - top), : max(0, width - left)]
        region = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        if palette is not None:
            colours[: len(palette), :3] = palette
        colours[:, 3] = 255
        if transparent is None:
            region[:] = colours[seen]
        else:
            shown = seen != transparent
            region[shown] = colours[seen[shown]]
        yield Frame(left, top, samples, delay, disposal, transparent, canvas)
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


GREY = bytes(v for k in range(256) for v in (k, k, k))


def encode(frames: list[tuple[int, int, np.ndarray]], width: int, height: int, delay: int = 4, palette: bytes = GREY, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF of 8-bit ``frames`` (left, top, samples) over one palette of 256 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for left, top, samples in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, samples.shape[1], samples.shape[0], 0) + b"\x08")
        stream = lzw_encode(samples.tobytes())
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])
