"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: Samples a row, and rows a frame, of a stored payload.
WIDTH, ROWS = 64, 1024
FULL = 1 << 12  # codes a table can hold


@functools.lru_cache(maxsize=16)
def starts(min_bits: int, n: int) -> np.ndarray:
    """Bits before the j-th code after a clear. When it is read, codes 1 to j - 1 have each made an entry."""
    j = np.arange(n)
    entries = np.minimum((1 << min_bits) + 2 + np.maximum(j - 1, 0), FULL - 1)
    width = np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, min_bits + 1)
    return np.concatenate([[0], np.cumsum(width)])


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """A GIF code stream: a clear code first and whenever the table is full, the end code last."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    codes: list[int] = []
    at: list[int] = []  # of each clear code that follows a full table
    table: dict[int, int] = {}
    get, put, free = table.get, codes.append, end + 1
    rest = iter(data)
    prefix = next(rest, None)
    for sample in rest:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        if free < FULL:
            table[key] = free
            free += 1
        else:
            at.append(len(codes))
            put(clear)
            table.clear()
            free = end + 1
    if prefix is not None:
        put(prefix)
    put(end)
    bounds = [0, *(i + 1 for i in at), len(codes)]
    base, offsets = min_bits + 1, []  # after the first clear
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = starts(min_bits, FULL + 2)[: b - a + 1]
        offsets.append(base + own[:-1])
        base += int(own[-1])
    where = np.concatenate([[0], *offsets])
    value = np.array([clear, *codes], np.int64) << (where & 7)
    byte, size = where >> 3, (base + 7) // 8
    out = sum(np.bincount(byte + k, (value >> 8 * k) & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int, limit: int) -> bytes:
    """Up to `limit` samples of a code stream; codes may come after a full table, and the end code may be missing."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, pos, out, held = 8 * len(stream), 0, [], 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    while pos + min_bits < total and held < limit:
        for n in (FULL + 2, total // (min_bits + 1) + 2):
            first = starts(min_bits, n)
            k = int(np.searchsorted(first, total - pos, "right")) - 1
            k = min(k, n)
            where = pos + first[:k]
            byte = where >> 3
            word = (bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (where & 7)
            codes = word & ((1 << np.diff(first[: k + 1])) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or k < n:
                break
        stop = int(stops[0]) if len(stops) else k
        table, last = singles[:], None
        add = table.append
        for code in codes[:stop].tolist():
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < FULL:
                    add(last + entry[:1])
            out.append(entry)
            held += len(entry)
            last = entry
        if stop == k or codes[stop] == end:
            break
        pos += int(first[stop + 1])
    return b"".join(out)[:limit]


@dataclass
class Frame:
    """One shown frame: `canvas` (height x width x RGBA) after drawing; the box is the part that was drawn."""

    delay_ms: int
    disposal: int
    box: tuple[int, int, int, int]  # left, top, width, height
    canvas: np.ndarray

    def histogram(self) -> np.ndarray:
        """16 counts each of red, green and blue over the drawn box."""
        left, top, w, h = self.box
        seen = self.canvas[top : top + h, left : left + w, :3] >> 4
        return np.concatenate([np.bincount(seen[..., c].ravel(), minlength=16) for c in range(3)])


def gif_frames(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF file. Raises ValueError where it isn't one; a file that is cut short ends early."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None

    def palette(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        colours = np.zeros((256, 3), np.uint8)
        got = np.frombuffer(data[at : at + 3 * n], np.uint8)
        colours[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return colours, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = palette(flags, at)
    canvas = np.zeros((h, w, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C or at + 10 >= len(data):
            break
        left, top, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 0x80:
            colours, at = palette(flags, at)
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        min_bits = data[at]
        stream, at = blocks(at + 1)
        drawn = np.frombuffer(lzw_decode(stream, min_bits, fw * fh), np.uint8)
        index = np.zeros(fw * fh, np.uint8)
        index[: len(drawn)] = drawn
        there = np.arange(fw * fh) < len(drawn)
        index, there = index.reshape(fh, fw), there.reshape(fh, fw)
        if flags & 0x40:  # interlaced: rows by 8 from 0, by 8 from 4, by 4 from 2, by 2 from 1
            rows = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index[rows], there[rows] = index.copy(), there.copy()
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + fh, left : left + fw]
        index, there = index[: part.shape[0], : part.shape[1]], there[: part.shape[0], : part.shape[1]]
        shown = there if clear is None else there & (index != clear)
        part[shown, :3] = colours[index[shown]]
        part[shown, 3] = 255
        yield Frame(delay, disposal, (left, top, part.shape[1], part.shape[0]), canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None


def gif_file(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """A GIF whose frames hold the samples, 8 bits each, under a grey palette: `rows` rows a frame, top-left, the last as high as needed."""
    high = max(1, -(-len(samples) // width))
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, high), 0xF7, 0, 0), np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    for a in range(0, max(1, len(samples)), width * rows):
        part = samples[a : a + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, max(1, -(-len(part) // width)), 0, 8))
        stream = lzw_encode(part)
        out += [bytes([len(x)]) + x for i in range(0, len(stream), 255) if (x := stream[i : i + 255])]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of a text with zero bytes up to a positive multiple of 64; null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


FRAMES = T.ArrayType(
    T.StructType(
        [
            T.StructField("delay_ms", T.IntegerType()),
            T.StructField("disposal", T.IntegerType()),
            T.StructField("left", T.IntegerType()),
            T.StructField("top", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("rgb", T.BinaryType()),
            T.StructField("histogram", T.ArrayType(T.IntegerType())),
        ]
    )
)


def store_texts(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with gif binary: the text's padded bytes as a GIF. Null texts are empty; columns named gif are replaced."""
    return add_columns(df, column, T.StructType([T.StructField("gif", T.BinaryType())]), lambda texts: ([gif_file(padded(x)) for x in texts],), keep)


def read_frames(df: DataFrame, column: str = "gif", keep: list[str] | None = None) -> DataFrame:
    """`df` with frames: the timed frames of each GIF, with the composed pixels of the drawn box and its colour histogram.

    Null and broken files give null. Animations with many frames are one array, as the file is one value.
    """

    def frames(data: bytes | None) -> list | None:
        try:
            out = []
            for f in gif_frames(bytes(data)) if data else ():
                left, top, w, h = f.box
                rgb = f.canvas[top : top + h, left : left + w, :3].tobytes()
                out.append((f.delay_ms, f.disposal, left, top, w, h, rgb, f.histogram().tolist()))
        except (ValueError, IndexError, struct.error):
            return None
        names = [x.name for x in FRAMES.elementType]
        return [dict(zip(names, x, strict=True)) for x in out] if data else None

    return add_columns(df, column, T.StructType([T.StructField("frames", FRAMES)]), lambda files: ([frames(x) for x in files],), keep, limit=1 << 20)
