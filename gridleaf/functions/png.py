"""PNG images as counts of grey values, read line by line in numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: its mark, channels by colour type, and the passes of an interlaced image.
MARK = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Shares of red, green and blue in grey, of 65,536.
WEIGHTS = np.array([19595, 38470, 7471], np.uint32)
#: Bytes of a line that are asked for at once at most, and pixels of an image that is read.
MOST_LINE, MOST_PIXELS = 1 << 26, 1 << 30


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of each chunk; one that is cut short or whose sum is wrong is an error."""
    if not data.startswith(MARK):
        raise ValueError("no PNG")
    at = len(MARK)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut short")
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("cut short")
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"wrong sum of {name.decode('latin-1')}")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        pad = -len(line) % step
        whole = np.pad(line, (0, pad)).reshape(-1, step)
        return np.cumsum(whole, axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    if kind == 2:
        return line + above
    out, up = bytearray(line.tobytes()), above.tobytes()
    if kind == 3:
        for i in range(len(out)):
            left = out[i - step] if i >= step else 0
            out[i] = (out[i] + (left + up[i]) // 2) & 255
    elif kind == 4:
        for i in range(len(out)):
            a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
            p = a + b - c
            x, y, z = abs(p - a), abs(p - b), abs(p - c)
            out[i] = (out[i] + (a if x <= y and x <= z else b if y <= z else c)) & 255
    else:
        raise ValueError(f"unknown filter {kind}")
    return np.frombuffer(bytes(out), np.uint8)


def histogram(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, counts of the 256 grey values). Transparency is left out,
    of 16 bits the higher 8 count. One line is in memory at a time."""
    head, palette, packed = None, None, []
    for name, body in chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("no head")
    width, height, depth, colour, _, _, laced = head
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not width or not height or width * height > MOST_PIXELS:
        raise ValueError("implausible head")
    if colour == 3 and palette is None:
        raise ValueError("no palette")
    bits = CHANNELS[colour] * depth
    source, counts = _Inflated(packed), np.zeros(256, np.int64)
    for left, top, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - left) // dx), -(-(height - top) // dy)
        if w <= 0 or h <= 0:
            continue
        size = -(-w * bits // 8)
        above = np.zeros(size, np.uint8)
        for _ in range(h):
            raw = source.take(size + 1)
            above = _unfiltered(raw[0], np.frombuffer(raw, np.uint8)[1:], above, max(1, bits // 8))
            counts += np.bincount(_grey(above, w, depth, colour, palette), minlength=256)
    return width, height, counts


def _grey(line: np.ndarray, w: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    n = CHANNELS[colour]
    if depth < 8:
        values = np.unpackbits(line)[: w * depth].reshape(w, depth)
        values = (values << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).reshape(w, 1)
        if colour == 0:
            values = values * np.uint8(255 // (2**depth - 1))
    else:
        values = line.reshape(w, n, depth // 8)[:, :, 0]
    if colour == 3:
        if int(values.max()) >= len(palette):
            raise ValueError("a colour beyond the palette")
        values = palette[values[:, 0]]
    if values.shape[1] < 3:
        return values[:, 0]
    return ((values[:, :3].astype(np.uint32) * WEIGHTS).sum(axis=1) + 0x8000 >> 16).astype(np.uint8)


class _Inflated:
    """The inflated bytes of an image's chunks, as many as asked for at a time."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed, self.zip, self.held = iter(packed), zlib.decompressobj(), b""

    def take(self, n: int) -> bytes:
        if n > MOST_LINE:
            raise ValueError("implausible line")
        while len(self.held) < n:
            rest = self.zip.unconsumed_tail or next(self.packed, None)
            if rest is None:
                raise ValueError("too few lines")
            try:
                self.held += self.zip.decompress(rest, max(1 << 16, n - len(self.held)))
            except zlib.error as e:
                raise ValueError(str(e)) from None
        out, self.held = self.held[:n], self.held[n:]
        return out


def encoded(lines: np.ndarray, depth: int = 8, colour: int = 0, filters: tuple[int, ...] = (0,), palette: bytes = b"") -> bytes:
    """A PNG of packed lines (rows of bytes) with filters in turn; width and
    height are those that the lines hold, of whole bytes."""
    step = max(1, CHANNELS[colour] * depth // 8)
    height, size = lines.shape
    width = size * 8 // (CHANNELS[colour] * depth)
    out, above = [], np.zeros(size, np.uint8)
    for i, line in enumerate(lines):
        kind = filters[i % len(filters)]
        left = np.concatenate([np.zeros(step, np.uint8), line[:-step]]) if size > step else np.zeros(size, np.uint8)
        corner = np.concatenate([np.zeros(step, np.uint8), above[:-step]]) if size > step else np.zeros(size, np.uint8)
        if kind == 4:
            a, b, c = (v.astype(np.int32) for v in (left, above, corner))
            x, y, z = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = np.where((x <= y) & (x <= z), a, np.where(y <= z, b, c)).astype(np.uint8)
        else:
            guess = (np.zeros(size, np.uint8), left, above, ((left.astype(np.uint16) + above) // 2).astype(np.uint8))[kind]
        out.append(bytes([kind]) + (line - guess).tobytes())
        above = line
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return MARK + part(b"IHDR", head) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(b"".join(out), 6)) + part(b"IEND", b"")
