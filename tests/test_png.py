"""Grey values of PNG images of all forms."""

import struct
import zlib

import numpy as np
import pytest

from gridleaf.functions import png


def grey_of(rgb):
    r, g, b = (int(v) for v in rgb)
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def counted(values):
    return np.bincount(np.asarray(values).reshape(-1), minlength=256)


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
@pytest.mark.parametrize(("colour", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_forms(filters, colour, channels, depth):
    values = np.random.default_rng(channels * depth).integers(0, 256, (9, 13, channels, depth // 8), np.uint8)
    w, h, counts = png.histogram(png.encoded(values.reshape(9, -1), depth, colour, filters))
    top = values[..., 0]
    want = top[..., 0] if channels < 3 else [[grey_of(p[:3]) for p in row] for row in top]
    assert (w, h) == (13, 9) and (counts == counted(want)).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_small_depths_and_palettes(depth):
    lines = np.random.default_rng(depth).integers(0, 256, (6, 5), np.uint8)
    bits = np.unpackbits(lines, axis=1).reshape(6, -1, depth)
    values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
    assert (png.histogram(png.encoded(lines, depth, 0, (0, 2, 4)))[2] == counted(values * 255 // (2**depth - 1))).all()
    palette = np.random.default_rng(1).integers(0, 256, (2**depth, 3), np.uint8)
    want = [grey_of(palette[v]) for v in values.reshape(-1)]
    assert (png.histogram(png.encoded(lines, depth, 3, (1, 3), palette.tobytes()))[2] == counted(want)).all()


def laced(grey):
    """The image in seven passes, each unfiltered."""
    h, w = grey.shape
    raw = b"".join(b"\0" + line.tobytes() for x, y, dx, dy in png.PASSES for line in grey[y::dy, x::dx] if line.size)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = zlib.compress(raw)
    return png.MARK + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 1)) + part(b"IDAT", data[:9]) + part(b"tEXt", b"x") + part(b"IDAT", data[9:]) + part(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (8, 8), (17, 21)])
def test_passes(shape):
    grey = np.random.default_rng(3).integers(0, 256, shape, np.uint8)
    w, h, counts = png.histogram(laced(grey))
    assert (h, w) == shape and (counts == counted(grey)).all()


def test_broken_images():
    good = png.encoded(np.zeros((20, 20), np.uint8))
    huge = png.MARK + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0)
    huge += struct.pack(">I", zlib.crc32(huge[-17:])) + good[-12:]
    few = png.encoded(np.zeros((20, 20), np.uint8))
    few = few.replace(struct.pack(">II", 20, 20), struct.pack(">II", 20, 21))
    few = few[:29] + struct.pack(">I", zlib.crc32(few[12:29])) + few[33:]
    for data, why in ((b"", "no PNG"), (b"GIF89a", "no PNG"), (good[:-5], "cut short"), (good[:40], "cut short"), (good[:30] + b"\0" + good[31:], "wrong sum"), (good[:-12], "no end"), (huge, "implausible"), (few, "too few")):
        with pytest.raises(ValueError, match=why):
            png.histogram(data)
