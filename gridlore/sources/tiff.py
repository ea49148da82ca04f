"""TIFF rasters block by block: strips and tiles, plain or deflated, with or without predictor, classic and 64-bit files, with the tags of a grid."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from ..functions.grid import Grid

# Fixed values of the file format: numbers of tags, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 17: 8}


@dataclass(frozen=True)
class Layout:
    """Where a raster's blocks are and how they are coded. A block that is not there (offset or size 0) has no data."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    compression: int
    predictor: int
    separate: bool
    block_width: int
    block_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None
    transform: tuple[float, float, float, float] | None  # west, width of a cell, north, height of a cell (negative)
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def grid(self, name: str = "raster") -> Grid:
        if self.transform is None:
            raise ValueError(f"{name} has no place on the map")
        return Grid(name, self.width, self.height, *self.transform)


def layout(f) -> Layout:
    """From the header and first directory of a file opened by ranges."""
    head = f.at(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = version == 43
    at = struct.unpack(f"{order}Q", f.at(8, 8))[0] if wide else struct.unpack(f"{order}I", head[4:])[0]
    n = struct.unpack(f"{order}{'Q' if wide else 'H'}", f.at(at, 8 if wide else 2))[0]
    each, inline = (20, 8) if wide else (12, 4)
    rows, found = f.at(at + (8 if wide else 2), n * each), {}
    for i in range(n):
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if wide else 'I'}", rows[i * each : i * each + each - inline])
        if kind in FIELD:
            found[tag] = kind, count, rows[(i + 1) * each - inline : (i + 1) * each]

    def values(tag: int, default=None):
        if tag not in found:
            return default
        kind, count, raw = found[tag]
        if (size := SIZE[kind] * count) > inline:
            raw = f.at(struct.unpack(f"{order}{'Q' if wide else 'I'}", raw)[0], size)
        return raw[:size] if kind == 2 else struct.unpack(f"{order}{count}{FIELD[kind]}", raw[:size])

    one = lambda tag, default: (values(tag) or (default,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    kinds = {*(values(BITS) or (1,))}, {*(values(FORMAT) or (1,))}
    if any(len(k) > 1 for k in kinds):
        raise ValueError("bands of several types aren't read")
    bits, form = (k.pop() for k in kinds)
    if (form, bits) not in {(1, 8), (1, 16), (1, 32), (1, 64), (2, 8), (2, 16), (2, 32), (2, 64), (3, 32), (3, 64)}:
        raise ValueError(f"samples of {bits} bits of format {form} aren't read")
    if (compression := one(COMPRESSION, 1)) not in (1, 8, 32946):
        raise ValueError(f"compression {compression} isn't read")
    if (predictor := one(PREDICTOR, 1)) not in (1, 2, 3) or (predictor == 3) > (form == 3):
        raise ValueError(f"predictor {predictor} isn't read")
    tiled = TILE_OFFSETS in found
    block = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    scale, tie, nodata = values(PIXEL_SCALE), values(TIE_POINT), values(NODATA)
    place = (tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1]) if scale and tie else None
    text = nodata.rstrip(b"\0 ").decode() if nodata else ""
    dtype = np.dtype(f"{order}{'?uif'[form]}{bits // 8}")
    return Layout(width, height, bands, dtype, compression, predictor, one(PLANAR, 1) == 2 and bands > 1, *block, values(TILE_OFFSETS if tiled else STRIP_OFFSETS), values(TILE_SIZES if tiled else STRIP_SIZES), float(text) if text else None, place, tiled)


def _plane(f, w: Layout, index: int, rows: int, samples: int) -> np.ndarray | None:
    """A block's samples (rows, block_width, samples)."""
    if not w.offsets[index] or not w.sizes[index]:
        return None
    raw = f.at(w.offsets[index], w.sizes[index])
    raw, shape = raw if w.compression == 1 else zlib.decompress(raw), (rows, w.block_width, samples)
    n = w.dtype.itemsize
    if w.predictor == 3:  # differences of bytes, the most significant bytes of a row first
        steps = np.frombuffer(raw, np.uint8, rows * w.block_width * samples * n).reshape(rows, -1, samples)
        flat = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, n, -1)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(w.dtype.newbyteorder(">"))[..., 0].reshape(shape)
    values = np.frombuffer(raw, w.dtype, rows * w.block_width * samples).reshape(shape)
    if w.predictor == 2:
        whole = np.dtype(f"u{n}")
        values = np.cumsum(values.astype(w.dtype.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(w.dtype.newbyteorder("="))
    return values


def block(f, w: Layout, down: int, across: int) -> np.ndarray:
    """(bands, rows, columns) of a block as doubles, cut at the raster's edges; NaN where there is no data."""
    rows, cols = min(w.block_height, w.height - down * w.block_height), min(w.block_width, w.width - across * w.block_width)
    coded = w.block_height if w.tiled else rows
    i = down * w.across + across
    planes = [_plane(f, w, i + b * w.across * w.down, coded, 1) for b in range(w.bands)] if w.separate else [_plane(f, w, i, coded, w.bands)]
    out = np.full((w.bands, rows, cols), np.nan)
    for b, p in enumerate(planes):
        if p is not None:
            out[slice(b, b + 1) if w.separate else slice(None)] = p[:rows, :cols].transpose(2, 0, 1)
    return out


def encoded(values: np.ndarray, predictor: int = 1) -> bytes:
    """A deflated block of floats (rows, columns), one band."""
    values = np.ascontiguousarray(values, np.dtype("<f4"))
    if predictor == 3:
        planes = np.ascontiguousarray(values.astype(">f4")).view(np.uint8).reshape(*values.shape, 4).transpose(0, 2, 1).reshape(len(values), -1)
        return zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((len(values), 1), np.uint8)).astype(np.uint8).tobytes(), 6)
    return zlib.compress(values.tobytes(), 6)


def header(grid: Grid, bands: int, block: tuple[int, int], sizes: list[int], predictor: int = 1, tiled: bool = True) -> tuple[bytes, int]:
    """Head and directory of a file of float bands, one after another, with blocks of ``sizes`` bytes behind it in that order (0: no block); and the whole file's length."""
    total = sum(sizes)
    wide = total + 40 * len(sizes) + 4096 > 0xFFFFFFFF
    word, kind = ("Q", 16) if wide else ("I", 4)
    entry = lambda tag, t, fmt, *v: (tag, t, len(v), struct.pack(f"<{len(v)}{fmt}", *v))
    nodata = b"nan\0"
    tags = [
        entry(WIDTH, 4, "I", grid.width), entry(HEIGHT, 4, "I", grid.height), entry(BITS, 3, "H", *[32] * bands), entry(COMPRESSION, 3, "H", 8), entry(PHOTOMETRIC, 3, "H", 1), entry(SAMPLES, 3, "H", bands),
        entry(PLANAR, 3, "H", 2), entry(PREDICTOR, 3, "H", predictor), entry(FORMAT, 3, "H", *[3] * bands), entry(PIXEL_SCALE, 12, "d", grid.a, -grid.e, 0.0), entry(TIE_POINT, 12, "d", 0.0, 0.0, 0.0, grid.c, grid.f, 0.0),
        entry(GEO_KEYS, 3, "H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326), (NODATA, 2, len(nodata), nodata), entry(TILE_SIZES if tiled else STRIP_SIZES, kind, word, *sizes),
        (TILE_OFFSETS if tiled else STRIP_OFFSETS, kind, len(sizes), b"\0" * (len(sizes) * (8 if wide else 4))),
    ]
    tags += [entry(TILE_WIDTH, 4, "I", block[1]), entry(TILE_HEIGHT, 4, "I", block[0])] if tiled else [entry(STRIP_ROWS, 4, "I", block[0])]
    tags.sort()
    each, inline, first = (20, 8, 16) if wide else (12, 4, 8)
    after = first + (8 if wide else 2) + each * len(tags) + inline
    places, at = {}, after
    for tag, _, _, raw in tags:
        if len(raw) > inline:
            places[tag], at = at, at + len(raw) + len(raw) % 2
    start, offsets = at, []
    for n in sizes:
        offsets.append(start if n else 0)
        start += n
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if wide else struct.pack("<2sHI", b"II", 42, first))
    out += struct.pack(f"<{'Q' if wide else 'H'}", len(tags))
    data = bytearray()
    for tag, t, count, raw in tags:
        if tag in (TILE_OFFSETS, STRIP_OFFSETS):
            raw = struct.pack(f"<{len(offsets)}{word}", *offsets)
        out += struct.pack(f"<HH{word}", tag, t, count) + (struct.pack(f"<{word}", places[tag]) if tag in places else raw.ljust(inline, b"\0"))
        if tag in places:
            data += raw + b"\0" * (len(raw) % 2)
    out += b"\0" * inline + data
    return bytes(out), start
