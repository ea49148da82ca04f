"""Vector tiles of record densities: a decoder for the public vector-tile format, run over binary rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Message:
    """A protobuf message as a mapping from field number to its values, in order; lengths, numbers and fixed widths only."""

    def __init__(self, raw: bytes):
        self.fields: dict[int, list] = {}
        view = memoryview(raw)
        while view:
            head, view = number(view)
            kind = head & 7
            if kind == 0:
                value, view = number(view)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
                value, view = bytes(view[:n]), view[n:]
            elif kind == 2:
                n, view = number(view)
                value, view = bytes(view[:n]), view[n:]
            else:
                raise ValueError(f"wire type {kind}")
            self.fields.setdefault(head >> 3, []).append(value)

    def all(self, field: int) -> list:
        return self.fields.get(field, [])

    def one(self, field: int, default=None):
        return self.fields[field][-1] if field in self.fields else default


def number(view: memoryview) -> tuple[int, memoryview]:
    out = 0
    for i, b in enumerate(view):
        out |= (b & 127) << 7 * i
        if b < 128:
            return out, view[i + 1 :]
    raise ValueError("number cut short")


def packed(raw: bytes) -> Iterator[int]:
    view = memoryview(raw)
    while view:
        n, view = number(view)
        yield n


def signed(n: int) -> int:
    return -(n + 1 >> 1) if n & 1 else n >> 1


def points(raw: bytes, key: str = "total") -> Iterator[tuple[int, int, float, int]]:
    """(x, y, total, extent) of each point, buffer included; a feature of several points shares its total among them."""
    for layer in map(Message, Message(raw).all(3)):
        keys = [k.decode("utf-8", "replace") for k in layer.all(3)]
        if key not in keys:
            continue
        values = [v.one(4) or v.one(5) if 6 not in v.fields else signed(v.one(6)) for v in map(Message, layer.all(4))]
        for f in map(Message, layer.all(2)):
            tags, shape = list(packed(f.one(2, b""))), list(packed(f.one(4, b"")))
            total = dict(zip((keys[k] for k in tags[::2]), (values[v] for v in tags[1::2]))).get(key)
            if not shape or total is None:
                continue
            n, x, y = shape[0] >> 3, 0, 0
            for dx, dy in zip(shape[1 : 2 * n : 2], shape[2 : 2 * n + 1 : 2]):
                x, y = x + signed(dx), y + signed(dy)
                yield x, y, total / n, layer.one(5, 4096)


def decode(tiles: DataFrame, zoom: str = "z", tile_x: str = "x", tile_y: str = "y", content: str = "content") -> DataFrame:
    """(z, tile_x, tile_y, x, y, total, extent) of all points inside their tile; what lies in a tile's buffer belongs to its neighbour and is left out."""

    def run(batches):
        for b in batches:
            rows = [(z, tx, ty, *p) for z, tx, ty, raw in zip(*(c.to_pylist() for c in b.columns)) if raw for p in points(raw) if 0 <= p[0] < p[3] and 0 <= p[1] < p[3]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 5, pa.float64(), pa.int32()))], names=["z", "tile_x", "tile_y", "x", "y", "total", "extent"])

    src = tiles.select(F.col(zoom).cast("int"), F.col(tile_x).cast("int"), F.col(tile_y).cast("int"), F.col(content))
    return src.mapInArrow(run, "z int, tile_x int, tile_y int, x int, y int, total double, extent int")


def boxes(pts: DataFrame) -> DataFrame:
    """Longitude and latitude boxes (west, south, east, north, n) of the points of tiles that divide the globe into 2^(z+1) by 2^z squares."""
    size = F.lit(180.0) / F.pow(F.lit(2.0), F.col("z"))
    west = F.lit(-180.0) + (F.col("tile_x") + F.col("x") / F.col("extent")) * size
    north = F.lit(90.0) - (F.col("tile_y") + F.col("y") / F.col("extent")) * size
    return pts.select(west.alias("west"), (north - size / F.col("extent")).alias("south"), (west + size / F.col("extent")).alias("east"), north.alias("north"), F.col("total").alias("n"))
