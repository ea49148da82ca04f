"""Raster files as cell tables and back: ``format("raster")``, a data source that reads block ranges in tasks and writes blocks in tasks.

Reading. Options: ``path`` (a TIFF, or archive.zip!pattern for members of an archive), ``window`` ("west,south,east,north", snapped outwards to cells and cut at the raster's edges; an error if nothing
is left), ``nodata`` ("both": the file's value, non-finite ones and those beyond 1e30 either way are null; "low": only those below -1e30). Columns: grid_row, grid_col, band_1, ... and for archives
member. A partition is a range of rows of blocks of one file; only blocks that the window meets are read. Filters on grid_row and grid_col choose blocks too, with option pushdown "true" and
``spark.sql.python.filterPushdown.enabled`` set, as ``read_raster`` does; Spark applies them to the cells in any case.

Writing. ``write_raster`` deals the cells out by blocks. Each task codes its blocks into a file of its own attempt and reports their sizes; the commit writes the head with all offsets and the blocks
behind it under another name, streamed, and renames it. A task that dies or runs twice leaves nothing in the result. Blocks without a cell take no space; two rows for one cell are an error.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.grid import Grid
from . import tiff
from .ranged import local_path, members, opened

#: Decoded bytes of a partition, about.
PARTITION_BYTES = 64 << 20


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        (path, member), *_ = members(self.options["path"]) or [("", "")]
        if not path:
            raise FileNotFoundError(f"nothing in {self.options['path']}")
        f = opened(path, member)
        try:
            bands = tiff.layout(f).bands
        finally:
            f.close()
        return "grid_row int, grid_col int" + "".join(f", band_{b + 1} double" for b in range(bands)) + (", member string" if member else "")

    def reader(self, schema) -> DataSourceReader:
        reader = PushedReader if self.options.get("pushdown") == "true" else RasterReader
        return reader(self.options, len(schema.fieldNames()) - 2 - ("member" in schema.fieldNames()))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RasterWriter(self.options, schema.fieldNames(), overwrite)


@dataclass
class Blocks(InputPartition):
    """Rows of blocks first to last - 1 of a file."""

    path: str
    member: str
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, options, bands: int):
        self.options, self.bands = dict(options), bands
        self.low, self.high = {"grid_row": 0, "grid_col": 0}, {}
        self.blocks_read = 0

    def _bounds(self, w: tiff.Layout) -> tuple[int, int, int, int]:
        """First and last row and column, inclusive, of what is wanted."""
        r0, r1, c0, c1 = self.low["grid_row"], self.high.get("grid_row", w.height), self.low["grid_col"], self.high.get("grid_col", w.width)
        if "window" in self.options:
            a, b, c, d = w.grid().window(*map(float, self.options["window"].split(",")))  # an error where they don't meet
            r0, r1, c0, c1 = max(r0, a), min(r1, b), max(c0, c), min(c1, d)
        return r0, min(r1, w.height - 1), c0, min(c1, w.width - 1)

    def partitions(self) -> Sequence[Blocks]:
        out = []
        for path, member in members(self.options["path"]):
            f = opened(path, member)
            try:
                w = tiff.layout(f)
            finally:
                f.close()
            if w.bands != self.bands:
                raise ValueError(f"{member or path} has {w.bands} bands, the first file {self.bands}")
            r0, r1, c0, c1 = self._bounds(w)
            if r0 > r1 or c0 > c1:
                continue
            first, last = r0 // w.block_height, r1 // w.block_height + 1
            step = max(1, PARTITION_BYTES // (8 * w.bands * w.block_height * (c1 - c0 + 1)))
            if member and getattr(f, "method", 0) == 8:
                step = last - first  # inflated from its start: once
            out += [Blocks(path, member, i, min(i + step, last)) for i in range(first, last, step)]
        return out

    def _bad(self, values: np.ndarray, nodata: float | None) -> np.ndarray:
        if self.options.get("nodata", "both") == "low":
            return np.isnan(values) | (values < -1e30)
        bad = ~np.isfinite(values) | (np.abs(values) > 1e30)
        return bad | (values == nodata) if nodata is not None else bad

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        f = opened(partition.path, partition.member)
        try:
            w = tiff.layout(f)
            r0, r1, c0, c1 = self._bounds(w)
            for down in range(partition.first, partition.last):
                for across in range(c0 // w.block_width, c1 // w.block_width + 1):
                    yield self._cells(tiff.block(f, w, down, across), w, down, across, (r0, r1, c0, c1), partition.member)
        finally:
            f.close()

    def _cells(self, values, w, down, across, bounds, member) -> pa.RecordBatch:
        self.blocks_read += 1
        r0, r1, c0, c1 = bounds
        top, left = down * w.block_height, across * w.block_width
        rows, cols = np.arange(max(r0, top), min(r1 + 1, top + values.shape[1])), np.arange(max(c0, left), min(c1 + 1, left + values.shape[2]))
        values = values[:, rows - top][:, :, cols - left]
        arrays = [pa.array(np.repeat(rows, len(cols)).astype(np.int32)), pa.array(np.tile(cols, len(rows)).astype(np.int32))]
        arrays += [pa.array(v.ravel(), mask=self._bad(v.ravel(), w.nodata)) for v in values]
        names = ["grid_row", "grid_col", *(f"band_{b + 1}" for b in range(w.bands))]
        if member:
            arrays.append(pa.array([member] * len(arrays[0])))
            names.append("member")
        return pa.RecordBatch.from_arrays(arrays, names)


class PushedReader(RasterReader):
    """Chooses blocks by filters, too; Spark lets a source do so only where it is asked to."""

    def pushFilters(self, filters) -> Iterator:
        for x in filters:
            column, value = (x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None), getattr(x, "value", None)
            if column in self.low and isinstance(value, int):
                if isinstance(x, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[column] = max(self.low[column], value + isinstance(x, GreaterThan))
                if isinstance(x, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[column] = min(self.high.get(column, value), value - isinstance(x, LessThan))
            yield x  # blocks are chosen, cells are still filtered


@dataclass
class Written(WriterCommitMessage):
    """A task's file and its blocks: (band, block, bytes) in the order they stand there."""

    part: str
    blocks: list[tuple[int, int, int]]


class RasterWriter(DataSourceArrowWriter):
    """Gets (block, grid_row, grid_col, band columns ...), rows of a block together."""

    def __init__(self, options, names: list[str], overwrite: bool):
        o = self.options = dict(options)
        self.path, self.bands, self.overwrite = local_path(o["path"]), names[3:], overwrite
        if self.path is None:
            raise ValueError("raster files are written to a mounted path")
        self.grid = Grid("raster", int(o["width"]), int(o["height"]), *map(float, o["transform"].split(",")))
        self.tiled, self.rows, self.cols, self.predictor = o["tiled"] == "true", int(o["block_rows"]), int(o["block_cols"]), int(o.get("predictor", 1))
        self.parts = f"{self.path}.{uuid.uuid4().hex[:12]}.parts"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name, out, held = uuid.uuid4().hex, [], []
        os.makedirs(self.parts, exist_ok=True)
        with open(f"{self.parts}/{name}", "wb") as f:
            now = None
            for b in batches:
                of = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)] if len(of) else [0]
                for lo, hi in zip(cuts, cuts[1:]):
                    if held and of[lo] != now:
                        out += self._block(f, now, held)
                        held = []
                    now = of[lo]
                    held.append(b.slice(lo, hi - lo))
            if held:
                out += self._block(f, now, held)
        return Written(name, out)

    def _block(self, f, block: int, held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        t = pa.Table.from_batches(held)
        down, across = divmod(int(block), -(-self.grid.width // self.cols))
        rows = self.rows if self.tiled else min(self.rows, self.grid.height - down * self.rows)
        r, c = t.column(1).to_numpy() - down * self.rows, t.column(2).to_numpy() - across * self.cols
        if len(np.unique(r * self.cols + c)) < len(r):
            raise ValueError(f"two rows for a cell in block {block}")
        for i in range(len(self.bands)):
            values = np.full((rows, self.cols), np.nan, np.float32)
            values[r, c] = t.column(3 + i).cast(pa.float32()).to_numpy()
            yield i, int(block), f.write(tiff.encoded(values, self.predictor))

    def commit(self, messages: list[Written]) -> None:
        blocks = -(-self.grid.width // self.cols) * -(-self.grid.height // self.rows)
        sizes, where = [0] * (blocks * len(self.bands)), {}
        for m in filter(None, messages):
            at = 0
            for band, block, n in m.blocks:
                i = band * blocks + block
                if i in where:
                    raise ValueError(f"block {block} was written by two tasks")
                sizes[i], where[i], at = n, (m.part, at), at + n
        head, _ = tiff.header(self.grid, len(self.bands), (self.rows, self.cols), sizes, self.predictor, self.tiled)
        whole = f"{self.parts}/whole"
        os.makedirs(self.parts, exist_ok=True)
        with open(whole, "wb") as out:
            out.write(head)
            part, f = None, None
            for i in sorted(where):  # a band after another; a block at a time is in memory
                if where[i][0] != part:
                    if f:
                        f.close()
                    part, f = where[i][0], open(f"{self.parts}/{where[i][0]}", "rb")
                f.seek(where[i][1])
                out.write(f.read(sizes[i]))
            if f:
                f.close()
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


def read_raster(spark: SparkSession, path: str, window: Sequence[float] | None = None, nodata: str = "both") -> DataFrame:
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raster").option("path", path).option("nodata", nodata).option("pushdown", "true")
    if window:
        reader = reader.option("window", ",".join(map(repr, map(float, window))))
    return reader.load()


def raster_grid(path: str, name: str = "raster") -> Grid:
    """The grid of a raster file, from its head."""
    (path, member), *_ = members(path)
    f = opened(path, member)
    try:
        return tiff.layout(f).grid(name)
    finally:
        f.close()


def pack(paths: Sequence[str], archive: str, deflate: bool = True) -> None:
    """Files into a ZIP archive, streamed, under another name until it is whole."""
    part = f"{archive}.{uuid.uuid4().hex[:12]}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as z:
        for p in paths:
            z.write(p, os.path.basename(p))
    os.replace(part, archive)


def write_raster(cells: DataFrame, path: str, grid: Grid, bands: Sequence[str], block: tuple[int, int] = (256, 256), tiled: bool = True, predictor: int = 1, overwrite: bool = False) -> None:
    """(grid_row, grid_col, bands) as one file of float bands, NaN where a cell is null or absent. tiled: blocks of this size (sides multiples of 16); else strips of block[0] rows."""
    if tiled and (block[0] % 16 or block[1] % 16):
        raise ValueError("sides of tiles are multiples of 16")
    if predictor not in (1, 3):
        raise ValueError("predictor 1 or 3")
    cells.sparkSession.dataSource.register(RasterSource)
    cols = block[1] if tiled else grid.width
    inside = cells.where(grid.inside(F.col("grid_row"), F.col("grid_col")))
    of = (F.floor(F.col("grid_row") / block[0]) * -(-grid.width // cols) + F.floor(F.col("grid_col") / cols)).cast("long")
    rows = inside.select(of.alias("block"), F.col("grid_row").cast("int"), F.col("grid_col").cast("int"), *(F.col(b).cast("double") for b in bands)).repartition("block").sortWithinPartitions("block")
    options = {"path": path, "width": grid.width, "height": grid.height, "transform": ",".join(map(repr, (grid.c, grid.a, grid.f, grid.e))), "block_rows": block[0], "block_cols": cols, "tiled": str(tiled).lower(), "predictor": predictor}
    rows.write.format("raster").options(**options).mode("overwrite" if overwrite else "append").save()
