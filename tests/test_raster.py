"""Raster files: hand-made ones of every coding, windows that touch their blocks alone, archives by ranges, round trips, tasks that run twice."""

import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from gridlore.functions.grid import Grid
from gridlore.sources import raster, tiff
from gridlore.sources.ranged import RangedFile, directory, members, opened

GRID = Grid("g", 37, 29, -10.0, 0.5, 40.0, -0.5)


def made(path, data, order="<", tile=None, strip=5, deflate=True, predictor=1, separate=False, nodata=None):
    """A TIFF written plainly: data (bands, rows, columns)."""
    bands, h, w = data.shape
    data = data.astype(data.dtype.newbyteorder(order))
    bh, bw = tile or (strip, w)
    blocks = []
    for group in [data[b : b + 1] for b in range(bands)] if separate else [data]:
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                x = group[:, r : r + bh, c : c + bw]
                if tile:
                    x = np.pad(x, ((0, 0), (0, bh - x.shape[1]), (0, bw - x.shape[2])))
                x = np.ascontiguousarray(x.transpose(1, 2, 0))
                if predictor == 2:
                    x = np.concatenate([x[:, :1], np.diff(x.astype(x.dtype.newbyteorder("=")), axis=1).astype(x.dtype)], axis=1).astype(x.dtype)
                blocks.append(zlib.compress(x.tobytes()) if deflate else x.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [data.dtype.itemsize * 8] * bands), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 284: ("H", [2 if separate else 1]), 317: ("H", [predictor]), 339: ("H", [kind] * bands), 33550: ("d", [0.5, 0.5, 0]), 33922: ("d", [0, 0, 0, -10, 40, 0])}
    tags |= {322: ("I", [bw]), 323: ("I", [bh])} if tile else {278: ("I", [bh])}
    if nodata is not None:
        tags[42113] = ("s", str(nodata).encode() + b"\0")
    at, out = 8, bytearray()
    offsets = []
    for b in blocks:
        offsets.append(at + len(out))
        out += b
    tags |= {(324 if tile else 273): ("I", offsets), (325 if tile else 279): ("I", [len(b) for b in blocks])}
    rows = []
    for t, (k, v) in sorted(tags.items()):
        raw = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        if len(raw) > 4:
            where, out = at + len(out), out + raw
            raw = struct.pack(f"{order}I", where)
        rows.append(struct.pack(f"{order}HHI", t, {"s": 2, "H": 3, "I": 4, "d": 12}[k], len(v)) + raw.ljust(4, b"\0"))
    end = at + len(out)
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, end) + out + struct.pack(f"{order}H", len(rows)) + b"".join(rows) + b"\0" * 4)


def whole(path):
    f = opened(str(path))
    w = tiff.layout(f)
    out = np.full((w.bands, w.height, w.width), np.nan)
    for d in range(w.down):
        for a in range(w.across):
            b = tiff.block(f, w, d, a)
            out[:, d * w.block_height : d * w.block_height + b.shape[1], a * w.block_width : a * w.block_width + b.shape[2]] = b
    f.close()
    return out, w


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4", "f4", "f8"])
def test_hand_made_files(tmp_path, order, kind):
    r = np.random.default_rng(3)
    data = (r.random((2, 29, 37)) * 200 - (kind[0] != "u") * 100).astype(kind)
    for i, (tile, separate, deflate, predictor) in enumerate([(None, False, True, 1), ((16, 16), False, True, 2), (None, True, False, 1), ((16, 32), True, True, 2 if kind[0] != "f" else 1)]):
        if predictor == 2 and kind[0] == "f":
            predictor = 1
        made(path := tmp_path / f"{i}.tif", data, order, tile, 5, deflate, predictor, separate)
        got, w = whole(path)
        assert np.array_equal(got, data.astype(float)) and w.grid().same_as(GRID)


def test_both_nodata_rules_and_windows_touch_their_blocks(tmp_path):
    data = np.arange(29 * 37, dtype=np.float32).reshape(1, 29, 37)
    data[0, 6, :6] = [-9999, np.nan, 3e38, -3e38, np.inf, 5]
    made(path := str(tmp_path / "a.tif"), data, strip=5, nodata=-9999)

    def rows(**o):
        q = raster.RasterReader({"path": path, **o}, 1)
        return [x for p in q.partitions() for b in q.read(p) for x in b.to_pylist()]

    of = lambda rs: [next(x["band_1"] for x in rs if (x["grid_row"], x["grid_col"]) == (6, c)) for c in range(6)]
    assert of(rows()) == [None, None, None, None, None, 5.0]
    low = of(rows(nodata="low"))
    assert low[0] == -9999 and low[1] is None and low[2] > 1e38 and low[3] is None and low[5] == 5

    q = raster.RasterReader({"path": path, "window": "-8.0,34.1,-6.1,35.9"}, 1)  # rows 8 to 11: strips 1 and 2 of 6
    cells = [x for p in q.partitions() for b in q.read(p) for x in b.to_pylist()]
    assert q.blocks_read == 2 and {x["grid_row"] for x in cells} == {8, 9, 10, 11} and {x["grid_col"] for x in cells} == {4, 5, 6, 7}
    with pytest.raises(ValueError, match="outside the grid"):
        raster.RasterReader({"path": path, "window": "50,0,60,1"}, 1).partitions()

    q = raster.PushedReader({"path": path}, 1)
    kept = list(q.pushFilters([GreaterThanOrEqual(("grid_row",), 20), LessThan(("grid_row",), 25), EqualTo(("grid_col",), 3)]))
    cells = [x for p in q.partitions() for b in q.read(p) for x in b.to_pylist()]
    assert len(kept) == 3 and q.blocks_read == 1 and [(x["grid_row"], x["grid_col"]) for x in cells] == [(r, 3) for r in range(20, 25)]


def test_partitions_are_ranges_of_blocks(tmp_path, monkeypatch):
    made(path := str(tmp_path / "a.tif"), np.ones((2, 29, 37), np.float32), tile=(16, 16))
    monkeypatch.setattr(raster, "PARTITION_BYTES", 1)
    assert [(p.first, p.last) for p in raster.RasterReader({"path": path}, 2).partitions()] == [(0, 1), (1, 2)]


def test_archives_by_ranges(tmp_path):
    r = np.random.default_rng(1)
    big = (r.random((1, 29, 37)) * 100).astype(np.float32)
    made(tmp_path / "b1.tif", big, strip=1, deflate=False)
    made(tmp_path / "b2.tif", big + 1)
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("notes.txt", "x" * 5_000_000, zipfile.ZIP_STORED)
        z.write(tmp_path / "b1.tif", "in/b1.tif", zipfile.ZIP_STORED)
        z.write(tmp_path / "b2.tif", "in/b2.tif", zipfile.ZIP_DEFLATED)
    assert [m for _, m in members(f"{path}!in/*.tif")] == ["in/b1.tif", "in/b2.tif"]
    for name, want in (("in/b1.tif", big), ("in/b2.tif", big + 1)):
        f = opened(path, name)
        w = tiff.layout(f)
        got = np.concatenate([tiff.block(f, w, d, 0) for d in range(w.down)], axis=1)
        assert np.array_equal(got, want) and f.archive.read_bytes < 300_000
    f = opened(path, "in/b1.tif")
    w = tiff.layout(f)
    before = f.archive.read_bytes
    tiff.block(f, w, 7, 0)
    assert f.archive.read_bytes - before == 37 * 4  # a row of the stored member
    with pytest.raises(ValueError, match="not a ZIP"):
        directory(RangedFile(str(tmp_path / "b1.tif")))
    with pytest.raises(FileNotFoundError):
        opened(path, "other")


def test_archive_as_a_table(spark, tmp_path):
    for k in (1, 2):
        made(tmp_path / f"wc_{k}.tif", np.full((1, 29, 37), k, np.int16))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in (1, 2):
            z.write(tmp_path / f"wc_{k}.tif", f"wc_{k}.tif")
    got = raster.read_raster(spark, f"{tmp_path}/a.zip!wc_*.tif", window=(-10, 39, -9, 40))
    assert [tuple(r) for r in got.groupBy("member").agg(F.count("*"), F.avg("band_1")).orderBy("member").collect()] == [("wc_1.tif", 4, 1.0), ("wc_2.tif", 4, 2.0)]


@pytest.mark.parametrize("tiled,predictor", [(True, 1), (True, 3), (False, 3)])
def test_round_trip(spark, tmp_path, tiled, predictor):
    cells = spark.range(37 * 29).select((F.col("id") / 37).cast("int").alias("grid_row"), (F.col("id") % 37).cast("int").alias("grid_col"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("p"), (F.col("id") % 2).alias("yes")).where("grid_row <> 20 and not (grid_row < 16 and grid_col < 16)")
    path = str(tmp_path / "out.tif")
    raster.write_raster(cells, path, GRID, ["p", "yes"], (16, 16), tiled, predictor)
    assert raster.raster_grid(path) == Grid("raster", 37, 29, -10.0, 0.5, 40.0, -0.5) and os.listdir(tmp_path) == ["out.tif"]
    got = {(r.grid_row, r.grid_col): (r.band_1, r.band_2) for r in raster.read_raster(spark, path).collect()}
    want = {(r.grid_row, r.grid_col): (None if r.p is None else float(np.float32(r.p)), float(r.yes)) for r in cells.collect()}
    assert got == {(r, c): want.get((r, c), (None, None)) for r in range(29) for c in range(37)}
    some = raster.read_raster(spark, path).where("grid_row >= 17 and grid_row < 19 and grid_col = 5")
    assert sorted(r.grid_row for r in some.collect()) == [17, 18]
    if tiled:
        assert whole(path)[1].offsets[0] == 0  # a block without cells takes no space
    with pytest.raises(Exception, match="out.tif"):
        raster.write_raster(cells, path, GRID, ["p"], (16, 16))
    raster.write_raster(cells, path, GRID, ["p"], (16, 16), overwrite=True)
    assert whole(path)[1].bands == 1
    with pytest.raises(Exception, match="two rows for a cell"):
        raster.write_raster(cells.unionByName(cells), str(tmp_path / "twice.tif"), GRID, ["p"], (16, 16))
    assert os.listdir(tmp_path) == ["out.tif"]


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    import pyarrow as pa

    o = {"path": str(tmp_path / "a.tif"), "width": "20", "height": "16", "transform": "0,1,16,-1", "block_rows": "16", "block_cols": "16", "tiled": "true"}
    w = raster.RasterWriter(o, ["block", "grid_row", "grid_col", "v"], False)
    batch = lambda b, c: pa.RecordBatch.from_pydict({"block": pa.array([b] * 2, pa.int64()), "grid_row": pa.array([0, 1], pa.int32()), "grid_col": pa.array([c, c], pa.int32()), "v": [1.0, None]})
    lost, once = w.write(iter([batch(0, 3)])), w.write(iter([batch(0, 3)]))
    other = w.write(iter([batch(1, 17)]))
    assert lost.part != once.part
    w.commit([once, None, other])
    assert os.listdir(tmp_path) == ["a.tif"] and np.nansum(whole(o["path"])[0]) == 2
    w = raster.RasterWriter(o | {"path": str(tmp_path / "b.tif")}, ["block", "grid_row", "grid_col", "v"], False)
    w.write(iter([batch(0, 3)]))
    w.abort([])
    assert os.listdir(tmp_path) == ["a.tif"]


def test_wide_files(tmp_path, monkeypatch):
    """The 64-bit head is read as it is written."""
    head, _ = tiff.header(Grid("g", 16, 16, 0.0, 1.0, 16.0, -1.0), 1, (16, 16), [5_000_000_000])
    (tmp_path / "w.tif").write_bytes(head)
    w = tiff.layout(opened(str(tmp_path / "w.tif")))
    assert (w.width, w.bands, w.sizes, w.offsets) == (16, 1, (5_000_000_000,), (len(head),)) and np.isnan(w.nodata)
