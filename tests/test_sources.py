"""Tiles, searches, sinks, shapes, names and stages on hand-made inputs."""

import struct
import zlib

import pytest

from gridlore.functions.grid import Grid
from gridlore.operators import landcover, shapes, taxonomy
from gridlore.plans import stages
from gridlore.sources import rest, sinks, tiles


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return 2 * n if n >= 0 else -2 * n - 1


def tile(points, extent=512):
    layer = field(3, b"other") + field(3, b"total") + field(5, extent)
    for k, (shape, total) in enumerate(points):
        layer += field(4, field(4, total))
        geo, x, y = varint(len(shape) << 3 | 1), 0, 0
        for px, py in shape:
            geo, x, y = geo + varint(zigzag(px - x)) + varint(zigzag(py - y)), px, py
        layer += field(2, field(2, varint(1) + varint(k)) + field(4, geo))
    return field(3, layer)


def test_tiles(spark):
    raw = tile([([(3, 4)], 7), ([(-2, 5)], 9), ([(10, 10), (511, 0)], 6)])
    df = spark.createDataFrame([(1, 0, 0, bytearray(raw)), (1, 1, 0, None)], "z int, x int, y int, content binary")
    got = sorted((r["x"], r["y"], r["total"]) for r in tiles.decode(df).collect())
    assert got == [(3, 4, 7.0), (10, 10, 3.0), (511, 0, 3.0)]
    b = tiles.boxes(tiles.decode(df)).orderBy("west").first()
    assert b["west"] == -180 + 3 / 512 * 90 and b["north"] == 90 - 4 / 512 * 90


def fake(query, offset, limit):
    rows = [(query["species"], 1.0 * i, 2.0, 2000, "US", "H", None) for i in range(offset, min(offset + limit, 7))]
    return rows, offset + limit >= 7


def test_search_pages_and_retries(spark):
    waits, calls = [], []

    def shaky(query, offset, limit):
        calls.append(offset)
        if len(calls) < 3:
            raise OSError("down")
        return fake(query, offset, limit)

    assert len(list(rest.pages(shaky, {"species": "a"}, 3, 100, pause=waits.append))) == 7 and waits == [1.0, 1.8]
    with pytest.raises(OSError):
        list(rest.pages(lambda *a: (_ for _ in ()).throw(OSError()), {}, 3, 9, tries=2, pause=waits.append))
    assert len(list(rest.pages(fake, {"species": "a"}, 3, 5))) == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "x", float("nan"))], "rid int, drop_reason string, v double")
    sinks.write_clean(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/clean")).count() == 1
    assert [r["json"] for r in sinks.safe_json(df).orderBy("json").collect()][1] == '{"rid":2,"drop_reason":"x","v":null}'
    sinks.append_progress(df.limit(1), str(tmp_path / "p"))
    sinks.append_progress(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    p = sinks.png(2, 1, bytes(8))
    assert p[16:24] == struct.pack(">II", 2, 1) and zlib.decompress(p[41:-16]) == bytes(9)
    pic = spark.createDataFrame([(0, 0, 1, 2, 3)], "grid_row int, grid_col int, r int, g int, b int")
    assert sinks.data_uri(sinks.window_png(pic, (0, 1), (0, 1))).startswith("data:image/png;base64,")


def test_shapes(spark):
    boxes = [(0, 0, 5, 5), (20, 0, 21, 1), (8, 0, 9, 1), (12, 0, 13, 1)]
    parts = spark.createDataFrame([(k, i, 9.0 - i, *map(float, b)) for k in (1, 2) for i, b in enumerate(boxes) if k == 1 or i < 2], "shape int, part int, area double, west double, south double, east double, north double")
    got = shapes.cluster_parts(parts, 3.5)
    assert sorted((r["shape"], r["part"]) for r in got.collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)] and got.columns == parts.columns
    assert shapes.cluster_parts(parts.where("false")).count() == 0
    g = Grid("t", 10, 10, 0.0, 1.0, 10.0, -1.0)
    square = [[(1.5, 8.5), (3.5, 8.5), (3.5, 6.5), (1.5, 6.5)]]
    assert {tuple(x) for x in shapes.touched_cells(square, g).tolist()} == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3)}
    big = [[(0.2, 9.8), (9.8, 9.8), (9.8, 0.2), (0.2, 0.2)], [(3.2, 6.8), (6.8, 6.8), (6.8, 3.2), (3.2, 3.2)]]
    cells = {tuple(x) for x in shapes.touched_cells(big, g).tolist()}
    assert len(cells) == 96 and (4, 4) not in cells and (3, 3) in cells


def test_homonyms(spark):
    c = spark.createDataFrame([(1, "Cedrus", "GENUS", "Plantae", "Tracheophyta", "ACCEPTED", "Pinaceae"), (2, "Cedrus", "GENUS", "Plantae", "Tracheophyta", "SYNONYM", "M"), (3, "Two", "GENUS", "Plantae", "Tracheophyta", "ACCEPTED", "A"), (4, "Two", "GENUS", "Plantae", "Tracheophyta", "ACCEPTED", "B")], "key int, canonicalName string, rank string, kingdom string, phylum string, status string, family string")
    got = {r["name"]: (r["key"], r["problem"]) for r in taxonomy.homonyms(spark.createDataFrame([("cedrus",), ("Two",), ("None",)], "name string"), c).collect()}
    assert got == {"cedrus": (1, None), "Two": (None if got["Two"][0] is None else got["Two"][0], "several accepted genera"), "None": (None, "no accepted genus")} and got["Two"][0] is None


def test_stages(spark, tmp_path):
    made = []
    stage = lambda n, after=(): stages.Stage(n, str(tmp_path / n), lambda s: (made.append(n), s.range(1).write.parquet(str(tmp_path / n))), after)
    todo = [stage("b", ("a",)), stage("a")]
    assert stages.run(spark, todo) == {"a": "ran", "b": "ran"} and made == ["a", "b"]
    assert set(stages.run(spark, todo).values()) == {"skipped"}
    with pytest.raises(ValueError):
        stages.order([stage("x", ("y",))])


def test_smoothing_ladder(spark):
    df = spark.range(36).selectExpr("cast(id div 6 as int) grid_row", "cast(id % 6 as int) grid_col", "cast(if(id = 14, 9, 0) as double) v")
    assert landcover.smoothing_ladder(df, "v", [(0, 0), (1, 1), (2, 2)], 6, 6) in {(1, 1), (2, 2)}
    assert landcover.half_widths(10.0, 1 / 120, 40.0)[1] > landcover.half_widths(10.0, 1 / 120, 40.0)[0]
