"""Sinks: tables, reports, metrics with progress, images."""

from __future__ import annotations

import base64
import json
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_number


def write_clean(flagged: DataFrame, path: str) -> None:
    """Clean and rejected rows as Parquet; the commit protocol makes each appear whole or not at all."""
    flagged.where("drop_reason is null").drop("drop_reason").write.mode("overwrite").parquet(f"{path}/clean")
    flagged.where("drop_reason is not null").write.mode("overwrite").parquet(f"{path}/rejected")


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables small enough for one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append_progress(row: DataFrame, path: str) -> None:
    """A finished unit's row, appended: what is there survives a crash, the latest row of a key counts."""
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def safe_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; numbers that JSON lacks become null, the rest are rounded to six places."""
    cols = [json_number(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A picture from rows of red, green, blue and alpha bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgba[4 * width * y : 4 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def window_png(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int], most: int = 4_000_000) -> bytes:
    """The colours (r, g, b) of a window's cells; the window is checked to be small, as it is drawn on the driver."""
    h, w = rows[1] - rows[0] + 1, cols[1] - cols[0] + 1
    if h * w > most:
        raise ValueError("the window is too large for a picture")
    out = bytearray(4 * h * w)
    for c in cells.where(F.col("grid_row").between(*rows) & F.col("grid_col").between(*cols)).select("grid_row", "grid_col", "r", "g", "b").toLocalIterator():
        i = 4 * ((c[0] - rows[0]) * w + c[1] - cols[0])
        out[i : i + 4] = bytes((c[2], c[3], c[4], 255))
    return png(w, h, bytes(out))


def data_uri(picture: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(picture).decode()


def manifest(df: DataFrame, **facts) -> DataFrame:
    """One row: number of rows, columns, and given facts as JSON."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(json.dumps(facts, sort_keys=True)).alias("facts"))
