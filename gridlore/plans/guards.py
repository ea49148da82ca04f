"""Checks of a plan before it runs: forbidden predictors, the order of the features, unused layers."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of names and paths of predictors that describe what already grows somewhere, and the file that forbids training on a folder.
FORBIDDEN = ("satellite", "ndvi", "landcover", "land_cover", "vegetation", "treecover", "tree_frac", "evi", "lai", "greenness", "provenance", "source_flag")
MARKER = "DO_NOT_TRAIN_ON_THIS.md"
_allowed: list[str] = []


@contextmanager
def allow_vegetation(reason: str):
    """The one way round the guard, with a reason that is kept."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    _allowed.append(reason)
    try:
        yield
    finally:
        _allowed.pop()


def marker_of(spark: SparkSession, path: str) -> str | None:
    """The marker file in the folder of a path or in any folder above it, in whatever file system the path is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = store.makeQualified(at)
    while at is not None:
        if store.isFile(marker := hadoop.Path(at, MARKER)):
            return marker.toString()
        at = at.getParent()
    return None


def assert_trainable(names: Sequence[str], spark: SparkSession | None = None) -> None:
    """No forbidden word anywhere in a part of a layer's name or path and, with a session, no marker above it."""
    if _allowed:
        return
    bad = [n for n in names if any(token in n.lower() for token in FORBIDDEN)]
    if spark is not None:
        bad += [n for n in names if n not in bad and marker_of(spark, n)]
    if bad:
        raise ValueError(f"not for training: {', '.join(bad)}")


def assert_inside(lat: float, lon: float, envelope: tuple[float, float, float, float]) -> None:
    """A pin lies in the envelope (west, south, east, north), its edges included."""
    west, south, east, north = envelope
    if not (south <= lat <= north and west <= lon <= east):
        raise ValueError(f"{lat}, {lon} lies outside of the area covered")


def layer_gate(needed: Sequence[str], layers: Sequence[str], most_missing: int = 15) -> Column:
    """Why a site can't be scored: a needed layer is missing, or more than most_missing of all are; null where it can."""
    missing = lambda cols: F.size(F.filter(F.array(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols]), lambda x: x))
    return F.when(missing(needed) > 0, F.lit("needed layer missing")).when(missing(layers) > most_missing, F.lit("too many layers missing"))


def assert_contract(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The columns of a feature table are the contract's, in its order."""
    own = [c for c in df.columns if c in set(features)]
    if own != list(features):
        raise ValueError("features are missing or in another order")
    return df


def unused(listing: DataFrame, catalog: DataFrame, key: str = "path") -> DataFrame:
    """Layers that are there and not in the catalog."""
    return listing.join(catalog.select(key), key, "left_anti")
