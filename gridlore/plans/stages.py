"""A run of named stages: each is left out if its output is there, so a run that stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    output: str
    run: Callable[[SparkSession], None]
    after: tuple[str, ...] = ()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def order(stages: Sequence[Stage]) -> list[Stage]:
    """After what they need, otherwise as given; an error on a circle or an unknown name."""
    done, out, left = set(), [], list(stages)
    while left:
        ready = next((s for s in left if set(s.after) <= done), None)
        if ready is None:
            raise ValueError(f"no order for {', '.join(s.name for s in left)}")
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def run(spark: SparkSession, stages: Sequence[Stage], force: bool = False) -> dict[str, str]:
    """Name -> ran or skipped."""
    said = {}
    for s in order(stages):
        if not force and exists(spark, s.output):
            said[s.name] = "skipped"
        else:
            s.run(spark)
            said[s.name] = "ran"
    return said
