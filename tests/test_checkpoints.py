"""Checkpoints: meta last, resumed runs, folders that a reader refuses."""

import glob
import json
import os

import pytest

from gridlore.sources import checkpoints

SCHEMA = "species string, v int"


def test_written_read_and_replaced(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(f"sp {k}/é", i) for k in range(3) for i in range(k + 1)] + [(None, 1)], SCHEMA)
    assert checkpoints.write_checkpoints(df, root) == ["sp 0/é", "sp 1/é", "sp 2/é"]
    rows, wrong = checkpoints.read_checkpoints(spark, root, SCHEMA)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.where("species is not null").collect())) and wrong == []
    checkpoints.write_checkpoints(spark.createDataFrame([("sp 1/é", 50)], SCHEMA), root)
    rows = checkpoints.read_checkpoints(spark, root, SCHEMA)[0]
    assert [r.v for r in rows.where("species = 'sp 1/é'").collect()] == [50] and rows.count() == 5
    assert not glob.glob(f"{root}/.*.part") and checkpoints.read_checkpoints(spark, str(tmp_path / "none"), SCHEMA)[0].count() == 0


def test_a_run_that_dies_leaves_whole_keys_and_is_resumed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(f"s{k}", i) for k in range(4) for i in range(5)], SCHEMA)
    put, calls = checkpoints._put, []

    def dies(*a):
        calls.append(a)
        if len(calls) == 3:
            raise RuntimeError("killed")
        put(*a)

    monkeypatch.setattr(checkpoints, "_put", dies)
    with pytest.raises(RuntimeError):
        checkpoints.write_checkpoints(df, root)
    monkeypatch.setattr(checkpoints, "_put", put)
    rows, wrong = checkpoints.read_checkpoints(spark, root, SCHEMA)
    assert {r.species for r in rows.collect()} == {"s0", "s1"} and rows.count() == 10 and wrong == []  # s2 has no meta yet
    left = checkpoints.unfinished(df.select("species").distinct(), root)
    assert {r.species for r in left.collect()} == {"s2", "s3"}
    checkpoints.write_checkpoints(df.join(left, "species", "left_semi"), root)
    assert checkpoints.read_checkpoints(spark, root, SCHEMA)[0].count() == 20 and checkpoints.unfinished(df.select("species").distinct(), root).count() == 0


def test_folders_that_a_reader_refuses(spark, tmp_path):
    root = str(tmp_path / "root")
    checkpoints.write_checkpoints(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], SCHEMA), root)
    home = next(h for h, m in checkpoints.metas(spark, root).items() if m["key"] == "a")[5:]
    with open(f"{home}/{checkpoints.META}", "w") as f:
        json.dump({"key": "a", "rows": 3, "version": "1"}, f)
    crc = f"{home}/.{checkpoints.META}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    rows, wrong = checkpoints.read_checkpoints(spark, root, SCHEMA)
    assert [r.species for r in rows.collect()] == ["b"] and wrong == ["a"]
    assert checkpoints.metas(spark, root, "2") == {} and len(checkpoints.metas(spark, root, None)) == 2
