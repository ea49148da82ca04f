"""The shared folder: one qualified path for Spark's tables and our own files."""

import pytest

from gridlore.llm import shared


class Named:
    """A session that names its folder."""

    def __init__(self, spark, path):
        self._spark, self.conf = spark, type("Conf", (), {"get": staticmethod(lambda key, default: path)})

    def __getattr__(self, name):
        return getattr(self._spark, name)


def test_paths_without_a_scheme_are_qualified(spark, tmp_path):
    root = shared.shared_dir(Named(spark, str(tmp_path)))
    assert root == f"file:{tmp_path}/gridlore-{spark.sparkContext.applicationId}"
    folder = shared.Folder(f"{root}/files")
    assert folder.local == f"{root[5:]}/files" and folder.write("a", [b"12", b"3"]) == 3
    with folder.open("a") as f:
        assert f.read() == b"123"
    spark.range(5).write.parquet(f"{root}/five")
    assert (tmp_path / root.rsplit("/", 1)[1] / "five" / "_SUCCESS").exists()


def test_a_folder_set_at_run_time_counts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert shared.shared_dir(spark).startswith(f"file:{tmp_path}/") or spark.conf.get("spark.checkpoint.dir", None)
        assert shared.stage(spark.range(5).toDF("x"), "five").count() == 5
    finally:
        spark.sparkContext.setCheckpointDir(shared.FALLBACK_DIR)


def test_a_cluster_must_name_the_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_fewer_shuffles_and_back(spark):
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), shared.shuffles_for(spark, 10):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= int(asked)
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == asked
