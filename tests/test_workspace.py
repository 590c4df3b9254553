from types import SimpleNamespace

import pytest

from sluiceway.workspace import checkpoint_dir, fresh_path


class Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def session(master, named=None, current=None):
    conf = SimpleNamespace(get=lambda key, default: named or default)
    return SimpleNamespace(sparkContext=Context(master, current), conf=conf)


def test_the_folder_the_session_names_is_used(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert "checkpoints" in checkpoint_dir(spark)
    cluster = session("spark://host", named="hdfs:///shared")
    assert checkpoint_dir(cluster) == cluster.sparkContext.current == "hdfs:///shared"
    assert checkpoint_dir(session("yarn", current="hdfs:///set")) == "hdfs:///set"


def test_a_local_folder_only_for_a_local_session():
    local = session("local[4]")
    assert checkpoint_dir(local) == checkpoint_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("yarn"))


def test_paths_do_not_collide(spark):
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
