"""Which folder steps are written to."""

import pytest

from recordflow import session


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, named=None, master="local[2]", folder=None):
        self.named, self.sparkContext = named, Context(master, folder)
        self.conf = self

    def get(self, key, default=None):
        return self.named or default


def test_the_named_folder_comes_first():
    assert session.shared_dir(Session("/shared/", "yarn", "/other")) == "/shared"
    assert session.shared_dir(Session(None, "yarn", "/other")) == "/other"


def test_a_temporary_folder_is_for_local_mode_only():
    local = Session()
    assert session.shared_dir(local) == session.shared_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(master="spark://host"))


def test_steps_go_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch(spark, "x").startswith(f"{folder}/recordflow-")
    assert session.materialize(spark.range(3)).count() == 3


def test_joined_partitions_stay_small(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
