"""Where lineage is cut."""

from types import SimpleNamespace

import pytest

from updraft.session import shared_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, named=None, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: named or default)
    return SimpleNamespace(conf=conf, sparkContext=Context(master, folder))


def test_the_configured_folder_is_used():
    fake = session("yarn", named="hdfs://shared/checkpoints")
    assert shared_dir(fake) == fake.sparkContext.folder == "hdfs://shared/checkpoints"


def test_a_folder_set_before_is_kept():
    assert shared_dir(session("yarn", folder="s3://set-by-user")) == "s3://set-by-user"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError):
        shared_dir(session("spark://host:7077"))


def test_local_mode_may_use_a_temporary_folder():
    fake = session("local[2]")
    assert "updraft-checkpoint-" in shared_dir(fake) and fake.sparkContext.folder
