from types import SimpleNamespace

import pytest

from linework.storage import shared_dir


def session(master, place=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: place), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("yarn", "hdfs:///tmp/x/")) == "hdfs:///tmp/x"
