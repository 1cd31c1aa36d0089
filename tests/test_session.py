"""Where intermediate tables go."""

import os

import pytest

from tonelake import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Session:
    def __init__(self, master, folder=None, app="a"):
        self.conf = Conf(folder)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": app})


def test_folder_from_the_session():
    one, two = (session.shared_dir(Session("yarn", "s3a://x/y/"), "t") for _ in range(2))
    assert one != two and one.startswith("s3a://x/y/t-")


def test_no_local_folder_on_a_cluster():
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master), "t")


def test_one_local_folder_for_a_session():
    folders = {session.shared_dir(Session("local[4]", app="b"), "t").rpartition("/")[0] for _ in range(3)}
    assert len(folders) == 1


def test_spread(spark):
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=50)
    assert session.spread(many) is many


def test_release(spark):
    rows = session.stored(spark.range(3), "kept")
    folder = rows.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert rows.count() == 3 and os.path.isdir(folder)
    assert session.release(spark) >= 1 and not os.path.exists(folder)
    assert session.release(spark) == 0
    assert session.stored(spark.range(2), "again").count() == 2
