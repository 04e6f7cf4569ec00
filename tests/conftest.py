import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stowline.session import build_session

    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Lower the limits so that small data takes the paths meant for large data."""
    def lower(hot=None, broadcast=None):
        if hot is not None:
            spark.conf.set("spark.stowline.hotRows", str(hot))
        if broadcast is not None:
            spark.conf.set("spark.stowline.broadcastRows", str(broadcast))

    yield lower
    spark.conf.unset("spark.stowline.hotRows")
    spark.conf.unset("spark.stowline.broadcastRows")


@pytest.fixture
def inventory(spark):
    """An inventory from (rel_path, content) pairs under a root."""
    def make(files, root="/lake"):
        return spark.createDataFrame(
            [(f"{root}/{rel}", rel, len(body.encode()), body) for rel, body in files],
            "path string, rel_path string, size bigint, content string")

    return make
