"""Intermediate tables lie in the shared folder and can be dropped."""

import os

import pytest

from tideline.llm import common


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="share"):
        common.scratch_dir(Session)


def test_written_tables_can_be_dropped(spark):
    df = common.materialise(spark.range(3).selectExpr("id", "id % 2 AS part"), by="part")
    assert df.written_to.startswith(spark.conf.get("spark.checkpoint.dir")) and sorted(map(tuple, df.collect())) == [(0, 0), (1, 1), (2, 0)]
    assert sorted(x for x in os.listdir(df.written_to) if x.startswith("part=")) == ["part=0", "part=1"]
    common.discard(df)
    assert not os.path.exists(df.written_to)
