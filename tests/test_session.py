import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bandstream.session import DROP_SHUFFLES, scratch_path, stored


def session(master, setting=None, checkpoint=None):
    found = {"spark.checkpoint.dir": setting}
    context = SimpleNamespace(master=master, folder=checkpoint)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda folder: setattr(context, "folder", folder)
    conf = SimpleNamespace(get=lambda name, default: found[name] or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_setting_comes_first():
    assert scratch_path(session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert scratch_path(session("yarn", None, "s3a://c/d"), "x").startswith("s3a://c/d/x-")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        scratch_path(session(master), "x")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_process_may_use_its_own(master):
    assert "/x-" in scratch_path(session(master), "x")


def test_stored_rows_come_back(spark):
    df = spark.range(5).selectExpr("id", "id * 2 AS twice")
    again = stored(df, "numbers")
    assert sorted(map(tuple, again.collect())) == [(i, 2 * i) for i in range(5)]
    assert again.inputFiles() and again.schema.names == df.schema.names


def test_stored_tables_drop_their_shuffles(spark):
    """They stayed on disk until the driver collected its garbage."""

    def held():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
        blocks = manager.diskBlockManager().getAllBlocks()
        names = {blocks.apply(i).name() for i in range(blocks.size())}
        return {n for n in names if n.startswith("shuffle_")}

    before, setting = held(), spark.conf.get(DROP_SHUFFLES)
    counted = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    assert sorted(r["count"] for r in counted.collect())[0] == 142
    until = time.time() + 10
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(DROP_SHUFFLES) == setting
