import os
import time
from types import SimpleNamespace

import pytest

from newsprep.session import kept, removed, shared_root, spread, work_dir


def fake(master, setting=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_the_setting_names_the_folder():
    assert shared_root(fake("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert work_dir(fake("yarn", "hdfs://x/shared"), "a").startswith("hdfs://x/shared/a-")


def test_only_a_local_master_may_go_without():
    local = fake("local[2]")
    assert shared_root(local) == shared_root(local)
    with pytest.raises(ValueError):
        shared_root(fake("yarn"))


def test_spread_leaves_wide_inputs_alone(spark, plan):
    assert "Exchange" not in plan(spread(spark.range(100, numPartitions=64)))
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_kept_table_leaves_no_shuffle_files(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {str(files.apply(i)) for files in [manager.getAllFiles()] for i in range(files.size())}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = names(), spark.conf.get(name)
    rows = kept(spark.range(100_000, numPartitions=3).repartition("id"), f"{tmp_path}/kept")
    for _ in range(50):  # files go in the background
        left = [f for f in names() - before if "shuffle_" in f and f.endswith(".data")]
        if not left:
            break
        time.sleep(0.2)
    assert left == [] and spark.conf.get(name) == setting
    assert rows.count() == 100_000 and rows.agg({"id": "sum"}).first()[0] == 4999950000
    removed(f"{tmp_path}/kept")
    assert not os.path.exists(f"{tmp_path}/kept")
