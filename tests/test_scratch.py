import os

from pyspark.sql import functions as F

from tidelog.session import SHUFFLE_CLEANUP, Scratch


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark, "test")
    first = scratch.put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "first")
    second = scratch.put(first.withColumn("k", F.col("k") + 1), "second")
    folder = scratch.root.removeprefix("file://")
    scratch.drop("first")
    assert os.listdir(folder) == ["second"]
    assert sorted(r["k"] for r in second.collect()) == list(range(1, 8))
    scratch.close()
    assert not os.path.exists(folder)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
