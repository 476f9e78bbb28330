import time
from pathlib import Path

from pyspark.sql import functions as F

from tidemark import session
from tidemark.session import cut_lineage


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return files.toString().count("shuffle_")


def test_stored_results_leave_no_shuffle_files(spark):
    cut_lineage(spark.range(10))
    before = shuffle_files(spark)
    groups = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = cut_lineage(groups)
    assert shuffle_files(spark) <= before
    assert stored.count() == 100 and stored.join(groups, "k").count() == 100


def test_stored_results_out_of_use_are_removed(spark):
    cut_lineage(spark.range(10))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    used = cut_lineage(spark.range(7))
    session.release_unused(spark.sparkContext)
    time.sleep(2)
    before = len(list(folder.glob("rdd-*")))
    for _ in range(3 * session.COLLECT_EVERY):
        cut_lineage(spark.range(10))
    time.sleep(2)
    assert len(list(folder.glob("rdd-*"))) <= before + session.COLLECT_EVERY + 1
    assert used.count() == 7
