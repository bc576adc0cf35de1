"""Staged copies and what they leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from docuvet.session import CLEAN_SHUFFLES, materialize


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f"{d}/{f.name}" for d in manager.localDirsString() for f in Path(str(d)).rglob("shuffle_*.data")}


def test_a_staged_write_leaves_no_shuffle_files(spark):
    """The shuffles of a staged table go with its write; those of later queries on it stay as they were."""
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_SHUFFLES, "false")
    rows = spark.range(20_000).repartition(4).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s"))
    staged = materialize(rows, "shuffled")
    for _ in range(50):  # deletion is asynchronous
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEAN_SHUFFLES, "false") == setting
    assert staged.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2
    assert rows.count() == 999  # the same frame can be run again
