"""Readers of published tables see a whole rewrite or none of it."""

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from docuvet.plans import registry
from docuvet.session import children, scratch_dir
from docuvet.sources import published

SCHEMA = "case_id long, label string"


@pytest.fixture
def table(spark):
    root = scratch_dir(spark, "published-test")
    assert published.publish(spark.range(40).select(F.col("id").alias("case_id"), F.lit("old").alias("label")), root, 8) == 1
    return root


def seen(spark, root, version=None):
    return sorted((r.case_id, r.label) for r in published.read_published(spark, root, SCHEMA, version).collect())


def test_cases_are_replaced_and_old_versions_stay_readable(spark, table):
    new = spark.createDataFrame([(3, "new"), (3, "newer"), (77, "new")], SCHEMA)
    assert published.replace_cases(new, table, SCHEMA, 8) == 2
    want = sorted([(i, "old") for i in range(40) if i != 3] + [(3, "new"), (3, "newer"), (77, "new")])
    assert seen(spark, table) == want and seen(spark, table, 1) == [(i, "old") for i in range(40)]
    assert published.replace_cases(new, table, SCHEMA, 8) == 3 and seen(spark, table) == want  # again: nothing more changes


def test_a_writer_that_fails_between_buckets_changes_nothing(spark, table):
    @F.udf("string")
    def breaks(case_id):
        if case_id == 17:
            raise RuntimeError("executor lost")
        return "half"

    broken = spark.range(40).select(F.col("id").alias("case_id"), breaks("id").alias("label"))
    before = seen(spark, table)
    with pytest.raises(Exception):
        published.publish(broken, table, 8)
    assert len(children(spark, f"{table}/manifests")) == 1 and seen(spark, table) == before
    # a manifest without its mark of success is not read either
    spark.createDataFrame([(0, "nowhere")], "bucket int, folder string").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table}/manifests/version=9")
    assert seen(spark, table) == before


def test_an_empty_table_and_an_emptied_bucket(spark, table):
    assert seen(spark, scratch_dir(spark, "nothing")) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert published.replace_cases(empty, table, SCHEMA, 8) == 2 and len(seen(spark, table)) == 40
    published.publish(empty, table, 8, drop=list(range(8)))
    assert seen(spark, table) == []


def test_query_matches_its_twin(spark, sf_dir):
    key = "a8_published_replacement"
    difference = compare(registry.queries()[key](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[key])
    assert difference is None, difference
