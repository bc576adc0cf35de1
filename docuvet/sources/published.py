"""Tables by case whose readers never see half a rewrite.

Rows lie in hash buckets of the case. A writer puts new buckets aside, in a folder of
its own, and then publishes one manifest that names the folder of every bucket. Readers
take the newest finished manifest, so they see all of a rewrite or nothing of it; what a
failed writer leaves behind is never named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import children
from .store import replace_per_case

_MANIFEST = "bucket int, folder string"


def _newest(spark: SparkSession, root: str) -> int:
    numbers = [int(n.removeprefix("version=")) for n in children(spark, f"{root}/manifests") if n.startswith("version=")]
    return max((n for n in numbers if "_SUCCESS" in children(spark, f"{root}/manifests/version={n}")), default=0)


def published_buckets(spark: SparkSession, root: str, version: int | None = None) -> dict[int, str]:
    """Folder of each bucket in a version (the newest if not named); the number of buckets bounds what is collected."""
    version = version or _newest(spark, root)
    if not version:
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/version={version}").collect()}


def read_published(spark: SparkSession, root: str, schema: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """All rows of a version, or those of some buckets."""
    folders = [f for b, f in sorted(published_buckets(spark, root, version).items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def publish(df: DataFrame, root: str, buckets: int, key: str = "case_id", drop: list[int] | None = None) -> int:
    """Write the buckets that ``df`` has rows for (and empty those in ``drop``) and publish them as one new version.

    Returns its number. ``buckets`` belongs to the table and must stay the same. One
    writer at a time: of two that start from the same version the second fails.
    """
    spark = df.sparkSession
    base = _newest(spark, root)
    folder = f"{root}/data/{base + 1}-{uuid.uuid4().hex}"
    df.withColumn("case_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("case_bucket").write.partitionBy(
        "case_bucket").parquet(folder)
    named = {b: f for b, f in published_buckets(spark, root, base).items() if b not in set(drop or [])}
    for name in children(spark, folder):
        if name.startswith("case_bucket="):
            named[int(name.removeprefix("case_bucket="))] = f"{folder}/{name}"
    # fails if another writer has published this number
    spark.createDataFrame(sorted(named.items()), _MANIFEST).coalesce(1).write.mode("error").parquet(f"{root}/manifests/version={base + 1}")
    return base + 1


def replace_cases(new: DataFrame, root: str, schema: str, buckets: int, key: str = "case_id") -> int:
    """All rows of the cases in ``new`` give way to its rows; only the buckets of these cases are rewritten."""
    spark = new.sparkSession
    touched = [r["b"] for r in new.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
    held = read_published(spark, root, schema, only=touched)
    return publish(replace_per_case(held, new.select(*held.columns), key), root, buckets, key, drop=touched)
