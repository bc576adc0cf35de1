"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Parallelism is left to the cluster's own
# configuration; these only fix semantics and turn runtime re-planning on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows may hold long texts: keep what a Python worker gets at once small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


#: Whether a job's shuffle files go when it ends, and not only once the driver's memory is cleaned.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, extra: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docuvet")
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when driver and executors are one
    process; on a cluster the setting must name shared storage.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="docuvet-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df, *keys: str):
    """The rows dealt evenly, or by ``keys``, to as many tasks as a shuffle has, for work that takes much beside the bytes it reads."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_STAGED: list[str] = []


def materialize(df, purpose: str, folders: list[str] | None = None):
    """Write ``df`` once to the shared folder, in a folder for each value of ``folders``, and read it back (cuts lineage).

    The copy stays until :func:`clear_staged`, as results may still read it. What the
    write has shuffled is deleted with its end: the copy takes its place.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    _STAGED.append(path)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.partitionBy(*folders or []).parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark reaches; none if it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def discard(df) -> None:
    """Delete the staged copy that ``df`` reads, once nothing will read it any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        folder = next((p for p in _STAGED if f"{p.split(':', 1)[-1].lstrip('/')}/" in file), None)
        if folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            _STAGED.remove(folder)
            return


def clear_staged(spark: SparkSession) -> int:
    """Delete the staged copies of this process; call it once the results that read them are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _STAGED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        done += path.getFileSystem(conf).delete(path, True)
    return done
