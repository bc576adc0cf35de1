"""Screening of arriving cases against a watchlist that changes now and then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import keep_prepared, prepare_watchlist, watchlist_screen
from ..session import children

#: Names the current version of the watchlist, and reads one.
Versions = tuple[Callable[[SparkSession], int], Callable[[SparkSession, int], DataFrame]]


def watchlist_versions(folder: str, schema: str) -> Versions:
    """Versions kept as folders ``version=N``; a folder counts once its writer has left ``_SUCCESS`` in it."""

    def current(spark: SparkSession) -> int:
        numbers = [int(n.removeprefix("version=")) for n in children(spark, folder) if n.startswith("version=")]
        done = [n for n in numbers if "_SUCCESS" in children(spark, f"{folder}/version={n}")]
        if not done:
            raise FileNotFoundError(f"no finished version in {folder}")
        return max(done)

    return current, lambda spark, version: spark.read.schema(schema).parquet(f"{folder}/version={version}")


def stream_watchlist(
    arrivals: DataFrame, entries: DataFrame | Versions, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write each micro-batch's hits under its own folder of ``out``.

    A watchlist is prepared once per version, not once per micro-batch. With
    :func:`watchlist_versions` every micro-batch meets the version that is newest when it
    first runs; that number is noted beside ``out`` before anything is screened, so a
    replay meets the same version, overwrites the folder it wrote before, and a restart
    after a failure neither loses nor repeats hits. An entry added between two
    micro-batches hits later arrivals only.
    """
    current, read = entries if isinstance(entries, tuple) else ((lambda spark: 0), (lambda spark, version: entries))
    prepared: dict = {}

    def version_of(spark: SparkSession, batch_id: int) -> int:
        if not isinstance(entries, tuple):
            return 0
        noted = f"{out}-versions/batch_id={batch_id}"
        if "_SUCCESS" in children(spark, noted):
            return spark.read.schema("version long").parquet(noted).first()["version"]
        version = current(spark)
        spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(noted)
        return version

    def screen(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = version_of(spark, batch_id)
        if version not in prepared:
            prepared.clear()
            prepared[version] = keep_prepared(prepare_watchlist(read(spark, version)))
        watchlist_screen(batch, prepared[version]).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(screen).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
