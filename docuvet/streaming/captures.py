"""Per micro-batch: search the gallery, add the new faces, seal the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gallery import gallery_hits
from ..operators.ledger import seal_events

GALLERY = "case_id bigint, embedding array<float>"
HEADS = "chain_id bigint, head_hash string"


#: Batches between two snapshots of a state table.
SNAPSHOT_EVERY = 16


def _state(spark: SparkSession, out: str, name: str, schema: str, key: str, value: str, batch_id: int) -> DataFrame:
    """The newest ``value`` of each key before this batch: the last snapshot and the batches since.

    Which folders are read follows from the batch id, so a replay sees what the first
    run saw, and no batch reads more than one snapshot and ``SNAPSHOT_EVERY`` others.
    """

    def newest(snapshot: int, until: int) -> DataFrame:
        rows = spark.createDataFrame([], f"{schema}, batch_id bigint")
        if snapshot:
            held = spark.read.schema(schema).parquet(f"{out}/{name}_snapshots/until={snapshot}")
            rows = rows.unionByName(held.withColumn("batch_id", F.lit(-1).cast("long")))
        if until > snapshot:
            paths = [f"{out}/{name}/batch_id={i}" for i in range(snapshot, until)]
            rows = rows.unionByName(
                spark.read.schema(f"{schema}, batch_id bigint").option("basePath", f"{out}/{name}").parquet(*paths))
        return rows.groupBy(key).agg(F.max_by(value, "batch_id").alias(value))

    snapshot = batch_id // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    if snapshot and snapshot == batch_id:
        newest(snapshot - SNAPSHOT_EVERY, snapshot).write.mode("overwrite").parquet(f"{out}/{name}_snapshots/until={snapshot}")
    return newest(snapshot, batch_id)


def stream_captures(captures: DataFrame, out: str, checkpoint: str, threshold: float, **trigger) -> StreamingQuery:
    """``captures``: seq, event_ts, case_id, chain_id, embedding, metadata.

    State lives in tables of ``out`` partitioned by batch id: gallery rows, hits, sealed
    events and the new chain heads; snapshots fold the gallery and the heads now and then. Every write overwrites its
    own batch folder and reads only earlier ones, so replays are idempotent.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        newest = batch.groupBy("case_id").agg(F.max_by("embedding", F.struct("event_ts", "seq")).alias("embedding"))
        put(newest, "gallery")
        fresh = spark.read.schema(GALLERY).parquet(f"{out}/gallery/batch_id={batch_id}")
        known = _state(spark, out, "gallery", GALLERY, "case_id", "embedding", batch_id)
        # A case captured in this batch is represented by its new embedding only.
        known = known.join(fresh.select("case_id"), "case_id", "left_anti").unionByName(fresh)
        put(gallery_hits(fresh, known, threshold=threshold), "hits")
        heads = _state(spark, out, "heads", HEADS, "chain_id", "head_hash", batch_id)
        events = batch.select(
            "seq", "event_ts", "case_id", "chain_id", F.lit("FACE_VERIFIED").alias("action"),
            F.lit("AI-ENGINE").alias("actor"), "metadata",
        )
        put(seal_events(events, heads), "ledger")
        sealed = spark.read.parquet(f"{out}/ledger/batch_id={batch_id}")
        tips = sealed.groupBy("chain_id").agg(F.max_by("entry_hash", F.struct("event_ts", "seq")).alias("head_hash"))
        put(tips, "heads")
        batch.unpersist()

    return (
        captures.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
