"""Step latencies of cases as their events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed


def _actions() -> list[str]:
    return list(dict.fromkeys(a for step in fixed.LATENCY_STEPS for a in step[:2]))


def _steps(stamps: DataFrame) -> DataFrame:
    """Each completed step of a case: when it ended and how long it took."""
    steps = []
    for start, end, label in fixed.LATENCY_STEPS:
        took = F.col(end) - F.col(start)
        steps.append(F.struct(F.lit(label).alias("module"), F.timestamp_micros(F.col(end)).alias("completed_at"),
                              F.when(took >= 0, took).alias("micros")))
    complete = stamps.where(F.col("FACE_VERIFIED").isNotNull())
    return complete.select("case_id", F.explode(F.array(*steps)).alias("s")).where(
        F.col("s.micros").isNotNull()).select("case_id", "s.module", "s.completed_at", "s.micros")


def _stamped(grouped) -> DataFrame:
    return grouped.agg(*[F.max(F.when(F.col("action") == a, F.unix_micros("event_ts"))).alias(a) for a in _actions()])


def case_steps(events: DataFrame) -> DataFrame:
    """Completed steps of the cases in a bounded table; repeated event ids count once."""
    events = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).dropDuplicates(["seq"])
    return _steps(_stamped(events.where(F.col("action").isin(*_actions())).groupBy("case_id")))


def stream_case_steps(events: DataFrame, quiet: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Completed steps of each case, once it has been quiet for a while.

    A case's events form one session, wherever days or other windows begin. Events are
    accepted up to ``late`` after newer ones and repeated ids are dropped; a case leaves
    the state when the watermark is ``quiet`` past its last event. The rows go to an
    append-only table, over which :func:`latency_by_window` is a plain aggregate.
    """
    source = (
        events.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
        .withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["seq"])
    )
    session = F.session_window("event_ts", quiet)
    return _steps(_stamped(source.where(F.col("action").isin(*_actions())).groupBy(session, "case_id")))


def latency_by_window(steps: DataFrame, window: str = "1 day") -> DataFrame:
    """Mean step latency per window in which the steps ended."""
    grouped = steps.groupBy(F.window("completed_at", window).alias("w"), "module")
    return grouped.agg(F.count("*").alias("sample_count"), F.sum("micros").alias("micros")).select(
        F.col("w.start").alias("window_start"), "module", "sample_count",
        (F.col("micros") / F.col("sample_count") / 1000.0).alias("time_ms"),
    )


def closing_event(events: DataFrame, quiet: str = "1 day", late: str = "2 hours") -> DataFrame:
    """One row that ends every session of a bounded source: an event of no case, long after the newest one."""
    newest = events.agg(F.max(F.col("event_ts").cast("timestamp")).alias("t"))
    after = F.col("t") + F.expr(f"interval {quiet}") + F.expr(f"interval {late}") + F.expr("interval 1 second")
    made = {"seq": F.lit(-1).cast("long"), "event_ts": after, "action": F.lit("END_OF_SOURCE")}
    return newest.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
