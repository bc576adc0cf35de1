"""State kept by key in the state store: completed steps of a case, heads of ledger chains.

State lies in RocksDB, which :func:`keyed_state` names for the queries started inside.
State is read and written for the keys that occur in a micro-batch, and travels beside
their rows. A Python call and a state of its own for each case would take most of the
time, so cases with neighbouring numbers share them, up to ``STRETCH`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from ..functions import fixed
from ..operators.ledger import payload_column

#: Cases with neighbouring numbers whose steps are kept in one state; a power of two.
STRETCH = 256

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _step_fold(steps: list[tuple[str, str, str]], needed: str, keep_ms: int, neighbours: bool) -> Callable:
    """Made inside a function, so that it travels with its tasks.

    The state of a stretch has one row of numbers for each open case: its place, the first stamp of
    each action, the steps that have left as bits, the newest stamp in ms.
    """
    actions = list(dict.fromkeys(a for step in steps for a in step[:2]))
    ends = [(actions.index(start), actions.index(end), label) for start, end, label in steps]
    complete, n, size, none = actions.index(needed), len(actions), STRETCH if neighbours else 1, np.iinfo(np.int64).min

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, told, newest = np.full((size, n), none), np.zeros(size, np.int64), np.full(size, none)
        if state.exists:
            held = np.frombuffer(state.get[0], np.int64).reshape(-1, n + 3)
            stamps[held[:, 0]], told[held[:, 0]], newest[held[:, 0]] = held[:, 1:-2], held[:, -2], held[:, -1]
        if not state.hasTimedOut:
            arrived = np.full((size, n), none)
            for batch in rows:
                np.maximum.at(arrived, (batch["place"].to_numpy(np.int64), batch["at"].to_numpy(np.int64)), batch["micros"].to_numpy(np.int64))
            came = (arrived != none).any(axis=1)
            newest[came] = np.maximum(np.maximum(newest[came], arrived[came].max(axis=1) // 1000), 0)
            stamps = np.where(stamps == none, arrived, stamps)  # what comes again later corrects nothing
            for i, (start, end, label) in enumerate(ends):
                known = (stamps[:, [complete, start, end]] != none).all(axis=1) & (told >> i & 1 == 0)
                told |= known.astype(np.int64) << i
                found = np.flatnonzero(known & (stamps[:, end] >= stamps[:, start]))
                if len(found):
                    yield pd.DataFrame({
                        "case_id": key[0] * STRETCH + found if neighbours and not pd.isna(key[0]) else [key[0]] * len(found), "module": label,
                        "completed_at": stamps[found, end].astype("datetime64[us]"), "micros": stamps[found, end] - stamps[found, start]})
        open_ = np.flatnonzero((newest != none) & (newest + keep_ms > state.getCurrentWatermarkMs()))
        if len(open_):
            state.update((np.column_stack([open_, stamps[open_], told[open_], newest[open_]]).tobytes(),))
            state.setTimeoutTimestamp(int(newest[open_].min()) + keep_ms)
        elif state.exists:
            state.remove()

    return fold


def stream_completed_steps(events: DataFrame, late: str = "2 hours", keep_seconds: int = 86_400) -> DataFrame:
    """Each step of a case as soon as both its ends have arrived and the case is complete.

    ``events``: event_ts, case_id, action. A case is complete once its face check has
    arrived; of a repeated action the first arrival counts (of one micro-batch the latest),
    and what comes later corrects nothing. Output, appended: case_id, module,
    completed_at, micros. A case's state goes when the watermark, ``late`` behind the
    newest event, is ``keep_seconds`` past its last event. Start the query inside
    :func:`keyed_state`.
    """
    steps = [tuple(step[:3]) for step in fixed.LATENCY_STEPS]
    actions = list(dict.fromkeys(a for step in steps for a in step[:2]))
    source = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", late)
    kind = events.schema["case_id"].dataType
    neighbours = isinstance(kind, IntegralType)
    wanted = source.where(F.col("action").isin(*actions) & F.col("event_ts").isNotNull()).select(
        (F.shiftright(F.col("case_id").cast("long"), STRETCH.bit_length() - 1) if neighbours else F.col("case_id")).alias("stretch"),
        (F.coalesce(F.col("case_id").cast("long").bitwiseAND(STRETCH - 1), F.lit(0)) if neighbours else F.lit(0)).alias("place"),
        "event_ts", (F.array_position(F.array(*map(F.lit, actions)), F.col("action")) - 1).alias("at"), F.unix_micros("event_ts").alias("micros"))
    return wanted.groupBy("stretch").applyInPandasWithState(
        _step_fold(steps, "FACE_VERIFIED", 1000 * keep_seconds, neighbours),
        f"case_id {kind.simpleString()}, module string, completed_at timestamp, micros long",
        "cases binary", "append", GroupStateTimeout.EventTimeTimeout)


def _seal_fold(genesis: str) -> Callable:
    """Made inside a function, so that it travels with its tasks."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, sealed = state.get if state.exists else (genesis, 0)
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["event_ts", "seq"], kind="stable")
        previous, own = [], []
        for tail in arrived["tail"]:
            previous.append(head)
            head = hashlib.sha256(f"{head}|{tail}".encode()).hexdigest()
            own.append(head)
        sealed += len(own)
        state.update((head, sealed))
        yield arrived.drop(columns="tail").assign(
            previous_hash=previous, entry_hash=own, position=range(sealed - len(own) + 1, sealed + 1))

    return fold


def stream_sealed_events(events: DataFrame) -> DataFrame:
    """Events sealed into their chains as they arrive; the head of every chain is keyed state.

    ``events``: seq, event_ts, case_id, chain_id, action, actor, metadata. Events of one
    micro-batch are sealed in the order of their time and seq, after all that came before.
    Output, appended: the events with previous_hash, entry_hash and position. A chain's
    part of one micro-batch is held in one task, as each hash needs the one before. Start
    the query inside :func:`keyed_state`.
    """
    columns = ["seq", "event_ts", "case_id", "chain_id", "action", "actor", "metadata"]
    rows = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).select(*columns, payload_column().alias("tail"))
    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.groupBy("chain_id").applyInPandasWithState(
        _seal_fold(fixed.GENESIS), f"{shape}, previous_hash string, entry_hash string, position long",
        "hash string, sealed long", "append", GroupStateTimeout.NoTimeout)
