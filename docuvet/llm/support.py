"""Helpers shared by the operators: whole texts as bytes, packed rows, hashing."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1 << 20


def text_rows(batches: Iterator[pa.RecordBatch], key: str, text: str, chunk_bytes: int = CHUNK_BYTES):
    """Lists of keys and UTF-8 texts (null: empty) of about ``chunk_bytes`` each; a longer text comes alone."""
    for batch in batches:
        keys = batch.column(key).to_pylist()
        texts = batch.column(text).cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else []
        start = held = 0
        for row, size in enumerate(lengths):
            if row > start and held + size > chunk_bytes:
                yield keys[start:row], [t or b"" for t in texts[start:row].to_pylist()]
                start, held = row, 0
            held += size
        if len(keys) > start:
            yield keys[start:], [t or b"" for t in texts[start:].to_pylist()]


def release() -> None:
    """Give freed memory back to the system; an idle worker otherwise keeps the most it ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(work: Callable) -> Callable:
    """A task function, of batches or of one group's table, that releases memory when it is done."""

    def stream(batches):
        try:
            yield from work(batches)
        finally:
            release()

    def one(table):
        try:
            return work(table)
        finally:
            release()

    return lambda data: one(data) if isinstance(data, pa.Table) else stream(data)


def kept_in_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once per worker process: tasks that a worker runs one after another share it."""
    kept = sys.modules.setdefault("docuvet_kept", types.ModuleType("docuvet_kept")).__dict__.setdefault("values", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget(shipped: Broadcast) -> None:
    """Drop this worker's copy of a broadcast; the next task that needs it reads it again."""
    shipped.__dict__.pop("_value", None)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    v = values ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return out


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_keys)))
