"""SimHash of case texts and a covering hash family that misses no pair within the radius."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import components
from .support import groups, shuffle_partitions, text_rows, tidy

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Members from which a bucket is split by a second family on its free bits.
SPLIT_FROM = 2_048
#: Shingles whose bits are spread out at once.
SPREAD = 1 << 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprints(texts: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        words = _WORDS.findall(text.lower())
        if len(words) > width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-width])).tolist()
            hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]
            counts[row] = len(starts)
        elif words:
            hashes.append(digest(b" ".join(words), SEED))
            counts[row] = 1
    values = np.array(hashes, np.uint64)
    has = np.flatnonzero(counts)
    ends = np.cumsum(counts[has])
    ones = np.zeros((len(has), BITS), np.int64)
    for start in range(0, len(values), SPREAD):
        part = values[start:start + SPREAD]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, start + len(part) - 1, side="right"))
        begins = np.maximum(ends[first:last + 1] - counts[has[first:last + 1]] - start, 0)
        ones[first:last + 1] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    major = 2 * ones > counts[has][:, None]
    out[has] = (major * weights).sum(axis=1, dtype=np.uint64)
    return out


def covering_masks(bits: int = BITS, radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """``2**(radius + 1) - 1`` masks; any ``radius`` positions are all outside one of them.

    Every position gets a vector of ``radius + 1`` bits and a mask holds the positions
    whose vector has an odd product with the mask's own vector. At most ``radius``
    vectors never span the space, so some non-zero vector is orthogonal to all of
    those where two fingerprints differ: in that table they are equal.
    """
    rng = random.Random(seed)
    width = radius + 1
    dealt = [1 + i % (2**width - 1) for i in range(bits)]
    rng.shuffle(dealt)
    return [sum(1 << i for i in range(bits) if bin(dealt[i] & v).count("1") % 2) for v in range(1, 2**width)]


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket keys..., fp)`` sorted by the keys to a spanning forest of the pairs within ``radius``."""

    def links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        step = max(1, (1 << 20) // max(1, len(fp)))
        for start in range(0, len(fp), step):
            part = fp[start:start + step]
            near = np.bitwise_count(part[:, None] ^ fp[None, start:]) <= radius
            i, j = np.nonzero(near)
            keep = j > i
            x, y = part[i[keep]].view(np.int64), fp[start:][j[keep]].view(np.int64)
            if len(x):
                node, root = components.forest(x, y)
                a.append(node[node != root])
                b.append(root[node != root])
        return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])

    def solve(keys: np.ndarray, fp: np.ndarray):
        starts, lengths = groups(keys)
        a, b = [], []
        for size in np.unique(lengths[(lengths > 1) & (lengths <= 64)]):
            rows = starts[lengths == size][:, None] + np.arange(size)[None, :]
            block = fp[rows]
            for gap in range(1, int(size)):
                near = np.bitwise_count(block[:, gap:] ^ block[:, :-gap]) <= radius
                a.append(block[:, gap:][near].view(np.int64))
                b.append(block[:, :-gap][near].view(np.int64))
        for at in np.flatnonzero(lengths > 64):
            x, y = links(fp[starts[at]:starts[at] + lengths[at]])
            a.append(x)
            b.append(y)
        u = np.concatenate(a or [np.zeros(0, np.int64)])
        v = np.concatenate(b or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held_keys, held_fp = np.zeros((0, 0)), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns]
        keys, fp = np.stack(columns[:-1], axis=1), columns[-1].astype(np.int64).view(np.uint64)
        if len(held_fp):
            keys, fp = np.concatenate([held_keys, keys]), np.concatenate([held_fp, fp])
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield solve(np.concatenate(([0], np.cumsum((keys[1:cut] != keys[:cut - 1]).any(axis=1)))), fp[:cut])
        held_keys, held_fp = keys[cut:], fp[cut:]
    if len(held_fp):
        yield solve(np.zeros(len(held_fp), np.int64), held_fp)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, split_from: int = SPLIT_FROM) -> DataFrame:
    """``(u, v)`` links, as signed longs, that connect distinct fingerprints ``fp`` within ``radius``.

    Each fingerprint is written once per mask. Buckets are found by key; their members
    are compared in the task that holds them, and leave as a spanning forest, so no
    pair list exists. A bucket of ``split_from`` members or more is split by the second
    family, on the bits the first mask left free: its members agree in about three
    quarters of all bits, which bounds such a sub-bucket by 2**16 members.
    """
    masks = covering_masks(radius=radius)
    parts = shuffle_partitions(prints)
    table = F.explode(F.arrays_zip(F.lit(list(range(len(masks)))).alias("t"), F.array(*[F.lit(m) for m in _signed(masks)]).alias("mask")))
    rows = prints.select("fp", table.alias("m")).select(
        F.col("m.t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= split_from).select("t", "key")
    full = materialize(full, "full-buckets")
    links = lambda batches: bucket_links(batches, radius)
    shallow = (
        rows.join(full, ["t", "key"], "left_anti").repartition(parts, "t", "key").sortWithinPartitions("t", "key", "fp")
        .mapInArrow(tidy(links), "u long, v long")
    )
    second = covering_masks(radius=radius, seed=SEED + 1)
    again = F.explode(F.arrays_zip(F.lit(list(range(len(second)))).alias("t2"), F.array(*[F.lit(m) for m in _signed(second)]).alias("mask")))
    deep = (
        rows.join(full, ["t", "key"], "left_semi").select("t", "key", "fp", again.alias("m"))
        .select("t", "key", F.col("m.t2").cast("long").alias("t2"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key2"), "fp")
        .repartition(parts, "t", "key", "t2", "key2").sortWithinPartitions("t", "key", "t2", "key2", "fp")
        .mapInArrow(tidy(links), "u long, v long")
    )
    return shallow.unionByName(deep)


def near_duplicate_cases(cases: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Group document analyses whose texts have nearly the same SimHash.

    ``cases``: case_id (long), raw_text; other columns are ignored. A text is
    lower-cased (A-Z) and cut at ASCII white space; XXH64 of each ``width``-word shingle
    votes on every bit, repeats included; shorter texts are one shingle. A null or
    wordless text has fingerprint zero and links like any other. Fingerprints at most
    ``radius`` bits apart are linked. Output, one row per input row: case_id,
    fingerprint (16 hex digits), component_id (smallest case_id reachable, its own
    included; null for a row without case_id) and text_hash (XXH64 of the text, to tell
    texts of one case_id apart). Repeated rows stay; an empty table gives
    an empty result.

    Only distinct fingerprints are compared. The covering masks make sure that every
    linked pair meets in some bucket.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches, "row", "raw_text"):
            yield pa.RecordBatch.from_arrays([
                pa.array([k["case_id"] for k in keys], pa.int64()), pa.array([k["text_hash"] for k in keys], pa.int64()),
                pa.array(fingerprints(texts, width).view(np.int64))], ["case_id", "text_hash", "fp"])

    text = F.col("raw_text").cast("string")
    rows = cases.select(F.struct(F.col("case_id").cast("long").alias("case_id"), F.xxhash64(text).alias("text_hash")).alias("row"),
                        text.alias("raw_text"))
    marked = materialize(rows.mapInArrow(tidy(prints), "case_id long, text_hash long, fp long"), "fingerprints")
    # spread over all tasks: each row becomes one per mask
    distinct = marked.groupBy("fp").agg(F.min("case_id").alias("first")).repartition(shuffle_partitions(cases), "fp")
    distinct = materialize(distinct, "distinct-fingerprints")
    links = fingerprint_links(distinct.select("fp"), radius)
    found = components.connected(links)
    # Components are named by fingerprint; the smallest case in each gives its id.
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        "case_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("case_id").isNotNull(), F.col("component_id")).alias("component_id"), "text_hash",
    )
