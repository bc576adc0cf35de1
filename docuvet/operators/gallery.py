"""Exact one-to-many face search over a gallery too large for one machine.

At the similarities of interest nothing short of the products themselves tells faces
apart in hundreds of dimensions, so every probe meets every gallery row. Rows travel
in packed blocks and meet in the cells of a grid, as many as there are shuffle
partitions: probes are dealt to its rows and copied along them, the gallery to its
columns, so each travels about the square root of that number of times. A task
multiplies two bounded matrices at a time, in single precision; pairs that this cannot
rule out are multiplied again in double precision. Only the best match of a probe leaves
a cell; pairs are never emitted. Arithmetic is probes times gallery times dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from ..functions import fixed
from ..functions.numbers import round_exact

BLOCK_ROWS = 2048
#: Pairs of a block that are multiplied again one by one: at most one in so many, in steps; if more are left, all are, as one product.
ONE_IN, AT_ONCE = 16, 1 << 16


def _usable(df: DataFrame, vector: str) -> DataFrame:
    norm = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return df.where(F.col(vector).isNotNull() & (norm > 0))


def face_rows(df: DataFrame, group: str) -> DataFrame:
    """Faces with a direction: case_id, the hash of their group, embedding as doubles."""
    own = F.xxhash64(F.lit("no group"), "case_id")
    return _usable(df, "embedding").select(
        F.col("case_id").cast("long").alias("case_id"),
        F.coalesce(F.when(F.col(group).isNotNull(), F.xxhash64(F.col(group).cast("string"))), own).alias("grp"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _packed(df: DataFrame, group: str, block_rows: int, name: str) -> DataFrame:
    """Vectors as blocks: ids and group hashes as long, vectors as float if they are that, else as double, all in bytes."""
    single = isinstance(df.schema["embedding"].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    rows = face_rows(df, group)
    names = [f"{name}_{c}" for c in ("ids", "groups", "vectors")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            lists = table.column("embedding").combine_chunks()
            ids, groups = (table.column(c).to_numpy() for c in ("case_id", "grp"))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // len(ids)
            lengths = np.diff(lists.offsets.to_numpy())
            if (lengths != width).any():
                raise ValueError(f"embeddings differ in length, as that of case {ids[lengths != width][0]}")
            vectors = flat.reshape(len(ids), width)
            order = np.argsort(ids, kind="stable")
            values = (ids[order], groups[order], vectors[order].astype(kind))  # floats come back as they were
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == block_rows:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names))


def grid(cells: int) -> tuple[int, int]:
    """Rows and columns of a grid of at least ``cells`` cells, as square as can be."""
    columns = math.isqrt(cells - 1) + 1
    return -(-cells // columns), columns


def _meeting(threshold: float, bar_group: bool):
    """How a block of probes meets faces in ascending order of their ids, as a closure that travels with its tasks."""

    def alone(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip((np.einsum("ij,ij->i", a, b) + 1.0) / 2.0, 0.0, 1.0)

    def meet(probe: tuple, faces: tuple, best_face: np.ndarray, best_score: np.ndarray) -> None:
        """Better matches of the probes take the place of those held. Both sides: ids, groups, unit vectors, and these in single precision."""
        (ids, groups, units, singles), (face, face_groups, face_units, face_singles) = probe, faces
        # no product in single precision is further off than this; equal scores may still have a smaller id
        margin = (units.shape[1] + 8) * 1.2e-7
        floor = (2.0 * np.maximum(best_score, threshold) - 1.0 - margin).astype(np.float32)
        hits = np.flatnonzero((singles @ face_singles.T >= floor[:, None]).ravel())
        if len(hits) * ONE_IN > len(ids) * len(face):
            scores = np.clip((units @ face_units.T + 1.0) / 2.0, 0.0, 1.0)
            barred = ids[:, None] == face[None, :]
            if bar_group:
                barred |= groups[:, None] == face_groups[None, :]
            scores[barred | (scores < threshold)] = -1.0
            j = np.round(scores, 12).argmax(axis=1)
            i = np.flatnonzero(scores[np.arange(len(j)), j] >= 0.0)
            found = [(i, j[i], np.round(alone(units[i], face_units[j[i]]), 12))]  # a pair has one value, however it was found
        else:
            found = []
            for at in range(0, len(hits), AT_ONCE):
                i, j = np.divmod(hits[at:at + AT_ONCE], len(face))
                scores = alone(units[i], face_units[j])
                good = (scores >= threshold) & (ids[i] != face[j])
                if bar_group:
                    good &= groups[i] != face_groups[j]
                i, j, scores = i[good], j[good], np.round(scores[good], 12)
                order = np.lexsort((face[j], -scores, i))
                i, j, scores = i[order], j[order], scores[order]
                first = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
                found.append((i[first], j[first], scores[first]))
        for i, j, scores in found:
            better = (scores > best_score[i]) | ((scores == best_score[i]) & (face[j] < best_face[i]))
            best_face[i[better]], best_score[i[better]] = face[j[better]], scores[better]

    return meet


def gallery_best_match(
    probes: DataFrame, gallery: DataFrame, threshold: float = fixed.GALLERY_MATCH_THRESHOLD,
    exclude: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each probe's most similar gallery row at or above ``threshold``.

    ``probes``/``gallery``: case_id, embedding and, when ``exclude`` names one, a
    group column. A probe never matches its own case_id; with ``exclude`` it never
    matches a row of its own group. Similarities equal to twelve places are ties, which
    go to the smaller case_id. Output: case_id, match_case_id, similarity (to twelve
    places; the threshold is tested before rounding) and, if the gallery has them,
    match_case_number and match_full_name.
    """
    group = exclude or "case_id"
    cells = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, columns = grid(cells)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _packed(probes, group, block_rows, "probe").withColumn("grid_row", F.pmod(F.xxhash64("probe_ids"), F.lit(rows)).cast("int"))
    asked = asked.withColumn("grid_column", every(columns))
    blocks = _packed(gallery, group, block_rows, "face").withColumn("grid_column", F.pmod(F.xxhash64("face_ids"), F.lit(columns)).cast("int"))
    blocks = blocks.withColumn("grid_row", every(rows))
    bar_group = exclude is not None
    kinds = {n: np.float32 if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else np.float64
             for n, df in (("probe", probes), ("face", gallery))}

    meet = _meeting(threshold, bar_group)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids = probe = best_face = best_score = None

        def told() -> pa.RecordBatch:
            keep = best_score >= 0.0
            return pa.RecordBatch.from_arrays(
                [pa.array(probe[0][keep]), pa.array(best_face[keep]), pa.array(best_score[keep])], ["case_id", "match_case_id", "similarity"])

        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)

                def side(name: str) -> tuple:
                    ids = read(f"{name}_ids", np.int64)
                    vectors = read(f"{name}_vectors", kinds[name]).astype(np.float64).reshape(len(ids), -1)
                    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                    return ids, read(f"{name}_groups", np.int64), units, units.astype(np.float32)

                ids = read("probe_ids", np.int64).tobytes()
                if ids != asked_ids:  # a probe block meets its faces one after the other
                    if asked_ids is not None:
                        yield told()
                    asked_ids, probe = ids, side("probe")
                    best_face, best_score = np.zeros(len(probe[0]), np.int64), np.full(len(probe[0]), -1.0)
                meet(probe, side("face"), best_face, best_score)
        if asked_ids is not None:
            yield told()

    # the planner takes the copies for as small as the table they come from and would broadcast them through the driver
    met = asked.join(blocks.hint("merge"), ["grid_row", "grid_column"]).drop("grid_row", "grid_column")
    found = met.mapInArrow(best, "case_id long, match_case_id long, similarity double")
    matched = (
        found.groupBy("case_id")
        .agg(F.max_by(F.struct("match_case_id", "similarity"), F.struct("similarity", -F.col("match_case_id"))).alias("b"))
        .select("case_id", "b.match_case_id", "b.similarity")
    )
    named = [c for c in ("case_number", "full_name") if c in gallery.columns]
    if not named:
        return matched
    # several rows of one case may carry names; the smallest of each is shown
    names = gallery.groupBy(F.col("case_id").cast("long").alias("match_case_id")).agg(*[F.min(c).alias(f"match_{c}") for c in named])
    return matched.join(names, "match_case_id", "left").select("case_id", "match_case_id", "similarity", *[f"match_{c}" for c in named])


def gallery_hits(probes: DataFrame, gallery: DataFrame, **options) -> DataFrame:
    """The published form of a match: similarity tested unrounded, shown rounded."""
    return gallery_best_match(probes, gallery, **options).withColumn(
        "similarity", round_exact(F.col("similarity"), 3)
    )


def latest_embedding(captures: DataFrame, key: str = "case_id", order: str = "created_at") -> DataFrame:
    """The newest embedding of every case (``max_by`` combines before the shuffle)."""
    rest = [c for c in captures.columns if c != key]
    newest = captures.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("r"))
    return newest.select(key, "r.*")


def gallery_upsert(gallery: DataFrame, captures: DataFrame, key: str = "case_id") -> DataFrame:
    """Replace the embeddings of captured cases; exactly one row per case remains."""
    fresh = latest_embedding(captures, key)
    return gallery.join(fresh.select(key), key, "left_anti").unionByName(fresh)
