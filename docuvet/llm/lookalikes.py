"""Near-duplicate gallery faces by counting collisions on sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from ..session import discard, materialize
from . import components
from .faces import cosines, matrix, usable
from .support import shuffle_partitions

SIMILARITY = 0.93
PROJECTIONS = 48
#: Half width of a window, in units of the projections' standard deviation for unit vectors.
HALF_WINDOW = 0.5
#: Chance that a pair at exactly the wanted similarity passes the count, and that the first projection keeps it in reach.
RECALL = 0.9999
BLOCK_ROWS = 512
#: Bytes of vectors that a task holds while it meets others, about.
PART_BYTES = 32 << 20


def _tail(x: float) -> float:
    """Chance that a standard normal lies within ``x`` of zero."""
    return erf(x / sqrt(2.0))


def least_count(similarity: float, projections: int = PROJECTIONS, half_window: float = HALF_WINDOW, recall: float = RECALL) -> int:
    """The largest number of collisions that a pair at ``similarity`` reaches with chance ``recall``.

    On a Gaussian direction, two unit vectors at distance ``d`` differ by a normal value
    of standard deviation ``d``, so collisions are binomial whatever the data.
    """
    p = _tail(half_window / sqrt(2.0 - 2.0 * similarity))
    below = 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > 1.0 - recall:
            return count
    return projections


def reach(similarity: float, recall: float = RECALL) -> float:
    """How far two vectors at ``similarity`` differ on one projection, but for a chance of ``1 - recall``."""
    low, high = 0.0, 40.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(middle) < recall else (low, middle)
    return high * sqrt(2.0 - 2.0 * similarity)


def directions(dim: int, projections: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def colliding(a: np.ndarray, b: np.ndarray, least: int, half_window: float = HALF_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose projections (one per column) fall in each other's window at least ``least`` times.

    Each projection of ``b`` is sorted, and the window around a row of ``a`` is the range
    between two binary searches. Rows of ``a`` that no longer have a row of ``b`` within
    reach of the count are given up on the way.
    """
    rows = np.arange(len(a))
    counts = np.zeros((len(a), len(b)), np.int8)
    for done, column in enumerate(range(a.shape[1]), 1):
        order = np.argsort(b[:, column])
        values = b[order, column]
        low = np.searchsorted(values, a[rows, column] - half_window, side="left")
        high = np.searchsorted(values, a[rows, column] + half_window, side="right")
        place = np.empty(len(b), np.int64)
        place[order] = np.arange(len(b))
        counts += (place[None, :] >= low[:, None]) & (place[None, :] < high[:, None])
        if done % 8 == 0 and done < a.shape[1]:
            hopeful = counts.max(axis=1, initial=0) >= least - (a.shape[1] - done)
            if not hopeful.all():
                rows, counts = rows[hopeful], counts[hopeful]
            if not len(rows):
                break
    i, j = np.nonzero(counts >= least)
    return rows[i], j


def near_duplicate_faces(gallery: DataFrame, group: str = "country", similarity: float = SIMILARITY) -> DataFrame:
    """Link gallery faces of one group whose cosine reaches ``similarity``.

    ``gallery``: case_id (long), embedding (array of numbers) and the column ``group``;
    other columns are ignored. Faces link only if their groups are equal and not null.
    Embeddings that are null, zero, hold a null or a non-finite component, or differ in
    length from most, link with nothing, nor do rows without case_id. Output, one row
    per input row: case_id, n_links (other case_ids linked directly), component_id
    (smallest case_id reachable, its own included) and kept (case_id is component_id).
    Repeated rows get the same answer each; an empty table gives an empty result.

    Equal embeddings of a group are one class. Classes are sorted by their first
    projection and packed into blocks, in single precision if they came so; a block meets
    the blocks behind it as far as the window of that projection reaches. Blocks are dealt
    to parts, and every two parts meet in a task that reads both where they lie: nothing
    is copied to disk for each pair. Pairs with enough collisions are verified in
    double precision. A block pair returns counts and a spanning forest, never its pairs.
    Work grows with the square of the largest group, in blocks.
    """
    single = isinstance(gallery.schema["embedding"].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    rows = gallery.select(
        F.col("case_id").cast("long").alias("case_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        F.col(group).alias("grp"))
    parts = shuffle_partitions(gallery)
    able = usable(rows).where("grp is not null").dropDuplicates()
    classes = materialize(
        able.groupBy("grp", "embedding").agg(F.min("case_id").alias("face"), F.count(F.lit(1)).alias("copies")), "faces")
    first = classes.select(F.size("embedding")).first()
    dim = first[0] if first else 1
    turn = directions(dim)
    least, far = least_count(similarity), reach(similarity)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("embedding"))
                unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                firsts = unit @ turn[:, 0]
                yield pa.RecordBatch.from_arrays([
                    batch.column("grp_key"), batch.column("face"), batch.column("copies"), pa.array(firsts),
                    pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())], ["grp_key", "face", "copies", "first", "vector"])

    shape = "grp_key string, face long, copies long, first double, vector binary"
    projected = materialize(
        classes.select(F.col("grp").cast("string").alias("grp_key"), "face", "copies", "embedding").mapInArrow(project, shape), "projected")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block():
            return pa.RecordBatch.from_pylist([{
                "grp_key": held[0]["grp_key"], "block": held[0]["face"], "low": held[0]["first"], "high": held[-1]["first"],
                "faces": np.array([h["face"] for h in held], np.int64).tobytes(),
                "copies": np.array([h["copies"] for h in held], np.int64).tobytes(),
                "vectors": b"".join(h["vector"] for h in held)}], schema=packed)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["grp_key"] != held[0]["grp_key"] or len(held) == BLOCK_ROWS):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    packed = pa.schema([("grp_key", pa.string()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()),
                        ("faces", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
    blocks = materialize(
        projected.repartitionByRange(parts, "grp_key", "first", "face").sortWithinPartitions("grp_key", "first", "face")
        .mapInArrow(pack, "grp_key string, block long, low double, high double, faces binary, copies binary, vectors binary"),
        "face-blocks")
    discard(projected)
    size = blocks.agg(F.sum(F.length("vectors"))).first()[0] or 0
    side = max(isqrt(2 * parts - 1) + 1, -(-size // PART_BYTES))
    dealt = blocks.repartition(side, "block")
    other = dealt.select([F.col(c).alias(f"{c}_2") for c in blocks.columns])
    behind = (F.col("low_2") > F.col("low")) | ((F.col("low_2") == F.col("low")) & (F.col("block_2") >= F.col("block")))
    # a product of parts: as an equi-join every pair of blocks of a large group would be shuffled
    met = dealt.join(other.hint("shuffle_replicate_nl"), (F.col("grp_key") == F.col("grp_key_2")) & behind & (F.col("low_2") <= F.col("high") + far))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(row: dict, x: str) -> tuple:
            vectors = np.frombuffer(row["vectors" + x], kind).reshape(-1, dim).astype(np.float64)
            values = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ turn
            return np.frombuffer(row["faces" + x], np.int64), np.frombuffer(row["copies" + x], np.int64), vectors, values

        held, mine = None, ()
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1).to_pylist()[0]
                if (row["grp_key"], row["block"]) != held:  # a block meets others one after the other
                    held, mine = (row["grp_key"], row["block"]), side(row, "")
                (faces, copies, vectors, values), (faces2, copies2, vectors2, values2) = mine, side(row, "_2")
                own = row["block"] == row["block_2"]
                links, links2 = np.zeros(len(faces), np.int64), np.zeros(len(faces2), np.int64)
                u, v = [], []
                for at in range(0, len(faces), 64):
                    i, j = colliding(values[at:at + 64], values2, least)
                    i = i + at
                    if own:
                        i, j = i[j > i], j[j > i]
                    for step in range(0, len(i), 1 << 15):
                        a, b = i[step:step + (1 << 15)], j[step:step + (1 << 15)]
                        near = cosines(vectors[a], vectors2[b]) >= similarity
                        a, b = a[near], b[near]
                        np.add.at(links, a, copies2[b])
                        np.add.at(links2, b, copies[a])
                        if len(a):
                            node, root = components.forest(faces[a], faces2[b])
                            u.append(node[node != root])
                            v.append(root[node != root])
                if u:
                    node, root = components.forest(np.concatenate(u), np.concatenate(v))
                    u, v = [node[node != root]], [root[node != root]]
                counted = [(faces[links > 0], links[links > 0]), (faces2[links2 > 0], links2[links2 > 0])]
                ends = np.concatenate([*u, *[c[0] for c in counted]])
                others = np.concatenate([*v, *[np.full(len(c[0]), -1) for c in counted]]).astype(np.int64)
                n = np.concatenate([np.zeros(sum(map(len, u)), np.int64), *[c[1] for c in counted]])
                forest = np.concatenate([np.ones(sum(map(len, u)), bool), np.zeros(len(n) - sum(map(len, u)), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends.astype(np.int64)), pa.array(others), pa.array(n), pa.array(forest)], ["u", "v", "n", "link"])

    found = materialize(met.mapInArrow(verify, "u long, v long, n long, link boolean"), "face-links")
    discard(blocks)
    groups = components.connected(found.where("link").select("u", "v"))
    counts = found.where("not link").groupBy(F.col("u").alias("face")).agg(F.sum("n").alias("n"))
    answer = (
        classes.join(counts, "face", "left").join(groups.withColumnRenamed("node", "face"), "face", "left")
        .select("grp", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "face").alias("component_id"))
    )
    # rows with an equal embedding are usable alike, but for those without case_id
    linked = F.col("case_id").isNotNull()
    return rows.join(answer, ["grp", "embedding"], "left").select(
        "case_id", F.coalesce(F.when(linked, F.col("n_links")), F.lit(0)).alias("n_links"),
        F.coalesce(F.when(linked, F.col("component_id")), "case_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("case_id") == F.col("component_id"), F.lit(True)))
