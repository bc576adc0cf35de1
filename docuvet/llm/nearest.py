"""Nearest gallery faces by an adaptive dimension scan of inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .faces import cosines, matrix, usable
from .support import shuffle_partitions

#: Embeddings that the lists are fitted on and the number of lists to probe is calibrated with, at most.
SAMPLE = 16_384
#: Of these, how many give a probe its first bound.
SEEDS = 1_024
#: Share of true neighbours the probed lists must hold in that calibration.
RECALL = 0.97
#: Width of a column block, and how sure a test must be to abandon a candidate.
COLUMNS = 16
CONFIDENCE = 2.1
BLOCK_ROWS = 2_048
BLOCK_PROBES = 256


@dataclass
class Lists:
    """A fitted coarse index: unit centroids, a random rotation, how many lists to probe, and a part of the sample as given."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def fit(ids: np.ndarray, vectors: np.ndarray, total: int, k: int, recall: float = RECALL, seed: int = 7) -> Lists:
    """Spherical k-means on a sample of a gallery of ``total`` rows, and the probes that reach ``recall`` on it."""
    rng = np.random.default_rng(seed)
    sample = _unit(vectors)
    n, dim = sample.shape
    lists = int(np.clip(round(total**0.5 / 2), 1, max(1, min(4096, n // 4))))
    centroids = sample[rng.choice(n, lists, replace=False)]
    for _ in range(8):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    some = rng.choice(n, min(n, 512), replace=False)
    near = sample[some] @ sample.T
    near[np.arange(len(some)), some] = -2.0
    best = np.argsort(-near, axis=1)[:, :k]
    nearest = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(np.argsort(-(sample[some] @ centroids.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(order, nearest[best], axis=1).ravel()) + 1
    probes = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) if len(depth) else 1
    seeds = np.sort(rng.choice(n, min(n, SEEDS), replace=False))
    return Lists(centroids, rotation, min(lists, probes), vectors[seeds], ids[seeds])


def scan(probes: np.ndarray, bound: np.ndarray, vectors: np.ndarray, k: int, columns: int = COLUMNS,
         confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, candidate) that may be among each probe's ``k`` nearest, of rotated unit vectors.

    Squared distances grow one column block at a time. After ``d`` of ``D`` columns the
    part seen, scaled by ``D / d``, estimates the whole; a candidate whose estimate
    exceeds the probe's bound by more than a factor of ``(1 + confidence / sqrt(d))``
    squared is abandoned. ``bound`` is tightened to the k-th best found here.
    """
    dim = probes.shape[1]
    bound = bound.copy()
    rows, others = np.indices((len(probes), len(vectors))).reshape(2, -1)
    seen = np.zeros(len(rows))
    for at in range(0, dim, columns):
        a, b = probes[:, at:at + columns], vectors[:, at:at + columns]
        done = at + a.shape[1]
        if len(rows) > 0.25 * len(probes) * len(vectors):
            part = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
            seen = seen + part[rows, others]
        else:
            gap = a[rows] - b[others]
            seen = seen + np.einsum("ij,ij->i", gap, gap)
        if done < dim:
            keep = seen * (dim / done) <= bound[rows] * (1.0 + confidence / done**0.5) ** 2
            rows, others, seen = rows[keep], others[keep], seen[keep]
    order = np.lexsort((seen, rows))
    rows, others, seen = rows[order], others[order], seen[order]
    start = np.searchsorted(rows, np.arange(len(probes)))
    stop = np.searchsorted(rows, np.arange(len(probes)), side="right")
    full = np.flatnonzero(stop - start >= k)
    bound[full] = np.minimum(bound[full], seen[start[full] + k - 1])
    # rounding must not decide between near ties: the exact cosine does
    keep = seen <= bound[rows] + 1e-5
    return rows[keep], others[keep]


def _pack(table: pa.Table, names: list[str]) -> pa.Table:
    vectors = matrix(table.column("embedding").combine_chunks())
    packed = [np.asarray(table.column("case_id")), vectors, *([np.asarray(table.column("bound"))] if len(names) > 2 else [])]
    return pa.table([table.column("list").slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["list", *names])


def nearest_faces(probes: DataFrame, gallery: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """The ``k`` gallery faces of largest cosine for each probe.

    ``probes`` and ``gallery``: case_id (long), embedding (array of numbers); other
    columns are ignored. Embeddings that are null, zero, hold a null or a non-finite
    component, or differ in length from most of the gallery, take no part; neither do
    rows without case_id, and a probe never meets rows of its own case_id. Output:
    case_id, rank (from 1), match_case_id, similarity (cosine in double precision, from
    the embeddings as given); ties go to the smaller match_case_id. A repeated gallery
    row is one candidate. Empty tables give an empty result.

    Lists are fitted on at most ``SAMPLE`` embeddings; every row is indexed. The number
    of lists to probe is the one that holds ``recall`` of the neighbours inside that
    sample; lists are added until they hold ``4 * k`` rows. Lists are cut into blocks
    of about ``BLOCK_ROWS`` by a hash of case_id, so a crowded list is many tasks, and
    only the best ``k`` of a block leave it. The best of ``SEEDS`` sampled rows are candidates too:
    they set the first bound, and a probe gets ``k`` rows wherever there are as many.
    """
    spark = gallery.sparkSession
    parts = shuffle_partitions(gallery)
    shape = "case_id long, embedding array<double>"
    shaped = lambda df: df.select(F.col("case_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = materialize(shaped(usable(gallery.select("case_id", "embedding"))).dropDuplicates(), "gallery")
    empty = spark.createDataFrame([], "case_id long, rank int, match_case_id long, similarity double")
    total = rows.count()
    if not total:
        return empty
    dim = rows.select(F.size("embedding")).first()[0]
    share = min(1.0, SAMPLE / total)
    taken = rows.where(F.pmod(F.xxhash64("case_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("case_id").limit(SAMPLE).toArrow()
    if not taken.num_rows:
        taken = rows.limit(1).toArrow()
    fitted = fit(np.asarray(taken.column("case_id")), matrix(taken.column("embedding").combine_chunks()), total, k, recall)
    shared = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value.centroids
        for batch in batches:
            if batch.num_rows:
                own = (_unit(matrix(batch.column("embedding"))) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["case_id", "embedding", "list"])

    listed = materialize(rows.mapInArrow(assign, f"{shape}, list long"), "lists")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(fitted.centroids))])
    cuts = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, -(-n // BLOCK_ROWS))])
    blocks = (
        listed.withColumn("part", F.pmod(F.xxhash64("case_id"), cuts[F.col("list")]))
        .groupBy("list", "part").applyInArrow(
            lambda t: _pack(t, ["face_ids", "face_vectors"]), "list long, face_ids binary, face_vectors binary")
    )

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of the sample for each probe, and what its last one says about the distance of the k-th."""
        index = shared.value
        sample = _unit(index.sample)
        for batch in batches:
            ids, vectors = np.asarray(batch.column("case_id")), matrix(batch.column("embedding"))
            for at in range(0, len(ids), 64):
                own, some = ids[at:at + 64], vectors[at:at + 64]
                near = _unit(some) @ sample.T
                near[own[:, None] == index.sample_ids[None, :]] = -2.0
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                probe, place = np.nonzero(np.take_along_axis(near, order, axis=1) > -2.0)
                faces = order[probe, place]
                score = cosines(some[probe], index.sample[faces])
                count = np.bincount(probe, minlength=len(own))
                bound = np.full(len(own), 4.0)
                last = np.minimum.reduceat(score, (np.cumsum(count) - count)[count > 0]) if len(score) else score
                bound[count > 0] = np.where(count[count > 0] == k, 2.0 - 2.0 * last + 1e-9, 4.0)
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("case_id").slice(at, len(own)), batch.column("embedding").slice(at, len(own)), pa.array(bound),
                    pa.ListArray.from_arrays(offsets, pa.array(index.sample_ids[faces], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(score))], ["case_id", "embedding", "bound", "seeds", "scores"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, count = shared.value.centroids, shared.value.probes
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(_unit(matrix(batch.column("embedding"))) @ centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) - held[order]) < 4 * k
            chosen = enough | (np.arange(order.shape[1]) < count)
            probe, place = np.nonzero(chosen & (held[order] > 0))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(probe)) for i in range(3)], pa.array(order[probe, place])],
                ["case_id", "embedding", "bound", "list"])

    asked = shaped(usable(probes.select("case_id", "embedding"))).where(F.size("embedding") == dim).dropDuplicates()
    asked = materialize(asked.repartition(parts, "case_id").mapInArrow(seed, f"{shape}, bound double, seeds array<long>, scores array<double>"), "probes")
    routed = materialize(asked.select("case_id", "embedding", "bound").mapInArrow(route, f"{shape}, bound double, list long"), "routed")
    per_list = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_list:
        return empty
    shares = F.create_map(*[F.lit(x) for name, n in per_list.items() for x in (name, -(-n // BLOCK_PROBES))])
    groups_of = (
        routed.withColumn("part", F.pmod(F.xxhash64("case_id"), shares[F.col("list")]))
        .groupBy("list", "part").applyInArrow(
            lambda t: _pack(t, ["probe_ids", "probe_vectors", "bounds"]), "list long, probe_ids binary, probe_vectors binary, bounds binary")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value.rotation
        for batch in batches:
            for row in batch.to_pylist():
                faces, asked = np.frombuffer(row["face_ids"], np.int64), np.frombuffer(row["probe_ids"], np.int64)
                vectors = np.frombuffer(row["face_vectors"]).reshape(-1, dim)
                probes, bounds = np.frombuffer(row["probe_vectors"]).reshape(-1, dim), np.frombuffer(row["bounds"])
                turned, found = _unit(vectors) @ rotation, [[], [], []]
                for at in range(0, len(asked), 32):
                    ids, some = asked[at:at + 32], probes[at:at + 32]
                    # one more than k: a probe's own row may be among them
                    probe, face = scan(_unit(some) @ rotation, bounds[at:at + 32], turned, k + 1)
                    other = ids[probe] != faces[face]
                    probe, face = probe[other], face[other]
                    score = cosines(some[probe], vectors[face])
                    order = np.lexsort((faces[face], -score, probe))
                    probe, face, score = probe[order], face[order], score[order]
                    best = np.arange(len(probe)) - np.searchsorted(probe, probe) < k
                    for column, values in zip(found, (ids[probe[best]], faces[face[best]], score[best])):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["case_id", "match_case_id", "similarity"])

    pairs = groups_of.join(blocks, "list").repartition(parts).mapInArrow(
        compare, "case_id long, match_case_id long, similarity double")
    seeds = asked.select("case_id", F.explode(F.arrays_zip("seeds", "scores")).alias("s")).select(
        "case_id", F.col("s.seeds").alias("match_case_id"), F.col("s.scores").alias("similarity"))
    pairs = pairs.unionByName(seeds)
    order = Window.partitionBy("case_id").orderBy(F.desc("similarity"), "match_case_id")
    best = pairs.dropDuplicates(["case_id", "match_case_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("case_id", "rank", "match_case_id", "similarity")
