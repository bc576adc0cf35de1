"""One-to-many face search through inverted lists, with the exact product behind it.

Every gallery row lies in the list of its nearest centre. A probe visits the lists
nearest to it and is compared with those only, so work falls with the share of the
gallery that they hold. Probes and lists meet in the cells of a grid: lists are dealt to
its columns and copied along its rows, probes to its rows and copied along its columns,
so each travels about the square root of the shuffle partitions times, however many lists
a probe visits. How many lists are visited is measured, not guessed: on a
bounded sample of probes searched exactly. A probe whose unvisited lists cannot hold
anything better, by the angle between it and their centres, is closed; the others can be
searched again by the exact product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from .gallery import BLOCK_ROWS, _meeting, face_rows, gallery_best_match, grid

#: Most lists, and gallery rows for each of them that the centres are fitted on.
MOST_LISTS = 1_024
ROWS_PER_LIST = 32
#: Probes searched exactly to learn how many lists must be visited.
SAMPLED_PROBES = 1_024
#: Fewer matches than this among them say too little: then faces are placed just at the threshold instead.
LEAST_MATCHES = 100


@dataclass
class Lists:
    """Centres of the lists, parts each list is dealt into, and lists a probe visits."""

    centres: np.ndarray
    parts: np.ndarray
    visits: int


def _units():
    """A list column as unit vectors, as a closure that travels with its tasks."""

    def unit(column: pa.Array) -> np.ndarray:
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    return unit


_unit = _units()


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n`` rows, by the hash of their case: ids and unit vectors."""
    table = rows.orderBy(F.xxhash64("case_id"), "case_id").limit(n).toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return table.column("case_id").to_numpy(), _unit(table.column("embedding").combine_chunks())


def _centres(vectors: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty list keeps its centre."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _rank(probes: np.ndarray, faces: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists a probe has to visit, nearest first, until it comes to the list of its face."""
    own = np.einsum("ij,ij->i", probes, centres[(faces @ centres.T).argmax(axis=1)])
    return (probes @ centres.T > own[:, None]).sum(axis=1) + 1


def fit_lists(probes: DataFrame, gallery: DataFrame, threshold: float, exclude: str | None, recall: float, lists: int | None) -> Lists | None:
    """Centres from a bounded sample of the gallery and the number of visits that reaches ``recall`` on sampled probes."""
    faces = face_rows(gallery, exclude or "case_id")
    n = faces.count()
    if not n:
        return None
    lists = min(lists or max(1, 3 * int(np.sqrt(n))), MOST_LISTS)
    _, sample = _sample(faces, ROWS_PER_LIST * lists)
    centres = _centres(sample, min(lists, len(sample)))
    share = np.bincount((sample @ centres.T).argmax(axis=1), minlength=len(centres)) / len(sample)
    parts = np.maximum(1, np.ceil(share * n / (8 * BLOCK_ROWS))).astype(np.int64)
    ids, asked = _sample(face_rows(probes, exclude or "case_id"), SAMPLED_PROBES)
    spark = gallery.sparkSession
    chosen = probes.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "case_id long")), "case_id", "left_semi")
    hits = gallery_best_match(chosen.select("case_id", "embedding", *([exclude] if exclude else [])), gallery, threshold, exclude)
    found = hits.select("case_id", "match_case_id").join(
        face_rows(gallery, exclude or "case_id").select(F.col("case_id").alias("match_case_id"), "embedding"), "match_case_id").toArrow()
    if found.num_rows >= LEAST_MATCHES:
        of = {int(i): row for row, i in enumerate(ids)}
        ranks = _rank(asked[[of[int(i)] for i in found.column("case_id").to_numpy()]], _unit(found.column("embedding").combine_chunks()), centres)
    else:
        rng = np.random.default_rng(7)
        cosine = 2.0 * threshold - 1.0
        aside = rng.normal(size=sample.shape)
        aside -= np.einsum("ij,ij->i", aside, sample)[:, None] * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        ranks = _rank(cosine * sample + np.sqrt(max(0.0, 1.0 - cosine**2)) * aside, sample, centres)
    return Lists(centres, parts, int(np.quantile(ranks, recall, method="higher")))


def indexed_best_match(
    probes: DataFrame, gallery: DataFrame, threshold: float = fixed.GALLERY_MATCH_THRESHOLD, exclude: str | None = None,
    recall: float = 0.995, lists: int | None = None, exact: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each probe's most similar gallery row at or above ``threshold`` among the lists it visits.

    Inputs and rules are those of :func:`gallery_best_match`. Output, one row per probe
    that has a direction: case_id, match_case_id and similarity (null without a match),
    compared (gallery rows it was compared with) and closed (no unvisited list can hold a
    better match; always true with ``exact``, which searches the open probes again by the
    exact product). ``recall`` is the share of sampled matches whose list is visited. Only
    centres, sizes and radii of at most 1,024 lists and the samples pass through the driver.
    """
    fitted = fit_lists(probes, gallery, threshold, exclude, recall, lists)
    group = exclude or "case_id"
    asked = face_rows(probes, group)
    if fitted is None:
        empty = F.lit(None)
        return asked.select("case_id", empty.cast("long").alias("match_case_id"), empty.cast("double").alias("similarity"),
                            F.lit(0).cast("long").alias("compared"), F.lit(True).alias("closed"))
    shared = gallery.sparkSession.sparkContext.broadcast((fitted.centres, fitted.parts, fitted.visits))
    unit = _units()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                cosine = unit(batch.column("embedding")) @ centres.T
                own = cosine.argmax(axis=1)
                ids = batch.column("case_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                angle = np.arccos(np.clip(cosine[np.arange(len(own)), own], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array((ids % parts[own].astype(np.uint64)).astype(np.int32)), pa.array(angle),
                     batch.column("case_id"), batch.column("grp"), batch.column("embedding")],
                    ["list", "part", "angle", "case_id", "grp", "embedding"])

    placed = face_rows(gallery, group).mapInArrow(
        assign, "list int, part int, angle double, case_id long, grp long, embedding array<double>")
    radius = np.full(len(fitted.centres), -np.inf)
    for row in placed.groupBy("list").agg(F.max("angle").alias("angle")).collect():  # a row per list
        radius[row["list"]] = row["angle"]

    rows, columns = grid(int(gallery.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Faces of a column in blocks of several lists, or of a part of a long one."""
        names = ["grid_column", "face_lists", "face_ids", "face_groups", "face_vectors"]
        for batch in batches:
            of = batch.column("grid_column").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for lo, hi in zip(edges, [*edges[1:], len(of)]):
                for at in range(lo, hi, block_rows):
                    part = batch.slice(at, min(block_rows, hi - at))
                    blobs = (*(part.column(c).to_numpy() for c in ("list", "case_id", "grp")), unit(part.column("embedding")))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([of[lo]], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names)

    dealt = placed.drop("angle").withColumn("grid_column", F.pmod(F.col("list") + F.col("part"), F.lit(columns)).cast("int")).drop("part")
    blocks = dealt.repartition("grid_column").sortWithinPartitions("grid_column", "list", "case_id").mapInArrow(
        pack, "grid_column int, face_lists binary, face_ids binary, face_groups binary, face_vectors binary").withColumn("grid_row", every(rows))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probes as blocks: which lists each visits, in bits, and how good a face of the other lists could be."""
        centres, _, visits = shared.value
        names = ["probe_ids", "probe_groups", "probe_vectors", "probe_bounds", "probe_lists"]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit(batch.column("embedding"))
            ids, groups = batch.column("case_id").to_numpy(), batch.column("grp").to_numpy()
            cosine = vectors @ centres.T
            order = np.argsort(-cosine, axis=1, kind="stable")
            apart = np.arccos(np.clip(cosine, -1.0, 1.0)) - radius
            np.put_along_axis(apart, order[:, :visits], np.inf, axis=1)
            bounds = (np.cos(np.clip(apart, 0.0, np.pi)) + 1.0) / 2.0
            bounds = np.where(np.isinf(apart), -1.0, bounds).max(axis=1)
            near = np.zeros(cosine.shape, bool)
            np.put_along_axis(near, order[:, :visits], True, axis=1)
            blobs = (ids, groups, vectors, bounds, np.packbits(near, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], names)

    visiting = asked.mapInArrow(visit, ", ".join(f"probe_{c} binary" for c in ("ids", "groups", "vectors", "bounds", "lists"))).withColumn(
        "grid_row", F.pmod(F.xxhash64("probe_ids"), F.lit(rows)).cast("int")).withColumn("grid_column", every(columns))
    meet = _meeting(threshold, exclude is not None)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = asked_ids = best = top = compared = None

        def told() -> pa.RecordBatch:
            none = top < 0.0
            return pa.RecordBatch.from_arrays(
                [pa.array(probe), pa.array(best, mask=none), pa.array(top, mask=none), pa.array(compared), pa.array(bound)],
                ["case_id", "match_case_id", "similarity", "compared", "bound"])

        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py() or b"", kind)
                ids = read("probe_ids", np.int64).tobytes()
                if ids != asked_ids:  # a probe block meets its faces one after the other
                    if asked_ids is not None:
                        yield told()
                    asked_ids, probe, bound = ids, np.frombuffer(ids, np.int64), read("probe_bounds", np.float64)
                    groups, vectors = read("probe_groups", np.int64), read("probe_vectors", np.float64).reshape(len(probe), -1)
                    near = np.unpackbits(read("probe_lists", np.uint8).reshape(len(probe), -1), axis=1).view(bool)
                    singles = vectors.astype(np.float32)
                    best, top = np.zeros(len(probe), np.int64), np.full(len(probe), -1.0)
                    compared = np.zeros(len(probe), np.int64)
                face, of, face_groups = read("face_ids", np.int64), read("face_lists", np.int32), read("face_groups", np.int64)
                faces = read("face_vectors", np.float64).reshape(len(face), -1) if len(face) else None
                face_singles = faces.astype(np.float32) if len(face) else None
                edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
                for lo, hi in zip(edges, [*edges[1:], len(of)]):
                    who = np.flatnonzero(near[:, of[lo]])
                    if not len(who):
                        continue
                    found, score = best[who], top[who]
                    meet((probe[who], groups[who], vectors[who], singles[who]),
                         (face[lo:hi], face_groups[lo:hi], faces[lo:hi], face_singles[lo:hi]), found, score)
                    best[who], top[who] = found, score
                    compared[who] += hi - lo
        if asked_ids is not None:
            yield told()

    # the planner takes the copies for as small as the table they come from and would broadcast them through the driver
    found = visiting.join(blocks.hint("merge"), ["grid_row", "grid_column"], "left").drop("grid_row", "grid_column").mapInArrow(
        compare, "case_id long, match_case_id long, similarity double, compared long, bound double")
    best = F.max_by(F.struct("match_case_id", "similarity"), F.when(
        F.col("similarity").isNotNull(), F.struct("similarity", -F.col("match_case_id"))))
    result = found.groupBy("case_id").agg(best.alias("b"), F.sum("compared").alias("compared"), F.max("bound").alias("bound")).select(
        "case_id", "b.match_case_id", "b.similarity", "compared",
        (F.col("bound") < F.coalesce("b.similarity", F.lit(threshold)) - 1e-9).alias("closed"))
    if not exact:
        return result
    again = gallery_best_match(probes.join(result.where("not closed").select("case_id"), "case_id", "left_semi"), gallery, threshold, exclude)
    sure = result.join(again.select("case_id", F.struct("match_case_id", "similarity").alias("e")), "case_id", "left")
    return sure.select("case_id", *[F.when(F.col("closed"), F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) for c in ("match_case_id", "similarity")],
                       "compared", F.lit(True).alias("closed"))


def index_recall(found: DataFrame, exact: DataFrame, gallery_rows: DataFrame) -> DataFrame:
    """One row on an index search: probes, exact_matches, recall (share of them found alike) and compared_share of all pairs."""
    told = found.join(exact.select("case_id", F.col("match_case_id").alias("exact_case_id")), "case_id", "left")
    alike = F.sum(F.when(F.col("match_case_id") == F.col("exact_case_id"), 1).otherwise(0))
    totals = told.agg(F.count("*").alias("probes"), F.count("exact_case_id").alias("exact_matches"), alike.alias("_alike"),
                      F.sum("compared").alias("_compared"))
    return totals.crossJoin(F.broadcast(gallery_rows.agg(F.count("*").alias("_faces")))).select(
        "probes", "exact_matches", (F.col("_alike") / F.col("exact_matches")).alias("recall"),
        (F.col("_compared") / (F.col("probes") * F.col("_faces"))).alias("compared_share"))
