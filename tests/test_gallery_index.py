"""Index search against the exact product."""

import numpy as np
import pytest

from compare import compare, connect
from docuvet.operators import gallery, gallery_index
from docuvet.plans import registry

SHAPE = "case_id long, embedding array<double>, label string"


def rows(df):
    return {r.case_id: (r.match_case_id, r.similarity) for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    """Captures of 300 people, some alone, one person with a third of all rows."""
    rng = np.random.default_rng(2)
    who = np.concatenate([np.zeros(400, int), rng.integers(1, 300, 800)])
    faces = rng.normal(size=(300, 48))[who] + 0.45 * rng.normal(size=(1200, 48))
    made = [(i, [float(x) for x in v], str(w)) for i, (v, w) in enumerate(zip(faces, who))]
    made += [(5_000, None, "x"), (5_001, [0.0] * 48, "x"), (5_002, made[7][1], None)]
    return spark.createDataFrame(made, SHAPE)


def test_recall_and_compared_pairs(people):
    probes = people.where("case_id % 3 = 0")
    exact = gallery.gallery_best_match(probes, people)
    found = gallery_index.indexed_best_match(probes, people)
    told = gallery_index.index_recall(found, exact, people).first()
    assert told.recall >= 0.99 and told.compared_share < 0.5 and told.exact_matches > 300
    assert found.count() == gallery.face_rows(probes, "case_id").count()
    right = rows(exact)
    assert all(right[c] == v for c, v in rows(found.where("closed")).items() if v[0] is not None)


@pytest.mark.parametrize("exclude", [None, "label"])
def test_exact_fallback_equals_the_product(people, exclude):
    probes = people.where("case_id % 7 = 0 or case_id >= 5000")
    found = gallery_index.indexed_best_match(probes, people, exclude=exclude, exact=True)
    assert rows(found.where("match_case_id is not null")) == rows(gallery.gallery_best_match(probes, people, exclude=exclude))


def test_tight_clusters_close_by_their_angles(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(24)[:12]
    made = [(i, [float(x) for x in centres[i % 12] + 0.01 * rng.normal(size=24)], None) for i in range(600)]
    people = spark.createDataFrame(made, SHAPE)
    found = gallery_index.indexed_best_match(people, people, threshold=0.9, lists=12)
    assert found.where("not closed").count() == 0
    assert rows(found.select("case_id", "match_case_id", "similarity")) == rows(gallery.gallery_best_match(people, people, threshold=0.9))


def test_empty_gallery_and_no_probe(spark, people):
    empty = people.where("false")
    none = gallery_index.indexed_best_match(people.limit(5), empty).collect()
    assert none and all(r.match_case_id is None and r.closed for r in none)
    assert gallery_index.indexed_best_match(empty, people).count() == 0


@pytest.mark.parametrize("key", ["f9_indexed_match", "f9_index_recall"])
def test_queries_match_their_twins(key, spark, sf_dir):
    difference = compare(registry.queries()[key](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[key])
    assert difference is None, difference


@pytest.mark.parametrize("cells", [1, 2, 3, 24, 25, 26, 200])
def test_a_face_travels_about_the_square_root_of_the_cells(cells):
    rows, columns = gallery.grid(cells)
    assert rows * columns >= cells
    assert max(rows, columns) <= cells**0.5 + 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(90, 8)).astype(np.float32 if kind == "float" else np.float64)
    vectors[60:80] = vectors[10:30] * 2  # ties: the smaller case wins
    faces = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"case_id long, embedding array<{kind}>").repartition(5)
    found = {r.case_id: (r.match_case_id, r.similarity) for r in gallery.gallery_best_match(faces, faces, 0.0, block_rows=4).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    scores = np.round((unit @ unit.T + 1) / 2, 9)
    np.fill_diagonal(scores, -1)
    assert {k: v[0] for k, v in found.items()} == {i: int(row.argmax()) for i, row in enumerate(scores)}
    assert all(abs(v[1] - scores[k].max()) < 1e-8 for k, v in found.items())


def test_copies_of_faces_are_not_broadcast(spark):
    faces = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "case_id long, embedding array<float>")
    plan = gallery.gallery_best_match(faces, faces)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_probes_travel_along_a_grid_however_many_lists_they_visit(people):
    probes = people.where("case_id % 11 = 0")
    found = gallery_index.indexed_best_match(probes, people, lists=64, recall=1.0, exact=True, block_rows=7)
    assert rows(found.where("match_case_id is not null").select("case_id", "match_case_id", "similarity")) == rows(gallery.gallery_best_match(probes, people))
    assert found.count() == gallery.face_rows(probes, "case_id").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join LeftOuter" in line and "grid_row" in line for line in plan.split("\n"))


@pytest.mark.parametrize("dense", [False, True])
def test_single_precision_rules_out_and_double_decides(monkeypatch, dense):
    """Scores that single precision cannot tell apart: the double product orders them, of equals the smaller id wins."""
    rng = np.random.default_rng(8)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    probes = unit(rng.normal(size=(40, 64)))
    near = np.repeat(probes, 6, axis=0) + 1e-5 * rng.normal(size=(240, 64))
    faces = unit(np.concatenate([near, near[::3], rng.normal(size=(700, 64))]))
    side = lambda ids, m: (ids, ids % 5, m, m.astype(np.float32))
    ids, face_ids = np.arange(40), 100 + np.arange(len(faces))
    if dense:
        monkeypatch.setattr(gallery, "ONE_IN", 10**9)
    for barred in (False, True):
        best, score = np.zeros(40, np.int64), np.full(40, -1.0)
        meet = gallery._meeting(0.8, barred)
        for at in range(0, len(faces), 250):
            part = slice(at, at + 250)
            meet(side(ids, probes), side(face_ids[part], faces[part]), best, score)
        want = np.round(np.clip((np.einsum("ik,jk->ij", probes, faces) + 1) / 2, 0, 1), 12)
        if barred:
            want[(ids % 5)[:, None] == (face_ids % 5)[None, :]] = -1
        assert np.abs(score - want.max(axis=1)).max() <= 1e-12
        assert (np.abs(want[ids, best - 100] - want.max(axis=1)) <= 1e-12).all()


def test_blocks_of_faces_below_the_threshold_are_not_multiplied_twice(monkeypatch):
    """Pairs that single precision rules out cost no product in double precision."""
    rng = np.random.default_rng(9)
    faces = rng.normal(size=(512, 64))
    faces /= np.linalg.norm(faces, axis=1, keepdims=True)
    seen = []
    multiply = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: seen.append(len(a)) or multiply(how, a, b))
    side = lambda ids: (ids, ids, faces, faces.astype(np.float32))
    best, score = np.zeros(512, np.int64), np.full(512, -1.0)
    gallery._meeting(0.8, False)(side(np.arange(512)), side(512 + np.arange(512)), best, score)
    assert (best == 512 + np.arange(512)).all() and (score == 1.0).all()
    assert sum(seen) < 512 * 512 // 16
