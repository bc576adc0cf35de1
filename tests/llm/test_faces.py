import numpy as np
import pytest

from docuvet.llm import components, lookalikes, nearest

SCHEMA = "case_id long, embedding array<float>, country string"


@pytest.fixture(scope="module")
def gallery(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32)).astype(np.float32)
    rows = [(i, v.tolist(), "UTO" if i % 3 else "IND") for i, v in enumerate(base)]
    for i in range(300, 360):  # looks like one of the first ten
        v = base[i % 10] + 0.12 * rng.standard_normal(32)
        rows.append((i, v.astype(np.float32).tolist(), "UTO"))
    rows += [(400, base[1].tolist(), "UTO"), (401, base[1].tolist(), "UTO"), (402, base[2].tolist(), None), (5, rows[5][1], rows[5][2])]
    rows += [(500, None, "UTO"), (501, [0.0] * 32, "UTO"), (502, [1.0] * 31 + [None], "UTO"), (503, [float("nan")] * 32, "UTO"),
             (504, [float("inf")] + [1.0] * 31, "UTO"), (505, [1.0] * 7, "UTO"), (None, base[1].tolist(), "UTO")]
    return rows


def usable(rows):
    """Case ids, unit rows and groups of what may take part, once each."""
    good = {(i, tuple(v), g) for i, v, g in rows
            if i is not None and v is not None and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = sorted(good, key=lambda r: r[0])
    vectors = np.array([r[1] for r in good], float)
    return [r[0] for r in good], vectors / np.linalg.norm(vectors, axis=1, keepdims=True), [r[2] for r in good]


def test_search_is_exact_where_it_looks_and_finds_nearly_all(spark, gallery):
    faces = spark.createDataFrame(gallery, SCHEMA)
    got = nearest.nearest_faces(faces.where("case_id % 5 = 0"), faces).collect()
    ids, unit, _ = usable(gallery)
    near = unit @ unit.T
    np.fill_diagonal(near, -2.0)
    hits = total = 0
    for row, case in enumerate(ids):
        if case % 5:
            continue
        mine = sorted((r for r in got if r.case_id == case), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        for r in mine:
            assert r.similarity == pytest.approx(near[row, ids.index(r.match_case_id)], abs=1e-12)
        assert [(-r.similarity, r.match_case_id) for r in mine] == sorted((-r.similarity, r.match_case_id) for r in mine)
        best = np.sort(near[row])[::-1][4]
        hits += sum(r.similarity >= best - 1e-9 for r in mine)
        total += 5
    assert len(got) == total and hits >= 0.9 * total


def test_copies_tie_to_the_smaller_case(spark, gallery):
    faces = spark.createDataFrame(gallery, SCHEMA)
    got = nearest.nearest_faces(faces.where("case_id = 401"), faces, k=2).orderBy("rank").collect()
    assert [r.match_case_id for r in got] == [1, 400] and got[0].similarity == got[1].similarity


def test_small_and_empty_galleries(spark, gallery):
    few = spark.createDataFrame(gallery[:3], SCHEMA)
    got = nearest.nearest_faces(few, few).collect()
    assert sorted((r.case_id, r.match_case_id) for r in got) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert nearest.nearest_faces(few, few.limit(0)).count() == 0
    assert nearest.nearest_faces(few.limit(0), few).count() == 0


def test_scan_abandons_without_losing_the_nearest():
    rng = np.random.default_rng(1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    rows, probes = unit(rng.standard_normal((800, 64))), unit(rng.standard_normal((40, 64)))
    probe, row = nearest.scan(probes, np.full(40, 4.0), rows, 5)
    best = np.argsort(-(probes @ rows.T), axis=1)[:, :5]
    kept = set(zip(probe.tolist(), row.tolist()))
    assert sum((i, j) in kept for i in range(40) for j in best[i]) >= 0.97 * 200
    assert len(kept) < 40 * 40


@pytest.mark.parametrize("block_rows", [512, 16])
def test_links_match_brute_force(spark, gallery, monkeypatch, block_rows):
    monkeypatch.setattr(lookalikes, "BLOCK_ROWS", block_rows)
    faces = spark.createDataFrame(gallery, SCHEMA)
    got = lookalikes.near_duplicate_faces(faces).collect()
    assert len(got) == len(gallery)
    ids, unit, group = usable(gallery)
    near = (unit @ unit.T >= 0.93) & (np.array(group, object)[:, None] == np.array(group, object)[None, :])
    near &= np.array([g is not None for g in group])[:, None]
    np.fill_diagonal(near, False)
    node, root = components.forest(*[np.array(ids)[x] for x in np.nonzero(near)])
    root = dict(zip(node.tolist(), root.tolist()))
    want = {i: (int(n), root.get(i, i)) for i, n in zip(ids, near.sum(axis=1))}
    assert near.sum() > 300
    for r in got:
        links, component = want.get(r.case_id, (0, r.case_id))
        assert (r.n_links, r.component_id) == (links, component)
        assert r.kept == (r.case_id == r.component_id)


def test_count_is_calibrated():
    least = lookalikes.least_count(0.93)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((20_000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal(a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    turn = lookalikes.directions(32)
    agree = (np.abs((a - b) @ turn) <= lookalikes.HALF_WINDOW).sum(axis=1)
    assert (agree >= least).mean() >= 0.998


def test_empty_gallery(spark):
    assert lookalikes.near_duplicate_faces(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_meet_without_being_shuffled_in_pairs(spark, monkeypatch, capsys):
    """Blocks of one large group are dealt once; a pair of blocks costs no disk, and links are those of all pairs."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((900, 24)).astype(np.float32)
    base[600:] = base[:300] + 0.05 * rng.standard_normal((300, 24)).astype(np.float32)
    faces = spark.createDataFrame([(i, v.tolist(), "UTO") for i, v in enumerate(base)], SCHEMA)
    monkeypatch.setattr(lookalikes, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lookalikes, "PART_BYTES", 1 << 14)
    written = {}
    staged = lookalikes.materialize
    monkeypatch.setattr(lookalikes, "materialize", lambda df, purpose: (df.explain(), written.update({purpose: capsys.readouterr().out}), staged(df, purpose))[2])
    got = {r.case_id: r for r in lookalikes.near_duplicate_faces(faces).collect()}
    plan = written["face-links"]
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "explode" not in plan
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= lookalikes.SIMILARITY
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(900)] == near.sum(axis=1).tolist() and near.any()
