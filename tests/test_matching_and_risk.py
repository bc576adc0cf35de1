"""Watchlist, gallery and scoring behaviour on small tables and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuvet.functions.numbers import round_exact
from docuvet.functions.phonetic import metaphone
from docuvet.operators import evaluate, gallery, matching, risk, signals

ENTRIES = [
    (1, "WL-1", "VIKTOR KOROL", "P8892144", "CRITICAL", "c", True),
    (2, "WL-2", "ELENA ROSTOVA", "A9938210", "HIGH", "c", True),
    (3, "WL-3", "MARCUS VANCE", "M7744112", "MEDIUM", "c", True),
    (4, "WL-4", "IDLE PERSON", "Z0000001", "HIGH", "c", False),
]


def screen(spark, cases):
    entries = spark.createDataFrame(
        ENTRIES, "entry_order int, watchlist_id string, name string, document_number string, severity string, category string, active boolean"
    )
    df = spark.createDataFrame(cases, "case_id int, full_name string, document_number string")
    return {r.case_id: r for r in matching.watchlist_screen(df, entries).collect()}


def test_watchlist_vectors(spark):
    hits = screen(spark, [
        (1, None, "P8B92144"), (2, "VIKT0R KOROL", None), (3, "MARKUS VANSE", ""), (4, "MARKOOS VANCE", None),
        (5, None, "P8B92l44"), (6, "JOHN SMITH", "Q1"), (7, "IDLE PERSON", "Z0000001"), (8, "", ""),
        (9, "ELENA MARIA ROSTOVA", "M7744112"), (10, "MARCUS VANCE", "A-993 8210"),
    ])
    assert {k: v.watchlist_id for k, v in hits.items()} == {
        1: "WL-1", 2: "WL-1", 3: "WL-3", 4: "WL-3", 9: "WL-2", 10: "WL-2",
    }
    assert [m.method for m in hits[3].match_evidence] == ["EDIT_DISTANCE", "EDIT_DISTANCE"]
    assert hits[1].match_field == "Document Number" and hits[1].match_evidence is None
    assert hits[9].match_field == "Full Name" and hits[10].match_field == "Document Number"


def test_token_methods(spark):
    pairs = [("MARCUS", "MARKUS", "EDIT_DISTANCE"), ("SEAN", "SHAWN", "SOUNDEX"), ("KNIGHT", "NITE", "METAPHONE"),
             ("KATHERINE", "CATHERINE", "EDIT_DISTANCE"), ("STEPHENSON", "STEVENSON", "SOUNDEX"), ("JOHN", "JOHN", "EXACT"),
             ("JOHN", "MARCUS", None), ("AL", "EL", None)]
    left = spark.createDataFrame([(a,) for a, _, _ in pairs], "token string")
    right = spark.createDataFrame([(b,) for _, b, _ in pairs], "token string")
    got = {(r.token_a, r.token_b): r.method for r in matching.token_match(left, right).collect()}
    for a, b, method in pairs:
        assert got.get((a, b)) == method, (a, b)


def test_metaphone_vectors(spark):
    words = {"KNIGHT": "NT", "NITE": "NT", "KATHERINE": "K0RN", "SEAN": "SN", "SHAWN": "XN", "WHITE": "WT", "BRIDGE": "BRJ",
             "THUMB": "0M", "METAPHONE": "MTFN", "KNIFE": "NF", "GNOME": "NM", "PHILIP": "FLP", "XAVIER": "SFR", "MATCH": "MX", "NATION": "NXN", "LAMB": "LM", "SCIENCE": "SNS", "": ""}
    df = spark.createDataFrame(list(words.items()), "w string, code string")
    for r in df.select("w", "code", metaphone(F.col("w")).alias("got")).collect():
        assert r.got == r.code, r


def test_each_phonetic_method_tells_its_own_pairs_apart(spark):
    # pairs that only one of the two codes joins, and pairs that both or none join
    pairs = [("SEAN", "SHAWN", True, False), ("KNIGHT", "NITE", False, True), ("ROBERT", "RUPERT", True, False),
             ("PHILIP", "FILIP", False, True), ("SMITH", "SMYTH", True, True), ("JOHN", "MARCUS", False, False)]
    df = spark.createDataFrame(pairs, "a string, b string, soundex boolean, metaphone boolean")
    same = df.withColumns({"s": F.soundex("a") == F.soundex("b"), "m": metaphone(F.col("a")) == metaphone(F.col("b"))})
    for r in same.collect():
        assert (r.s, r.m) == (r.soundex, r.metaphone), r


def test_one_name_shared_by_most_cases(spark):
    cases = [(i, "VIKTOR KOROL" if i % 3 else f"PERSON {i}", None) for i in range(600)]
    assert len(screen(spark, cases)) == 400


@pytest.mark.parametrize("block, threshold", [(7, 0.0), (7, 0.8), (64, 0.62), (4096, 0.62)])
def test_gallery_search_equals_brute_force(spark, block, threshold):
    rng = np.random.default_rng(3)
    # A third of the gallery is one tight cluster, some vectors are repeated.
    centre = rng.normal(size=16)
    vectors = [centre + 0.05 * rng.normal(size=16) for _ in range(40)] + [rng.normal(size=16) for _ in range(80)]
    vectors[5] = vectors[6]
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows + [(500, [0.0] * 16, 0), (501, None, 0)], "case_id long, embedding array<double>, grp int")
    got = {r.case_id: (r.match_case_id, r.similarity)
           for r in gallery.gallery_best_match(df, df, threshold=threshold, exclude="grp", block_rows=block).collect()}
    m = np.array(vectors)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(np.clip((m @ m.T + 1) / 2, 0, 1), 12)
    want = {}
    for i in range(len(m)):
        best = max((j for j in range(len(m)) if j % 4 != i % 4), key=lambda j: (sims[i, j], -j))
        if sims[i, best] >= threshold:
            want[i] = (best, sims[i, best])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_gallery_keeps_one_newest_row_per_case(spark):
    held = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "case_id int, created_at int, embedding array<double>")
    new = spark.createDataFrame([(2, 5, [3.0]), (2, 7, [4.0]), (3, 1, [5.0])], held.schema)
    once = gallery.gallery_upsert(held, new)
    twice = gallery.gallery_upsert(once, new)
    rows = lambda df: sorted((r.case_id, r.created_at, r.embedding[0]) for r in df.collect())
    assert rows(once) == rows(twice) == [(1, 0, 1.0), (2, 7, 4.0), (3, 1, 5.0)]


CHECK = "case_id int, factor string, score_impact double, severity string"


def score(spark, checks=(), tamper=None, face=None, hit=None, duplicate=None, mrz=None):
    cases = spark.createDataFrame([(1,)], "case_id int")
    make = lambda rows, schema: spark.createDataFrame(rows, schema) if rows else None
    facts = risk.gather(
        cases, make(list(checks), CHECK), make(tamper and [(1, tamper)], "case_id int, tamper_risk double"),
        make(face and [(1, *face)], "case_id int, face_status string, face_similarity double"),
        make(mrz and [(1, *mrz)], "case_id int, birth_date string, expiry_date string"),
        make(hit and [(1, hit)], "case_id int, severity string"), make(duplicate and [(1, duplicate)], "case_id int, similarity double"),
    )
    scored = risk.score_cases(facts, as_of="2026-01-01")
    row = scored.first()
    total = sum(r.weighted_contribution for r in risk.breakdown_rows(scored).collect())
    assert abs(min(100.0, total) - row.risk_score) < 0.05
    return row


def test_clean_case_is_low(spark):
    row = score(spark, tamper=0.08, face=("MATCH", 0.92))
    assert row.risk_level == "LOW" and row.status == "LOW_RISK"


def test_everything_wrong_is_critical(spark):
    row = score(spark, [(1, "MRZ_VALIDATION", 100.0, "HIGH"), (1, "CONSISTENCY", 100.0, "HIGH")], 0.96, ("REVIEW_REQUIRED", 0.1), "CRITICAL", 0.95)
    assert row.risk_level == "CRITICAL" and row.risk_score <= 100.0


def test_one_critical_check_floors_the_score(spark):
    row = score(spark, [(1, "MRZ_VALIDATION", 28.0, "CRITICAL")], 0.05, ("MATCH", 0.95))
    assert row.critical_floor_applied and row.risk_score == 49.1 and row.risk_level == "HIGH"
    assert not score(spark, tamper=0.05, face=("MATCH", 0.95), hit="MEDIUM").critical_floor_applied


def test_rounding_is_half_even_on_the_binary_value(spark):
    # 17 * 0.25 = 4.25 is an exact tie and goes to the even tenth.
    assert score(spark, [(1, "MRZ_VALIDATION", 17.0, None)]).mrz_contrib == 4.2
    got = spark.range(1).select(round_exact(F.lit(0.15), 1).alias("a"), round_exact(F.lit(2.675), 2).alias("b")).first()
    assert (got.a, got.b) == (round(0.15, 1), round(2.675, 2))


def test_age_gap_discounts_matches_only(spark):
    old = ("700101", "260601")
    assert score(spark, face=("MATCH", 0.8), mrz=old).face_weight == 0.15
    assert score(spark, face=("REVIEW_REQUIRED", 0.5), mrz=old).face_weight == 0.3
    assert score(spark, face=("MATCH", 0.8), mrz=("700101", "bad")).face_weight == 0.3


def test_exif_vectors(spark):
    rows = [(1, {}), (2, {305: "Canon"}), (3, {305: "Adobe Photoshop"}), (4, {306: "2024:01:05 00:00:00", 36867: "2024:01:01 00:00:00"}),
            (5, {306: "not a date", 36867: "2024:01:01 00:00:00"}), (6, {306: "2024:01:05 00:00:00", 36868: "2024:01:04 12:00:00"})]
    df = spark.createDataFrame(rows, "case_id int, tags map<int,string>")
    got = {(r.case_id, r.type): r.confidence for r in signals.exif_signals(df).collect()}
    assert got == {(1, "exif_metadata_missing"): 0.35, (3, "exif_editing_software"): 0.85, (4, "exif_date_inconsistency"): round(0.6 + 96 / 500, 2)}


def test_patches_mostly_inside_a_code_are_dropped(spark):
    rng = np.random.default_rng(5)
    box = lambda i, q: (int(i % 3), i, int(rng.integers(0, 300)), int(rng.integers(0, 300)), int(rng.integers(36, 120)), int(rng.integers(19, 90)), 2000.0, q)
    rows = [box(i, i % 3 == 1) for i in range(300)]
    df = spark.createDataFrame(rows, "image_id int, box_no int, x int, y int, w int, h int, variance double, is_qr boolean")
    got = {(r.image_id, r.box_no) for r in signals.splice_boxes(df.where("not is_qr"), df.where("is_qr")).collect()}
    want = set()
    for image in range(3):
        kept = []
        for r in rows:
            if r[0] != image or r[7] or not (1500 < r[4] * r[5] < 70000) or max(r[4], r[5]) / min(r[4], r[5]) > 8:
                continue
            over = lambda q: max(0, min(r[2] + r[4], q[2] + q[4]) - max(r[2], q[2])) * max(0, min(r[3] + r[5], q[3] + q[5]) - max(r[3], q[3]))
            if not any(q[7] and q[0] == image and over(q) > 0.5 * r[4] * r[5] for q in rows):
                kept.append((image, r[1]))
        want |= set(sorted(kept)[:5])
    assert got == want


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in np.round(rng.random(500), 2)] + [("b", 0.5)] * 300 + [("b", 0.1), ("c", 0.3)]
    df = spark.createDataFrame(rows, "g string, s double")
    for r in evaluate.exact_percentiles(df, "g", "s", [0.5, 0.9, 0.99], bins=16).collect():
        values = [s for g, s in rows if g == r.g]
        for got, q in zip((r.p50, r.p90, r.p99), (50, 90, 99)):
            assert abs(got - np.percentile(values, q)) < 1e-9


@pytest.mark.parametrize("key", [
    "b6_aadhaar_fields", "b7_pan_fields", "b8_driving_licence_fields", "b9_voter_id_fields", "b10_visa_fields", "b11_permit_fields",
    "b12_passport_fields", "f4_name_match"])
def test_a_filter_does_not_become_a_join_of_row_against_row(spark, sf_dir, key):
    from docuvet.plans import registry

    assert "NestedLoopJoin" not in registry.queries()[key](spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", ["b3_value_after_fuzzy_label", "c9_parse_mrz", "k7_mrz_line_accuracy"])
def test_work_on_few_bytes_is_dealt_to_all_tasks(spark, sf_dir, key):
    from docuvet.plans import registry

    assert "RoundRobinPartitioning" in registry.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_few_bytes_of_names_are_coded_by_all_tasks(spark):
    names = spark.createDataFrame([(f"NAME {i}",) for i in range(400)] + [(None,), ("",), (" ",)], "name string")
    coded = matching._coded_names(names, "query_name", "q")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert coded.rdd.getNumPartitions() == tasks > 1
    assert coded.count() == 400 and coded.where("size(q) <> 2").count() == 0


def test_checks_are_folded_to_numbers_before_texts_are_sorted(spark, capsys):
    """Many checks to a case: they are hashed, not sorted, and fold to what every single one gives."""
    cases = spark.createDataFrame([(1,), (2,), (None,)], "case_id long")
    rows = [(1, "MRZ_VALIDATION", 12.5, "LOW"), (1, "MRZ_VALIDATION", 12.5, "LOW"), (1, "CONSISTENCY", 150.0, None),
            (2, "TAMPER", 30.0, "CRITICAL"), (None, "CONSISTENCY", 7.25, "HIGH"), (3, "CONSISTENCY", 1.0, "CRITICAL")]
    checks = spark.createDataFrame(rows, "case_id long, factor string, score_impact double, severity string")
    got = risk.gather(cases, checks)
    got.explain()
    assert "HashAggregate(keys=[case_id" in capsys.readouterr().out
    assert {r.case_id: (r.mrz_raw, r.consistency_raw, r.has_critical) for r in got.collect()} == {
        1: (25.0, 100.0, False), 2: (0.0, 0.0, True), None: (0.0, 7.25, False)}
