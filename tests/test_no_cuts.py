"""Behaviour on data that earlier limits, buckets or assumptions would have cut."""

import pytest
from pyspark.sql import functions as F

from docuvet.operators import analytics, gallery, lifecycle, matching, risk, signals, trainset
from docuvet.plans import fixtures


def test_pages_may_be_longer_than_two_hundred_rows(spark):
    audit = spark.range(500).selectExpr("id as seq", "timestamp_seconds(id) as event_ts", "'UPLOADED' as action", "'O' as actor", "id as case_id")
    assert analytics.audit_search(audit, limit=400).count() == 400
    assert analytics.audit_search(audit, limit=400, offset=300).count() == 200


def submissions(spark, rows):
    fields = "document_number surname given_names birth_date expiry_date sex nationality country".split()
    made = [(key, version, *[changed if f == "surname" else "x" for f in fields]) for key, version, changed in rows]
    return spark.createDataFrame(made, f"identity_key long, version long, {', '.join(f + ' string' for f in fields)}")


def test_submissions_are_compared_over_version_gaps(spark):
    df = submissions(spark, [(1, 1, "A"), (1, 3, "B"), (1, 4000, "B"), (2, 7, "C"), (2, 9, "D")])
    got = {(r.identity_key, r.version): (r.status, list(r.changed_fields)) for r in matching.change_summary(df).collect()}
    assert got == {(1, 3): ("CHANGED", ["Surname"]), (1, 4000): ("UNCHANGED", []), (2, 9): ("CHANGED", ["Surname"])}


def test_each_case_is_scored_under_every_policy(spark):
    columns = ["policy_id", "weight_mrz", "weight_tamper", "weight_face", "weight_consistency", "weight_watchlist",
               "threshold_low", "threshold_medium", "threshold_high"]
    policies = spark.createDataFrame([(i, 0.25, 0.3, 0.3, 0.1, 0.05, 10.0 + i, 50.0, 75.0) for i in range(1, 9)], columns)
    facts = risk.gather(spark.createDataFrame([(1,), (2,)], "case_id long"))
    scored = risk.score_cases(risk.under_every_policy(facts, policies), policies, "2026-01-01").collect()
    assert sorted((r.case_id, r.policy_id) for r in scored) == [(c, p) for c in (1, 2) for p in range(1, 9)]
    level = {r.policy_id: r.risk_level for r in scored if r.case_id == 1}
    score = scored[0].risk_score
    assert level == {p: "LOW" if score <= 10 + p else "MEDIUM" for p in range(1, 9)}


def test_a_watchlist_entry_without_severity_still_fails_the_check(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    evidence = "array<struct<method:string,query_token:string,matched_token:string,edit_distance:int>>"
    hits = spark.createDataFrame([(1, None, "Fraud", None)], f"case_id long, severity string, category string, match_evidence {evidence}")
    got = {r.case_id: r.status for r in risk.watchlist_checks(cases, hits).collect()}
    assert got == {1: "FAIL", 2: "PASS"}
    facts = risk.gather(cases, watchlist=hits)
    assert {r.case_id: r.watchlist_raw for r in risk.score_cases(facts, as_of="2026-01-01").collect()} == {1: 100.0, 2: 0.0}


def test_no_draw_of_a_missing_domain_is_lost(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(20)] + [(99, "unlisted")], "id long, domain string")
    got = trainset.domain_balanced_sample(rows, {"a": 0.5, "b": 0.5}, 100).collect()
    assert len(got) == 100 and {r.domain for r in got} == {"a"}
    assert trainset.domain_balanced_sample(rows, {"b": 1.0}, 100).count() == 0
    weights = {r.id: r.weight for r in trainset.domain_weights(rows, {"a": 0.5, "b": 0.5}).collect()}
    assert weights[99] == 0.0 and sum(weights.values()) == pytest.approx(1.0)


def test_labels_are_dense_whatever_the_names_look_like(spark):
    names = [f"YLFW:Train-Balanced-{i:04d}" for i in range(700)] + ["A", "é", "zz"]
    images = spark.createDataFrame([(n,) for n in names for _ in range(2)] + [("single",)], "identity string")
    got = {r.identity: r.label for r in trainset.identity_labels(images).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 2e6])
def test_energy_share_does_not_depend_on_the_unit(spark, scale):
    low, _ = signals.fixed.FREQUENCY_BAND
    bins = spark.createDataFrame([(1, i, low, scale * (10.0 if i < 8 else 1.0)) for i in range(40)],
                                 "image_id long, bin_no long, radius double, magnitude double")
    assert signals.top_bin_share(bins).first().concentration == round(800 / 832, 3)


def test_only_existing_files_are_purged_and_counted(spark):
    cases = spark.createDataFrame([(1, "CS-1", False)], "case_id long, case_number string, biometrics_purged boolean")
    analyses = spark.createDataFrame([(1, "doc/1.jpg", None, False)],
                                     "case_id long, document_image_path string, face_image_path string, biometrics_purged boolean")
    faces = spark.createDataFrame([], "case_id long, embedding array<float>")
    stored = spark.createDataFrame([("doc/1.jpg",), ("heatmaps/1_tamper_heatmap.jpg",), ("other.jpg",)], "path string")
    got = lifecycle.purge_biometrics(cases.select("case_id"), cases, analyses, faces, F.to_timestamp(F.lit("2026-01-01")), "O", stored)
    assert sorted(r.path for r in got["artefacts"].collect()) == ["doc/1.jpg", "heatmaps/1_tamper_heatmap.jpg"]
    assert '"purged_files_count":"2"' in got["events"].first().metadata


def test_a_gallery_match_names_the_other_case(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0], "CS-1", "ANN"), (2, [1.0, 0.1], "CS-2", "BOB"), (3, [0.0, 1.0], "CS-3", "EVE")],
                                  "case_id long, embedding array<float>, case_number string, full_name string")
    got = {r.case_id: (r.match_case_number, r.match_full_name) for r in gallery.gallery_hits(faces, faces, threshold=0.9).collect()}
    assert got == {1: ("CS-2", "BOB"), 2: ("CS-1", "ANN")}
    labels = {r.case_id: r.label for r in risk.duplicate_checks(faces, gallery.gallery_hits(faces, faces, threshold=0.9)).collect()}
    assert labels[1].endswith("CS-2") and labels[3] == "Cross-Case Duplicate Identity Screening"


def test_staged_copies_can_be_cleared(spark, monkeypatch):
    from docuvet import session

    monkeypatch.setattr(session, "_STAGED", [])
    held = session.materialize(spark.range(10), "passing")
    assert held.count() == 10 and len(session._STAGED) == 1
    assert session.clear_staged(spark) == 1 and session.clear_staged(spark) == 0


def test_embeddings_of_unequal_length_are_named(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.0])], "case_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length|reshape"):
        gallery.gallery_best_match(faces, faces).collect()


@pytest.mark.parametrize("derived, base", [("fx_subjects", "customer"), ("fx_ocr_text", "customer"), ("fx_scores", "documents")])
def test_derived_tables_keep_every_row(spark, sf_dir, derived, base):
    assert fixtures.load(spark, sf_dir, derived).count() == spark.read.parquet(f"{sf_dir}/{base}.parquet").count() > 0
