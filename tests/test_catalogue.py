"""Every registered query against its SQL twin, on whole tables."""

import pytest

from compare import compare, connect
from docuvet.plans import registry

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    # the whole screening is tested against its parts instead, below
    assert set(QUERIES) - set(ORACLES) == {"screen_cases", "screen_checks", "screen_breakdown"}


def test_screened_scores_follow_from_their_checks_and_breakdown(spark, sf_dir):
    cases = QUERIES["screen_cases"](spark, sf_dir).collect()
    lines = QUERIES["screen_breakdown"](spark, sf_dir).collect()
    checks = QUERIES["screen_checks"](spark, sf_dir).collect()
    documents = QUERIES["b1_detect_document_type"](spark, sf_dir).count()
    policies = {r.policy_id for r in cases}
    assert len(policies) > 5 and len(cases) == documents * len(policies)
    default = {r.case_id: r for r in cases if r.policy_id == 1}
    by_case = {}
    for line in lines:
        by_case.setdefault(line.case_id, []).append(line)
    assert set(by_case) == set(default)
    impact = {}
    for c in checks:
        key = (c.case_id, c.factor)
        impact[key] = min(100.0, impact.get(key, 0.0) + c.score_impact)
    failed = {c.case_id for c in checks if c.status == "FAIL" and c.check_key.startswith("WATCHLIST")}
    for case, own in by_case.items():
        line = {x.factor: x for x in own}
        assert abs(line["MRZ & Document Validation"].raw_risk - impact.get((case, "MRZ_VALIDATION"), 0.0)) < 0.06
        assert abs(line["Data Consistency Crosscheck"].raw_risk - impact.get((case, "CONSISTENCY"), 0.0)) < 0.06
        assert (line["Simulated Watchlist Adapter"].raw_risk == 100.0) == (case in failed)
        for x in own:
            if x.weight is not None:
                assert abs(x.weighted_contribution - x.raw_risk * x.weight) < 0.11
    # policy 1 differs from the defaults in its cutoffs only
    for case, row in default.items():
        total = sum(x.weighted_contribution for x in by_case[case] if x.factor != "Critical Signal Floor")
        if row.risk_score < 46:
            assert abs(max(0.0, total) - row.risk_score) < 0.11
        level = "LOW" if row.risk_score <= 20 else "MEDIUM" if row.risk_score <= 46 else "HIGH" if row.risk_score <= 72 else "CRITICAL"
        assert row.risk_level == level


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(key, spark, sf_dir, con):
    difference = compare(QUERIES[key](spark, sf_dir), con, ORACLES[key])
    assert difference is None, difference
