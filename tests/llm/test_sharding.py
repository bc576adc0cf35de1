import zlib

import pytest

from docuvet.llm.sharding import shard_cases

ROWS = [(i, f"passport text {i % 7}") for i in range(400)] + [(7, None), (7, None), (None, ""), (8, "é"), (8, "é")]


@pytest.fixture(scope="module")
def dealt(cases):
    return shard_cases(cases(ROWS), [1.0, 1.0, 2.0], 1.0).collect()


def test_sizes_checksums_and_law(dealt):
    got = sorted((r.case_id is None, r.case_id or 0, r.size, r.text_crc32) for r in dealt)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert got == want
    assert {r.law for r in dealt} == {"key"}


def test_slots_are_gapless_in_every_shard(dealt):
    for shard in {r.shard for r in dealt}:
        assert sorted(r.slot for r in dealt if r.shard == shard) == list(range(sum(r.shard == shard for r in dealt)))


def test_key_and_weights_decide_alone(dealt, cases):
    shard_of = {}
    for r in dealt:
        assert shard_of.setdefault(r.case_id, r.shard) == r.shard
    other = shard_cases(cases([(i, "x") for i in range(400)]), [1.0, 1.0, 2.0], 1.0).collect()
    assert all(shard_of[r.case_id] == r.shard for r in other)


def test_growth_moves_rows_only_into_the_new_shard(dealt):
    moved = [r for r in dealt if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 3 for r in moved)
    assert 0.1 < len(moved) / len(dealt) < 0.3


def test_weights_set_the_shares(spark):
    many = spark.range(20_000).selectExpr("id as case_id", "'t' as raw_text")
    share = {r.shard: r["count"] / 20_000 for r in shard_cases(many, [1.0, 1.0, 2.0]).groupBy("shard").count().collect()}
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02


def test_empty_table_clashing_columns_and_bad_weights(cases):
    assert shard_cases(cases([]), [1.0] * 8).count() == 0
    extra = cases([(1, "a", 5, "x")], "case_id long, raw_text string, slot long, law string")
    assert shard_cases(extra, [1.0] * 8).count() == 1
    with pytest.raises(ValueError):
        shard_cases(extra, [1.0, 0.0])
