"""Streams whose state is kept by key: steps leave at once, chains continue, replays change nothing."""

import hashlib

import pytest
from pyspark.sql import Row, functions as F

from compare import compare, connect
from docuvet.functions import fixed
from docuvet.operators import ledger
from docuvet.plans import registry
from docuvet.session import scratch_dir
from docuvet.streaming import keyed, latency

EVENTS = "seq long, event_ts timestamp, case_id long, chain_id long, action string, actor string, metadata string"


@pytest.mark.parametrize("key", ["s2_stream_completed_steps", "s3_stream_sealed_chains", "h4_verify_chain", "h4_verify_one_global_chain"])
def test_queries_match_their_twins(key, spark, sf_dir):
    difference = compare(registry.queries()[key](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[key])
    assert difference is None, difference


def events(spark, rows):
    made = [(seq, 1_700_000_000 + minute * 60, case, case % 2, action, "AI-ENGINE", "{}") for seq, minute, case, action in rows]
    return spark.createDataFrame(made, EVENTS.replace("event_ts timestamp", "event_ts long")).withColumn(
        "event_ts", F.timestamp_seconds("event_ts"))


def run(spark, made, root, path):
    """All files that arrived since the last run, one micro-batch each."""
    with keyed.keyed_state(spark):
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        stream = made(source)
        stream.writeStream.format("parquet").option("path", f"{root}/{path}").option(
            "checkpointLocation", f"{root}/cp-{path}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/{path}")


def test_a_step_leaves_with_its_second_end_and_repeats_correct_nothing(spark):
    root = scratch_dir(spark, "steps")
    put = lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    told = lambda: sorted((r.case_id, r.module, r.micros // 60_000_000) for r in run(spark, keyed.stream_completed_steps, root, "steps").collect())
    (first, second, label), *others = [s[:3] for s in fixed.LATENCY_STEPS]
    put([(1, 0, 7, first), (2, 0, 8, first), (3, 4, 8, second)])
    assert told() == []
    put([(4, 3, 7, second), (5, 9, 7, "FACE_VERIFIED")])
    assert (7, label, 3) in told() and {r[0] for r in told()} == {7}  # at once: no later event was needed
    before = told()
    put([(6, 30, 7, second), (7, 31, 7, "FACE_VERIFIED"), (4, 3, 7, second)])
    assert told() == before
    put([(8, 12, 8, "FACE_VERIFIED")])
    assert (8, label, 4) in told()
    put([(9, 60 * 24 * 9, 1, "OTHER"), (10, 60 * 24 * 9, 1, first)])
    put([(11, 60 * 24 * 9, 1, second)])
    assert [r for r in told() if r[0] == 1] == [] and len(told()) == len(set(told()))


def test_steps_of_many_batches_equal_the_bounded_table(spark, sf_dir):
    root = scratch_dir(spark, "steps-many")
    rows = [(6 * c + i, 100 * c + 7 * i + (c * i) % 3, c, a) for c in range(40) for i, a in enumerate(
        dict.fromkeys(x for s in fixed.LATENCY_STEPS for x in s[:2])) if (c + i) % 9]
    whole = events(spark, rows)
    for part in range(4):
        whole.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    got = run(spark, lambda df: keyed.stream_completed_steps(df, late="30 days"), root, "steps")
    key = lambda df: sorted((r.case_id, r.module, r.completed_at, r.micros) for r in df.collect())
    assert key(got) == key(latency.case_steps(whole)) and got.count() > 20


def test_chains_continue_over_batches_and_verify(spark):
    root = scratch_dir(spark, "sealed")
    for n in range(3):
        events(spark, [(100 * n + i, 100 * n + i, i % 5, "OCR_COMPLETED") for i in range(30)]).coalesce(1).write.mode("append").parquet(f"{root}/in")
        sealed = run(spark, keyed.stream_sealed_events, root, "sealed")
    assert sealed.count() == 90
    by_hand = {(r.seq, r.entry_hash) for r in ledger.seal_events(spark.read.schema(EVENTS).parquet(f"{root}/in")).collect()}
    assert {(r.seq, r.entry_hash) for r in sealed.collect()} == by_hand
    assert all(r.valid for r in ledger.verify_chain(sealed).collect())
    places = ledger.positions(sealed.withColumnRenamed("position", "streamed"))
    assert places.where("position <> streamed").count() == 0


def test_one_chain_within_one_hour_is_numbered_over_many_parts(spark):
    rows = events(spark, [(i, 0, 2 * i, "OCR_COMPLETED") for i in range(4_000)])
    sealed = ledger.seal_events(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ledger.positions(sealed.repartition(5))
        tasks = placed.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        found = {r.seq: (r.position, r.expected_previous) for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    head = fixed.GENESIS
    for r in sorted(sealed.collect(), key=lambda r: r.seq):
        assert found[r.seq] == (r.seq + 1, head)
        head = r.entry_hash
    assert len(tasks) >= 1 and ledger.verify_chain(sealed).first().valid


def test_an_empty_ledger_has_no_positions(spark):
    empty = ledger.seal_events(events(spark, [(1, 1, 1, "X")]).where("false"))
    assert ledger.verify_chain(empty).count() == 0


@pytest.mark.parametrize("files", [0, 3])
def test_a_streamed_table_may_be_a_file_or_a_folder(spark, sf_dir, tmp_path, files):
    from docuvet.plans.catalogue_training import _arrivals

    if files:
        spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path) if files else sf_dir
    arrived = _arrivals(spark, folder, "embeddings").select("vec_id", "label")
    query = (
        arrived.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    told = sorted(map(tuple, spark.read.schema(arrived.schema).parquet(f"{tmp_path}/out").collect()))
    assert told and told == sorted(map(tuple, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label").collect()))


def test_cases_with_neighbouring_numbers_share_a_state_and_stay_apart(spark):
    root = scratch_dir(spark, "steps-neighbours")
    (first, second, label), *_ = [s[:3] for s in fixed.LATENCY_STEPS]
    cases = [-257, -1, 0, 255, 256, 511, 700]
    put = lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    put([(i, i, c, first) for i, c in enumerate(cases)])
    put([(100 + i, 10 + 3 * i, c, a) for i, c in enumerate(cases) for a in (second, "FACE_VERIFIED")])
    put([(200 + i, 90 + i, c, second) for i, c in enumerate(cases)])
    got = run(spark, keyed.stream_completed_steps, root, "steps").where(F.col("module") == label)
    assert sorted((r.case_id, r.micros // 60_000_000) for r in got.collect()) == sorted((c, 10 + 2 * i) for i, c in enumerate(cases))


def test_many_cases_share_few_states(spark):
    root = scratch_dir(spark, "steps-states")
    first = fixed.LATENCY_STEPS[0][0]
    events(spark, [(c, 0, c, first) for c in range(600)]).coalesce(1).write.parquet(f"{root}/in")
    with keyed.keyed_state(spark):
        query = keyed.stream_completed_steps(spark.readStream.schema(EVENTS).parquet(f"{root}/in")).writeStream.format("parquet").option(
            "path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 3


def test_cases_may_have_names_and_go_after_their_time(spark):
    root = scratch_dir(spark, "steps-names")
    (first, second, label), *_ = [s[:3] for s in fixed.LATENCY_STEPS]
    named = EVENTS.replace("case_id long", "case_id string")

    def put(rows):
        made = events(spark, [(seq, minute, case, action) for seq, minute, case, action in rows])
        made.withColumn("case_id", F.concat(F.lit("C"), "case_id")).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def told():
        with keyed.keyed_state(spark):
            stream = keyed.stream_completed_steps(spark.readStream.schema(named).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), keep_seconds=3600)
            stream.writeStream.format("parquet").option("path", f"{root}/out").option(
                "checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.case_id, r.module, r.micros // 60_000_000) for r in spark.read.schema(stream.schema).parquet(f"{root}/out").collect())

    put([(1, 0, 7, first), (2, 0, 8, first)])
    put([(3, 5, 7, second), (4, 6, 7, "FACE_VERIFIED")])
    assert told() == [("C7", label, 5)]
    put([(5, 60 * 24, 9, first)])
    assert told() == [("C7", label, 5)]
    # case 8 went with the watermark, so its second end and its check find no first end
    put([(6, 60 * 24 + 1, 8, second), (7, 60 * 24 + 2, 8, "FACE_VERIFIED")])
    assert told() == [("C7", label, 5)]
