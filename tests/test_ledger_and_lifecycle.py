"""Chain integrity, idempotent writes, streaming replays and the whole screening plan."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docuvet.functions.hashing import canonical_json, canonical_json_of, canonical_json_text
from docuvet.operators import ledger, lifecycle, trainset
from docuvet.plans import fixtures, screening
from docuvet.session import scratch_dir
from docuvet.sources import manifests, store
from docuvet.streaming import captures as capture_stream, latency, watchlist as watch_stream

EVENT = "seq long, chain_id long, case_id long, action string, actor string, event_ts timestamp, metadata string"
START = datetime.datetime(2024, 1, 1)


def events(spark, n=60, chains=2, step=1500):
    rows = [(i, i % chains, i // 3 if i % 7 else None, "ACT", "AI", START + datetime.timedelta(seconds=step * i, microseconds=i % 2), "{}") for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def test_sealing_equals_a_plain_fold(spark):
    sealed = ledger.seal_events(events(spark)).orderBy("seq").collect()
    heads = {}
    for r in sealed:
        before = heads.get(r.chain_id, "0" * 64)
        text = f"{before}|{r.case_id if r.case_id is not None else 'SYSTEM'}|{r.action}|{r.actor}|{r.event_ts.isoformat()}|{r.metadata}"
        assert r.previous_hash == before
        heads[r.chain_id] = hashlib.sha256(text.encode()).hexdigest()
        assert r.entry_hash == heads[r.chain_id]


def test_a_later_batch_continues_the_chain(spark):
    every = events(spark)
    first = ledger.seal_events(every.where("seq < 30"))
    heads = ledger.ledger_stats(first).select("chain_id", "head_hash")
    both = first.unionByName(ledger.seal_events(every.where("seq >= 30"), heads))
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, ledger.seal_events(every).collect()), key=str)
    assert all(r.valid and r.total_records == 30 for r in ledger.verify_chain(both).collect())


@pytest.mark.parametrize("k", [0, 1, 17, 58])
@pytest.mark.parametrize("kind", ["edit", "resign", "drop_hash"])
def test_first_break_is_found(spark, k, kind):
    rows = [r.asDict() for r in ledger.seal_events(events(spark, chains=1)).collect()]
    rows.sort(key=lambda r: r["seq"])
    bad = rows[k]
    if kind == "drop_hash":
        bad["entry_hash"] = None
    else:
        bad["actor"] = "INTRUDER"
        if kind == "resign":
            case = bad["case_id"] if bad["case_id"] is not None else "SYSTEM"
            text = f"{bad['previous_hash']}|{case}|{bad['action']}|INTRUDER|{bad['event_ts'].isoformat()}|{{}}"
            bad["entry_hash"] = hashlib.sha256(text.encode()).hexdigest()
    schema = EVENT + ", previous_hash string, entry_hash string"
    got = ledger.verify_chain(spark.createDataFrame(rows, schema)).first()
    assert not got.valid and got.total_records == 60
    if kind == "resign":
        assert (got.compromised_position, got.break_reason) == (k + 2, "LINKAGE")
    else:
        assert (got.compromised_position, got.break_reason) == (k + 1, "SIGNATURE")


def test_anchor_is_the_earliest_covering_one(spark):
    verified = spark.createDataFrame(
        [(0, 1, True, 3, "h", 5), (0, 2, True, 1, "h", 40), (0, 3, True, 0, "h", None), (1, 4, False, 2, "h", 2)],
        "chain_id long, case_id long, valid boolean, total_records long, head_hash string, last_position long",
    )
    anchors = spark.createDataFrame(
        [(1, 0, 3, 10, "t1", "n"), (2, 0, 30, 20, "t2", "n"), (3, 0, 8, 30, "t3", "n"), (4, 1, 99, 5, "t4", "n")],
        "anchor_id long, chain_id long, total_records long, created_epoch long, tx_hash string, network string",
    )
    got = {r.case_id: (r.proof_status, r.anchor_id) for r in ledger.anchor_proof(verified, anchors, block=7).collect()}
    assert got == {1: ("ANCHORED", 2), 2: ("NOT_ANCHORED", None), 3: ("NO_AUDIT_TRAIL", None), 4: ("CHAIN_INVALID", None)}


def test_canonical_json_equals_json_dumps(spark):
    values = [{"b": "x", "a": "é😀", "c": 'q"\\/\n'}, {}, None]
    df = spark.createDataFrame([(v,) for v in values], "m map<string,string>")
    got = [r.j for r in df.select(canonical_json(F.col("m")).alias("j")).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":")) if v else "{}" for v in values]


def test_nested_canonical_json_equals_json_dumps(spark):
    values = [{"b": {"z": [1, {"y": None, "x": "é😀"}], "a": 1.5e300}, "a": [[], {}]}, {"k": 1e-7, "j": -0.0, "i": 10**25, "h": True}, [], {}, None]
    dumped = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":")) if v else "{}"
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=False) if v is not None else None,) for v in values] + [("",), ("{oops",)], "t string")
    got = [r.j for r in df.select(canonical_json_text(F.col("t")).alias("j")).collect()]
    assert got == [dumped(v) for v in values] + ["{}", None]
    typed = spark.createDataFrame([(({"b": 2, "a": 1}, [("x", None)], datetime.datetime(2026, 1, 2, 3, 4, 5)),), (None,)],
                                  "v struct<m: map<string,int>, list: array<struct<q: string, p: string>>, at: timestamp>")
    assert [r.j for r in typed.select(canonical_json_of(F.col("v")).alias("j")).collect()] == [
        '{"at":"2026-01-02 03:04:05","list":[{"p":null,"q":"x"}],"m":{"a":1,"b":2}}', "{}"]


def test_store_writes_are_idempotent(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "case_id int, v string")
    rows = lambda df: sorted(map(tuple, df.select("case_id", "v").collect()))
    once = store.insert_if_absent(held, new, "case_id")
    assert rows(once) == rows(store.insert_if_absent(once, new, "case_id")) == [(1, "a"), (2, "b"), (3, "e")]
    swapped = store.replace_per_case(held, new)
    assert rows(swapped) == rows(store.replace_per_case(swapped, new)) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    path = scratch_dir(spark, "store")
    for _ in range(2):
        store.write_by_case(held, path, buckets=4)
        store.write_by_case(new, path, buckets=4)
    back = spark.read.parquet(path)
    assert (3, "e") in rows(back) and (2, "d") in rows(back) and (2, "b") not in rows(back)


def test_typed_load(spark):
    root = scratch_dir(spark, "typed")
    evidence = '{"measured_value":"4","threshold_value":"5","unit":"check_digit","region":[1,2,3,4]}'
    spark.createDataFrame(
        [(1, "K", "MRZ", "MRZ_VALIDATION", "l", "FAIL", "HIGH", 0.9, "e", evidence, 18.0)], store.TABLES["risk_checks"]
    ).write.parquet(f"{root}/risk_checks")
    row = store.load_table(spark, root, "risk_checks").first()
    assert row.evidence.unit == "check_digit" and row.evidence.region == [1, 2, 3, 4] and row.evidence.match is None


def test_deleting_a_case_breaks_the_link_behind_it(spark):
    sealed = ledger.seal_events(events(spark, n=24, chains=1).withColumn("case_id", F.floor(F.col("seq") / 3)))
    doomed = spark.createDataFrame([(2,), (3,), (7,)], "case_id long")
    broken = lifecycle.deletion_impact(sealed, doomed).collect()
    # cases 2 and 3 were neighbours, case 7 was the last: one link breaks, at the first block of case 4
    assert [tuple(r) for r in broken] == [(0, 12, 4, 7, "LINKAGE")]


def test_purge_twice_changes_nothing_more(spark, sf_dir):
    cases, analyses = fixtures.load(spark, sf_dir, "fx_cases"), fixtures.load(spark, sf_dir, "fx_analyses")
    faces = fixtures.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding")
    listed = cases.where("risk_level = 'HIGH'").select("case_id")
    at = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    one = lifecycle.purge_biometrics(listed, cases, analyses, faces, at, "O")
    two = lifecycle.purge_biometrics(listed, one["cases"], one["analyses"], one["gallery"], at, "O")
    rows = lambda df: sorted(map(str, df.collect()))
    for name in ("cases", "analyses", "gallery"):
        assert rows(one[name]) == rows(two[name])
    assert one["cases"].agg(F.sum("risk_score")).first() == cases.agg(F.sum("risk_score")).first()


def test_new_numbers_never_collide(spark):
    old = spark.createDataFrame([("CS-2026-00007",), ("CS-2026-99998",), ("OTHER-1",)], "case_number string")
    new = spark.range(500).withColumnRenamed("id", "case_id")
    got = lifecycle.assign_case_numbers(new, old)
    assert lifecycle.duplicate_case_numbers(got.select("case_number").unionByName(old)).count() == 0
    assert got.agg(F.min("case_number")).first()[0] == "CS-2026-100000" and got.count() == 500


def test_numbers_go_on_beyond_their_width(spark, tmp_path):
    from docuvet.plans import registry

    spark.createDataFrame([(99_998,), (123_456,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = registry.queries()["p6_assign_case_numbers"](spark, str(tmp_path)).collect()
    assert {r.case_number for r in rows} == {"CS-2026-123457", "CS-2026-123458"}


def test_split_is_stable_and_exact(spark):
    rows = spark.range(1000)
    split = lambda df: {r.id for r in trainset.train_val_split(df).where("split = 'val'").collect()}
    assert split(rows) == split(rows.repartition(17)) and len(split(rows)) == 200


def test_balanced_sample_follows_the_shares(spark):
    rows = spark.range(3000).withColumn("domain", F.when(F.col("id") < 2700, "big").otherwise("small"))
    got = trainset.domain_balanced_sample(rows, {"big": 0.5, "small": 0.5}, 4000).groupBy("domain").count().collect()
    assert sum(r["count"] for r in got) == 4000 and all(abs(r["count"] - 2000) < 150 for r in got)


def test_image_files_become_manifests(spark, tmp_path):
    folder = tmp_path / "Train-Balanced" / "ann_1"
    folder.mkdir(parents=True)
    (folder / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"0" * 20)
    (folder / "b.jpg").write_bytes(b"<svg>")
    files = manifests.image_paths(spark, str(tmp_path), content=True)
    got = {r.filename: (r.accepted, r.reason) for r in manifests.upload_manifest(
        files.select(manifests.file_name(F.col("path")).alias("filename"), "file_size", "content")).collect()}
    assert got == {"a.png": (True, None), "b.jpg": (False, "NOT_AN_IMAGE")}


def test_an_entry_added_between_batches_hits_later_arrivals_only(spark, monkeypatch):
    out = scratch_dir(spark, "versions")
    shape = "entry_order int, watchlist_id string, name string, document_number string, severity string, category string, active boolean"
    versions = watch_stream.watchlist_versions(f"{out}/list", shape)
    publish = lambda n, rows: spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{out}/list/version={n}")
    old = (1, "W1", "JOHN SMITH", "A1234567", "HIGH", "c", True)
    arrive = lambda n, rows: spark.createDataFrame(rows, "case_id long, full_name string, document_number string").coalesce(1).write.mode(
        "append").parquet(f"{out}/in")
    prepared = []
    real = watch_stream.prepare_watchlist
    monkeypatch.setattr(watch_stream, "prepare_watchlist", lambda e: prepared.append(1) or real(e))

    def run(checkpoint="cp"):
        source = spark.readStream.schema("case_id long, full_name string, document_number string").option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        watch_stream.stream_watchlist(source, versions, f"{out}/hits", f"{out}/{checkpoint}").awaitTermination()
        return sorted((r.case_id, r.watchlist_id) for r in spark.read.parquet(f"{out}/hits").collect())

    publish(1, [old])
    arrive(1, [(1, "John Smith", ""), (2, "Eve Adams", "")])
    arrive(2, [(3, "Jon Smith", "")])
    assert run() == [(1, "W1"), (3, "W1")] and len(prepared) == 1  # two micro-batches, one preparation
    publish(2, [old, (2, "W2", "EVE ADAMS", "B7654321", "HIGH", "c", True)])
    arrive(3, [(4, "Eve Adams", ""), (5, "x", "B7654322")])
    assert run() == [(1, "W1"), (3, "W1"), (4, "W2"), (5, "W2")]
    assert run("another checkpoint") == [(1, "W1"), (3, "W1"), (4, "W2"), (5, "W2")]  # all replayed, each against its version


def test_replayed_batches_do_not_repeat_hits(spark, sf_dir):
    out = scratch_dir(spark, "replay")
    subjects = fixtures.load(spark, sf_dir, "fx_subjects")
    subjects.repartition(3).write.parquet(f"{out}/in")
    arrivals = lambda: spark.readStream.schema(subjects.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    entries = fixtures.load(spark, sf_dir, "fx_watchlist")
    for attempt in ("a", "b"):
        # The second run has lost its checkpoint and sees every file again.
        watch_stream.stream_watchlist(arrivals(), entries, f"{out}/hits", f"{out}/cp-{attempt}").awaitTermination()
    hits = spark.read.parquet(f"{out}/hits")
    from docuvet.operators.matching import watchlist_screen

    assert hits.count() == hits.select("case_id").distinct().count() == watchlist_screen(subjects, entries).count()


@pytest.mark.parametrize("every", [16, 2])
def test_streamed_ledger_over_several_batches(spark, sf_dir, monkeypatch, every):
    monkeypatch.setattr(capture_stream, "SNAPSHOT_EVERY", every)
    out = scratch_dir(spark, "captures")
    rows = fixtures.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"), F.timestamp_seconds(F.col("vec_id") * 60).alias("event_ts"), F.col("vec_id").alias("case_id"),
        (F.col("vec_id") % 2).alias("chain_id"), "embedding", F.lit("{}").alias("metadata"))
    for i in range(3):
        rows.where(F.floor(F.col("seq") / 100) % 3 == i).coalesce(1).write.parquet(f"{out}/in/part={i}")
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{out}/in")
    capture_stream.stream_captures(arrivals, f"{out}/state", f"{out}/cp", threshold=0.7).awaitTermination()
    sealed = spark.read.parquet(f"{out}/state/ledger")
    assert sealed.select("batch_id").distinct().count() == 3 and sealed.count() == rows.count()
    links = sealed.select(F.col("entry_hash").alias("h")).join(sealed.select("previous_hash"), F.col("h") == F.col("previous_hash"))
    # Two chains: every block but the two heads has exactly one successor.
    assert links.count() == rows.count() - 2
    assert spark.read.parquet(f"{out}/state/gallery").count() == rows.count()


def test_streamed_latency_equals_its_batch_twin(spark, sf_dir):
    out = scratch_dir(spark, "latency")
    audit = fixtures.load(spark, sf_dir, "fx_audit").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    audit.unionByName(audit.where("seq % 2 = 0")).repartitionByRange(4, "event_ts").write.parquet(f"{out}/in")
    source = spark.readStream.schema(audit.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    latency.closing_event(audit, late="30 days").coalesce(1).write.mode("append").parquet(f"{out}/in")
    steps = latency.stream_case_steps(source, late="30 days")
    query = (steps.writeStream.format("parquet").option("path", f"{out}/o").option("checkpointLocation", f"{out}/cp")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    days = lambda df: {(r.window_start, r.module): (r.sample_count, r.time_ms) for r in latency.latency_by_window(df).collect()}
    got, want = days(spark.read.schema(steps.schema).parquet(f"{out}/o")), days(latency.case_steps(audit))
    assert got == want and len(got) > 30
    # per-step totals agree with the dashboard's, which knows no windows
    from docuvet.operators.analytics import step_latency

    totals = {r.module: r.sample_count for r in step_latency(audit).collect()}
    for module, n in totals.items():
        assert sum(c for (_, m), (c, _) in got.items() if m == module) == n


def test_whole_screening(spark, sf_dir):
    load = lambda n: fixtures.load(spark, sf_dir, n)
    docs = load("fx_ocr_text").select(
        "doc_id", "raw_text", F.lit(None).cast("array<string>").alias("band"), F.lit("India").alias("declared_country"))
    mine = load("fx_faces").join(docs.select(F.col("doc_id").alias("case_id")), "case_id")
    measures = load("fx_measures").join(docs.select(F.col("doc_id").alias("case_id")), "case_id")
    got = screening.screen(docs, load("fx_watchlist"), "2026-01-01", measures, captures=mine)
    cases, n = got.cases.collect(), docs.count()
    assert len(cases) == n and all(0 <= c.risk_score <= 100 for c in cases)
    total = {r.case_id: r.s for r in got.breakdown.groupBy("case_id").agg(F.sum("weighted_contribution").alias("s")).collect()}
    assert all(abs(min(100, total[c.case_id]) - c.risk_score) < 0.05 for c in cases)
    keys = got.checks.groupBy("case_id", "check_key").count().where("count > 1").where("check_key not like 'TAMPER%'")
    assert keys.count() == 0


def test_deletion_keeps_rows_without_a_case_and_deals_narrow_rows_to_all_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = spark.range(5000).select((F.col("id") % 500).alias("case_id"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "case_id long, id long"))
    doomed = spark.createDataFrame([(7,), (7,), (9,), (None,)], "case_id long")
    kept = lifecycle.delete_cases(doomed, {"rows": table})["rows"]
    assert kept.columns == ["case_id", "id"]
    assert {r.id for r in kept.collect()} == {-1} | {i for i in range(5000) if i % 500 not in (7, 9)}
    assert kept.count() == 5001 - 20
    # re-planning would put so few bytes into one task
    assert kept.rdd.getNumPartitions() == parts > 1


def test_verification_moves_neither_payload_nor_placed_blocks(spark):
    """A chain over several parts and small ones beside it; only the order, the hashes and the verdict of a block are dealt."""
    made = events(spark, n=400, chains=3).withColumn("chain_id", F.when(F.col("seq") < 300, 0).otherwise(F.col("seq") % 7).cast("long"))
    sealed = ledger.seal_events(made)
    placed = ledger.positions(sealed).collect()
    want = {}
    for r in sorted(placed, key=lambda r: (r.chain_id, r.event_ts, r.seq)):
        place, head = want.get(r.chain_id, (0, "0" * 64))
        assert (r.position, r.expected_previous, r.previous_hash) == (place + 1, head, head)
        want[r.chain_id] = (place + 1, r.entry_hash)
    judged = ledger.block_status(sealed, ["case_id"])
    assert judged.columns == ["chain_id", "event_ts", "seq", "case_id", "entry_hash", "position", "expected_previous", "break_reason"]
    assert judged.where("break_reason is not null").count() == 0 and judged.count() == 400
