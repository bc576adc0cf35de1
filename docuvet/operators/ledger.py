"""The hash-chained audit ledger: sealing, verification, anchoring.

A ledger is a table of events with ``chain_id``, an order (``event_ts``, ``seq``),
case_id, action, actor and canonical metadata text. The reference keeps one
global chain; that is simply a table with a constant ``chain_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.hashing import block_hash, payload_tail
from ..session import materialize

_ORDER = ("event_ts", "seq")


def payload_column() -> Column:
    """What of an event is hashed behind the previous hash."""
    return payload_tail(F.col("case_id"), F.col("action"), F.col("actor"), F.col("event_ts"), F.col("metadata"))


def _folder():
    """The running-hash fold, as a closure that travels with its tasks."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head = object(), None
        for batch in batches:
            chains = batch.column("chain_id").to_pylist()
            heads = batch.column("_head").to_pylist()
            tails = batch.column("_tail").to_pylist()
            previous, sealed = [], []
            for c, start, tail in zip(chains, heads, tails):
                if c != chain:
                    chain, head = c, start
                previous.append(head)
                head = hashlib.sha256(f"{head}|{tail}".encode()).hexdigest()
                sealed.append(head)
            keep = [n for n in batch.schema.names if n not in ("_head", "_tail")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep] + [pa.array(previous, pa.string()), pa.array(sealed, pa.string())],
                names=keep + ["previous_hash", "entry_hash"],
            )

    return fold


def seal_events(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Append a batch of events to their chains.

    ``heads`` (chain_id, head_hash) continues existing chains; others start from
    genesis. A block's hash needs its predecessor's, so one chain is inherently
    sequential: everything else (payload text, sorting) is done in parallel
    before, and the fold itself streams a sorted partition in constant memory
    instead of collecting a chain.
    """
    df = events.withColumn("_tail", payload_column())
    if heads is None:
        df = df.withColumn("_head", F.lit(fixed.GENESIS))
    else:
        df = df.join(heads.select("chain_id", F.col("head_hash").alias("_head")), "chain_id", "left").withColumn(
            "_head", F.coalesce("_head", F.lit(fixed.GENESIS))
        )
    ordered = df.repartition("chain_id").sortWithinPartitions("chain_id", *_ORDER)
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name not in ("_head", "_tail")
    )
    return ordered.mapInArrow(_folder(), f"{kept}, previous_hash string, entry_hash string")


def _numbering():
    """Places within this task's part of each chain, and the hash before, as a closure that travels with its tasks."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chain, rank, before = TaskContext.get().partitionId(), object(), 0, None
        for batch in batches:
            ranks, previous = [], []
            for c, own in zip(batch.column("chain_id").to_pylist(), batch.column("_own").to_pylist()):
                if c != chain:
                    chain, rank, before = c, 0, None
                rank += 1
                ranks.append(rank)
                previous.append(before)
                before = own
            kept = [n for n in batch.schema.names if n != "_own"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()), pa.array(previous, pa.string())],
                [*kept, "_part", "_rank", "_prev"])

    return number


def positions(ledger: DataFrame) -> DataFrame:
    """Each block's 1-based place in its chain and its predecessor's hash.

    The ledger is dealt by ranges of (chain, time, seq), so a huge chain, even one whose
    blocks all fall into one hour, is spread over the cluster, and numbered as it streams
    by, in constant memory. What a part needs from those before it, the number of blocks
    and the hash it starts from, comes from a summary of one row per part and chain, of
    which at most one a part, that of a chain begun earlier, goes to all tasks. The
    numbered parts are written once: ranges are drawn from a sample, and a recomputed
    task must not see others. Columns of these two names are replaced.
    """
    ledger = ledger.drop("position", "expected_previous")
    own = F.coalesce("entry_hash", F.lit(fixed.GENESIS))
    df = ledger.withColumn("_own", own)
    order = ("chain_id", *_ORDER)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ledger.schema)
    rows = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbering(), f"{shape}, _part int, _rank long, _prev string"),
        "ledger-parts")
    across = Window.partitionBy("chain_id").orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("chain_id", "_part").agg(F.max("_rank").alias("_n"), F.max_by(own, "_rank").alias("_last"))
        .select("chain_id", "_part", F.sum("_n").over(before).alias("_before"), F.lag("_last").over(across).alias("_start"))
    )
    # only the first chain of a part can go on from an earlier one: at most a row per part
    begun = F.broadcast(parts.where("_before > 0").select(F.col("chain_id").alias("_chain"), F.col("_part").alias("_at"), "_before", "_start"))
    return rows.join(begun, F.col("chain_id").eqNullSafe(F.col("_chain")) & (F.col("_part") == F.col("_at")), "left").select(
        *ledger.columns,
        (F.coalesce("_before", F.lit(0)) + F.col("_rank")).cast("long").alias("position"),
        F.coalesce("_prev", "_start", F.lit(fixed.GENESIS)).alias("expected_previous"),
    )


def block_status(ledger: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every block with its verdict; linkage is judged before the signature.

    Both hashes are stored, so recomputing them is a column expression. It is done before
    the blocks are placed: with ``keep`` only the columns of the order, those listed and
    entry_hash travel, not the payload.
    """
    stored = F.coalesce(F.nullif("previous_hash", F.lit("")), F.lit(fixed.GENESIS))
    recomputed = block_hash(F.col("previous_hash"), payload_column())
    kept = ledger.columns if keep is None else list(dict.fromkeys(["chain_id", *_ORDER, *keep, "entry_hash"]))
    judged = ledger.select(
        *[c for c in kept if c not in ("position", "expected_previous", "break_reason")], stored.alias("_stored"),
        (F.col("entry_hash").isNull() | (F.col("entry_hash") != recomputed)).alias("_unsigned"))
    verdict = F.when(F.col("_stored") != F.col("expected_previous"), "LINKAGE").when(F.col("_unsigned"), "SIGNATURE")
    return positions(judged).withColumn("break_reason", verdict).drop("_stored", "_unsigned")


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Per chain: validity, size, head and the first broken block."""
    blocks = block_status(ledger, [])
    first = F.min_by(
        F.struct("seq", "position", "break_reason"),
        F.when(F.col("break_reason").isNotNull(), F.col("position")),
    )
    return (
        blocks.groupBy("chain_id")
        .agg(
            F.count("*").alias("total_records"),
            F.max_by("entry_hash", "position").alias("head_hash"),
            first.alias("f"),
        )
        .select(
            "chain_id", F.col("f").isNull().alias("valid"), "total_records", "head_hash",
            F.col("f.seq").alias("compromised_seq"),
            F.col("f.position").alias("compromised_position"),
            F.col("f.break_reason").alias("break_reason"),
        )
    )


def verify_cases(ledger: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """The whole-chain verdict with size, head and last position scoped to each case.

    ``cases`` (chain_id, case_id) adds cases that never logged anything: valid, 0.
    """
    blocks = block_status(ledger, ["case_id"])
    per_case = blocks.groupBy("chain_id", "case_id").agg(
        F.count("*").alias("total_records"),
        F.max_by("entry_hash", "position").alias("head_hash"),
        F.max("position").alias("last_position"),
        F.count("break_reason").alias("_broken"),
    )
    # The chain is broken if any case's share of it is.
    chains = per_case.groupBy("chain_id").agg((F.sum("_broken") == 0).alias("valid"))
    found = per_case.drop("_broken").join(chains, "chain_id")
    if cases is not None:
        found = cases.select("chain_id", "case_id").distinct().join(found, ["chain_id", "case_id"], "left")
    return found.select(
        "chain_id", "case_id",
        F.coalesce("valid", F.lit(True)).alias("valid"),
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        F.coalesce("head_hash", F.lit(fixed.GENESIS)).alias("head_hash"),
        "last_position",
    )


def anchor_proof(verified: DataFrame, anchors: DataFrame, block: int = 1_000_000) -> DataFrame:
    """For each case the earliest-created anchor that covers its last block.

    Taken in creation order, an anchor newly covers only the positions beyond all
    earlier anchors, so anchors become disjoint intervals and each position falls
    in exactly one. Intervals meet positions through position blocks: an equi-join
    with no hot key, where a range condition would compare everything.
    """
    order = Window.partitionBy("chain_id").orderBy("created_epoch", "anchor_id")
    reached = F.coalesce(
        F.max("total_records").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    block_of = lambda v: F.floor(v / F.lit(block)).cast("long")
    spans = (
        anchors.withColumn("_from", reached + 1)
        .where(F.col("total_records") >= F.col("_from"))
        .withColumn("_block", F.explode(F.sequence(block_of(F.col("_from")), block_of(F.col("total_records")))))
        .select(
            "chain_id", "_block", "_from", F.col("total_records").alias("_to"),
            "anchor_id", "tx_hash", "network",
        )
    ).alias("a")
    asked = verified.withColumn("_block", block_of(F.col("last_position"))).alias("v")
    covers = (
        (F.col("v.chain_id") == F.col("a.chain_id"))
        & (F.col("v._block") == F.col("a._block"))
        & F.col("v.last_position").between(F.col("a._from"), F.col("a._to"))
    )
    status = (
        F.when(F.col("v.total_records") == 0, "NO_AUDIT_TRAIL")
        .when(~F.col("v.valid"), "CHAIN_INVALID")
        .when(F.col("a.anchor_id").isNotNull(), "ANCHORED")
        .otherwise("NOT_ANCHORED")
    )
    shown = status == "ANCHORED"
    return asked.join(spans, covers, "left").select(
        F.col("v.chain_id"), F.col("v.case_id"), F.col("v.valid").alias("chain_valid"),
        status.alias("proof_status"),
        F.when(shown, F.col("a.anchor_id")).alias("anchor_id"),
        F.when(shown, F.col("a.tx_hash")).alias("tx_hash"),
    )


def proof_for_numbers(asked: DataFrame, cases: DataFrame, proofs: DataFrame) -> DataFrame:
    """Proof by human case number; unknown numbers are reported, not dropped."""
    known = cases.select("case_number", "case_id")
    return (
        asked.select("case_number").distinct().join(known, "case_number", "left")
        .join(proofs, "case_id", "left")
        .withColumn(
            "proof_status",
            F.when(F.col("case_id").isNull(), "CASE_NOT_FOUND").otherwise(
                F.coalesce("proof_status", F.lit("NO_AUDIT_TRAIL"))
            ),
        )
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Size, head, genesis and last timestamp of every chain."""
    return ledger.groupBy("chain_id").agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.max_by("entry_hash", F.struct(*_ORDER)), F.lit(fixed.GENESIS)).alias("head_hash"),
        F.lit(fixed.GENESIS).alias("genesis_hash"),
        F.max("event_ts").alias("last_timestamp"),
    )


def anchor_snapshot(ledger: DataFrame, at: Column) -> DataFrame:
    """The rows to append to the anchor table; empty chains give none."""
    return ledger_stats(ledger).where("total_records > 0").select(
        "chain_id", "head_hash", "total_records", at.alias("anchored_at")
    )


def recent_anchors(anchors: DataFrame, n: int = 20) -> DataFrame:
    return anchors.orderBy(F.desc("created_epoch"), F.desc("anchor_id")).limit(n)
