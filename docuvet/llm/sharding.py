"""Rendezvous hashing of case keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .support import shuffle_partitions

#: Copies of one row that are numbered together.
RUN = 65_536


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose score ``-weight / ln(u)`` is largest; ``u`` is a hash of key and shard in (0, 1).

    A new shard only ever wins keys for itself, and a changed weight only moves keys
    to or from that shard. Shards of weight ``w`` get a share of ``w / sum(weights)``.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double")
        unit = (bits + 0.5) * F.lit(2.0**-52)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*scores))["shard"]


def shard_cases(cases: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """Deal document analyses into weighted shards by their case key.

    ``cases``: case_id, raw_text; other columns are ignored. Output, one row per input
    row: case_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32,
    law (``key``), shard, slot (gapless from 0 inside a shard, by hash of the row), and
    grown_shard: the shard once one more of ``grown_weight`` exists. Only case_id and
    the weights decide; repeated keys therefore share a shard, and a null key is a key.
    Repeated rows get slots of their own. An empty table gives an empty result.

    Equal rows are counted before anything is shuffled, and slots are numbered inside
    hash blocks, so neither a hot key nor a large shard meets in one task.
    """
    blocks = shuffle_partitions(cases)
    text = F.coalesce(F.col("raw_text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("case_id").cast("string"), F.lit("\u0000null"))
    rows = (
        cases.select("case_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("case_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({
            "shard": rendezvous(key, weights).cast("int"),
            "grown_shard": rendezvous(key, [*weights, grown_weight]).cast("int"),
            "block": F.pmod(F.xxhash64("case_id", "size", "text_crc32"), F.lit(blocks)),
        })
    )
    filled = rows.groupBy("shard", "block").agg(F.sum("copies").alias("in_block"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("case_id", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    numbered = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    runs = (
        numbered.join(offsets, ["shard", "block"])
        .withColumn("run", F.explode(F.expr(f"sequence(0L, copies - 1, {RUN}L)")))
        .repartition(blocks, "case_id", "run")
    )
    copy = F.explode(F.expr(f"sequence(run, least(run + {RUN}L, copies) - 1)"))
    return runs.withColumn("copy", copy).select(
        "case_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("ahead") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )
