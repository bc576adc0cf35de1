"""The one place a check row is put together."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import FAIL


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def evidence(
    measured=None, threshold=None, unit=None, region=None, region_source=None, match=None
) -> Column:
    """Evidence struct, NULL when nothing was measured, located or matched."""
    measured = lit(measured).cast("string")
    threshold = lit(threshold).cast("string")
    region = lit(region).cast("array<int>")
    match = lit(match).cast(
        "array<struct<method:string,query_token:string,matched_token:string,edit_distance:int>>"
    )
    body = F.struct(
        measured.alias("measured_value"),
        threshold.alias("threshold_value"),
        lit(unit).cast("string").alias("unit"),
        region.alias("region"),
        lit(region_source).cast("string").alias("region_source"),
        match.alias("match"),
    )
    empty = measured.isNull() & threshold.isNull() & region.isNull() & match.isNull()
    return F.when(~empty, body)




def check(
    key, category, factor, label, status, confidence, explanation,
    severity=None, score_impact=0.0, proof: Column | None = None,
) -> Column:
    """A check struct; severity and impact survive only on a failure."""
    status = lit(status)
    failed = status == FAIL
    return F.struct(
        lit(key).cast("string").alias("check_key"),
        lit(category).cast("string").alias("category"),
        lit(factor).cast("string").alias("factor"),
        lit(label).cast("string").alias("label"),
        status.cast("string").alias("status"),
        F.when(failed, lit(severity)).cast("string").alias("severity"),
        lit(confidence).cast("double").alias("confidence"),
        lit(explanation).cast("string").alias("explanation"),
        (evidence() if proof is None else proof).alias("evidence"),
        F.when(failed, lit(score_impact).cast("double")).otherwise(F.lit(0.0)).alias("score_impact"),
    )
