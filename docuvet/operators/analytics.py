"""Dashboards, queues, lists and compliance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.numbers import ladder, round_exact


def _like(column: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.lower()))


def severity_rank(column: str = "severity", missing: int = 4) -> Column:
    return ladder(F.col(column), fixed.SEVERITY_RANK, missing)


# --- dashboard ------------------------------------------------------------------


def dashboard_kpis(cases: DataFrame, threshold_low: float = fixed.DEFAULT_POLICY["threshold_low"]) -> DataFrame:
    """All headline counts in one pass."""
    pending = (F.col("officer_decision") == "PENDING") & (F.col("risk_score") >= threshold_low)
    return cases.agg(
        F.count("*").alias("documents_screened"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_cases"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_cases"),
        F.count_if(F.col("officer_decision") == "CLEARED").alias("cleared_cases"),
        F.count_if(pending).alias("cases_requiring_review"),
    )


def risk_distribution(cases: DataFrame) -> DataFrame:
    """A count for each of the four tiers, zero where no case has it."""
    counted = cases.agg(*[F.count_if(F.col("risk_level") == t).alias(t) for t in fixed.TIERS])
    rows = F.array(*[F.struct(F.lit(t).alias("risk_level"), F.col(t).alias("n")) for t in fixed.TIERS])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def document_type_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce("document_type", F.lit("Passport")).alias("document_type")).agg(
        F.count("*").alias("n")
    )


def avg_processing_ms(analyses: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg(F.col("processing_time_ms").cast("decimal(18,6)")).cast("double"), F.lit(0.0))
    return analyses.agg(round_exact(mean, 1).alias("avg_processing_time_ms"))


def step_latency(audit: DataFrame) -> DataFrame:
    """Mean milliseconds and samples of each consecutive step.

    Cases count only if they logged FACE_VERIFIED and both ends of the step; the
    latest of repeated actions is used. Steps without samples are kept.
    """
    actions = list(dict.fromkeys(a for s in fixed.LATENCY_STEPS for a in s[:2]))
    stamps = (
        audit.where(F.col("action").isin(*actions))
        .groupBy("case_id")
        .agg(*[F.max(F.when(F.col("action") == a, F.unix_micros(F.col("event_ts").cast("timestamp")))).alias(a) for a in actions])
        .where(F.col("FACE_VERIFIED").isNotNull())
    )
    spans = []
    for i, (start, end, label) in enumerate(fixed.LATENCY_STEPS):
        took = F.col(end) - F.col(start)
        spans.append(F.when(took >= 0, took).alias(f"s{i}"))
    sums = stamps.select(*spans).agg(
        *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(spans))],
        *[F.count(f"s{i}").alias(f"n{i}") for i in range(len(spans))],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("module"),
                round_exact(
                    F.when(F.col(f"n{i}") > 0, F.col(f"t{i}").cast("double") / F.col(f"n{i}") / 1000.0).otherwise(
                        F.lit(0.0)
                    ),
                    1,
                ).alias("time_ms"),
                F.col(f"n{i}").alias("sample_count"),
            )
            for i, (_, _, label) in enumerate(fixed.LATENCY_STEPS)
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def top_risk_reasons(checks: DataFrame, n: int = 6) -> DataFrame:
    return (
        checks.where(F.col("status") == fixed.FAIL)
        .groupBy(F.col("label").alias("reason"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason")
        .limit(n)
    )


def recent_cases(cases: DataFrame, n: int = 10) -> DataFrame:
    return cases.orderBy(F.desc("created_at"), F.desc("case_id")).limit(n)


def kpi_ratios(cases: DataFrame) -> DataFrame:
    """Whole percentages, halves up, 0 when nothing was screened."""
    screened = F.count("*")

    def percent(part: Column) -> Column:
        return F.when(screened > 0, F.floor(part * 100.0 / screened + 0.5)).otherwise(F.lit(0)).cast("long")

    level = F.col("risk_level")
    return cases.agg(
        percent(F.count_if(F.col("officer_decision") == "CLEARED")).alias("mitigation_percent"),
        percent(F.count_if(level.isin("HIGH", "CRITICAL"))).alias("yield_percent"),
        *[percent(F.count_if(level == t)).alias(f"{t.lower()}_percent") for t in fixed.TIERS],
    )


# --- lists and queues -------------------------------------------------------------


def list_cases(
    cases: DataFrame, checks: DataFrame, status: str | None = None, risk_level: str | None = None,
    country: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of cases, newest first, with the failed checks that flagged them.

    The page is cut first; only its cases meet the checks table. Pages may have any
    size, so how they meet is left to the optimizer.
    """
    page = cases
    if status:
        page = page.where(F.col("status") == status)
    if risk_level:
        page = page.where(F.col("risk_level") == risk_level)
    if country:
        page = page.where(_like(F.col("country"), country))
    page = page.orderBy(F.desc("created_at"), F.desc("case_id")).offset(offset).limit(limit)
    failed = checks.where(F.col("status") == fixed.FAIL).join(page.select("case_id"), "case_id")
    rank = Window.partitionBy("case_id").orderBy(
        severity_rank(), F.desc("score_impact"), "label", "check_seq", "part_ref", "tie_ref"
    )
    tops = (
        failed.withColumn("_r", F.row_number().over(rank))
        .where("_r <= 2")
        .groupBy("case_id")
        .agg(F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("_1"),
             F.max(F.when(F.col("_r") == 2, F.col("label"))).alias("_2"))
    )
    counts = failed.groupBy("case_id").agg(F.count("*").alias("n"))
    return (
        page.join(counts, "case_id", "left")
        .join(tops, "case_id", "left")
        .withColumn("flagged_check_count", F.coalesce("n", F.lit(0)))
        .withColumn("top_flagged_checks", F.filter(F.array("_1", "_2"), lambda x: x.isNotNull()))
        .drop("n", "_1", "_2")
    )


def case_detail(cases: DataFrame, analyses: DataFrame, checks: DataFrame, audit: DataFrame, case_id: int) -> DataFrame:
    """One case with its nested analyses, checks and chronological trail.

    The key filter is pushed into all four scans; what is nested belongs to one
    case, so its size is bounded by that case's own file.
    """
    one = lambda df: df.where(F.col("case_id") == case_id)
    nest = lambda df, cols, name: one(df).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias(name)
    )
    return (
        one(cases)
        .join(nest(analyses, [c for c in analyses.columns if c != "case_id"], "analyses"), "case_id", "left")
        .join(nest(checks, ["check_seq", *[c for c in checks.columns if c not in ("case_id", "check_seq")]], "checks"), "case_id", "left")
        .join(nest(audit, ["event_ts", "seq", "action", "actor", "metadata"], "audit_trail"), "case_id", "left")
    )


def _search(query: str) -> Column:
    return (
        _like(F.col("case_number"), query) | _like(F.col("country"), query) | _like(F.col("recommendation"), query)
    )


def review_queue(cases: DataFrame, tab: str = "ALL", query: str = "") -> DataFrame:
    """Cases awaiting a decision; the tier tabs are views of the pending ones."""
    pending = F.col("officer_decision") == "PENDING"
    if tab == "ALL":
        chosen = pending
    elif tab == "CLEARED":
        chosen = F.col("officer_decision") == "CLEARED"
    else:
        chosen = (F.col("risk_level") == tab) & pending
    return cases.where(chosen & _search(query))


def case_archive(cases: DataFrame, tag: str = "ALL", query: str = "") -> DataFrame:
    """Cases whose status, tier or decision equals the tag."""
    if tag == "ALL":
        return cases.where(_search(query))
    hit = (F.col("status") == tag) | (F.col("risk_level") == tag) | (F.col("officer_decision") == tag)
    return cases.where(hit & _search(query))


def audit_search(
    audit: DataFrame, action: str | None = None, actor: str | None = None, case_id: int | None = None,
    search: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of ledger events, newest first."""
    rows = audit
    if action:
        rows = rows.where(_like(F.col("action"), action))
    if actor:
        rows = rows.where(_like(F.col("actor"), actor))
    if case_id is not None:
        rows = rows.where(F.col("case_id") == case_id)
    if search:
        rows = rows.where(
            _like(F.col("action"), search) | _like(F.col("actor"), search) | _like(F.col("case_id").cast("string"), search)
        )
    return rows.orderBy(F.desc("event_ts"), F.desc("seq")).offset(offset).limit(limit)


def audit_actor_class(ledger: DataFrame, kind: str = "ALL", search: str = "") -> DataFrame:
    """Client-side view of the trail: officers, purges, automated actors."""
    hit = (
        _like(F.col("action"), search) | _like(F.col("actor"), search)
        | _like(F.col("case_id").cast("string"), search) | _like(F.col("entry_hash"), search)
    )
    kinds = {
        "OFFICER": F.contains("actor", F.lit("OFFICER")),
        "PURGED": F.contains("action", F.lit("PURGE")),
        "AI": F.startswith("actor", F.lit("AI")),
    }
    return ledger.where(hit & kinds.get(kind, F.lit(True)))


def check_ordering(checks: DataFrame) -> DataFrame:
    """Checks with the ranks that order them inside their factor group.

    The order is one inside a case: rows are sorted within the partition that holds it.
    """
    factor = {name: i for i, name in enumerate(fixed.FACTORS)}
    return checks.withColumns(
        {
            "factor_rank": ladder(F.col("factor"), factor, len(factor)),
            "status_rank": ladder(F.col("status"), fixed.STATUS_RANK),
            "severity_rank": severity_rank(missing=9),
        }
    ).repartition("case_id").sortWithinPartitions(
        "case_id", "factor_rank", "status_rank", "severity_rank", F.desc("score_impact"))


def compliance_status(cases: DataFrame, audit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hashed identifiers, purges and ledger validity in one row."""
    c = cases.agg(
        F.count("*").alias("total_cases"),
        F.count("document_number_hash").alias("cases_with_hashed_identifier"),
        F.count_if("biometrics_purged").alias("cases_purged"),
    )
    a = audit.agg(F.count_if(F.col("action") == "BIOMETRICS_PURGED").alias("purge_events"))
    v = verdicts.agg(
        F.coalesce(F.bool_and("valid"), F.lit(True)).alias("ledger_valid"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("ledger_records"),
    )
    # Three one-row aggregates side by side.
    one = F.lit(1).alias("_one")
    return c.select("*", one).join(a.select("*", one), "_one").join(v.select("*", one), "_one").drop("_one")
