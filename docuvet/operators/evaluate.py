"""Model-evaluation jobs: scored tables in, metrics out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.numbers import exact_sum
from .gallery import gallery_best_match
from .mrz import parse_mrz_lines
from .signals import tamper_score

MRZ_FIELDS = ["document_number", "birth_date", "expiry_date", "surname", "given_names", "nationality", "sex"]


def share(part: Column, whole: Column) -> Column:
    """A share; NaN when there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(float("nan")))


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.count(value)


def _confusion(predicted: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(predicted & (truth == 1)).alias("tp"),
        F.count_if(predicted & (truth == 0)).alias("fp"),
        F.count_if(~predicted & (truth == 0)).alias("tn"),
        F.count_if(~predicted & (truth == 1)).alias("fn"),
    ]


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {"accuracy": share(tp + tn, tp + fp + tn + fn), "far": share(fp, fp + tn), "frr": share(fn, fn + tp)}


def confusion_metrics(scored: DataFrame, truth: str = "y", prob: str = "prob") -> DataFrame:
    """Confusion counts and rates; a tie of the two classes goes to the negative."""
    y = F.col(truth)
    base = scored.agg(
        F.count("*").alias("n"),
        *_confusion(F.col(prob) > 0.5, y),
        exact_mean(F.when(y == 0, F.col(prob))).alias("mean_prob_negative"),
        exact_mean(F.when(y == 1, F.col(prob))).alias("mean_prob_positive"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = base.withColumns({**_rates(), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, F.lit(float("nan"))).otherwise(2 * p * r / (p + r)))


_FIRST, _STEP, _COUNT = 0.05, 0.01, 90


def threshold_sweep(scored: DataFrame, truth: str = "same", score: str = "score") -> DataFrame:
    """Accuracy at thresholds 0.05, 0.06 ... 0.94.

    Every score is counted once, in the bucket of the thresholds it reaches; the
    90 results are running sums over at most 91 bucket rows.
    """
    at = lambda i: F.lit(_FIRST) + i * F.lit(_STEP)
    s = F.col(score)
    guess = F.floor((s - _FIRST) / _STEP)
    reached = (
        F.when(at(guess + 1) <= s, guess + 2).when(at(guess) <= s, guess + 1).otherwise(guess)
    )
    reached = F.greatest(F.lit(0), F.least(F.lit(_COUNT), reached)).cast("int")
    counts = scored.groupBy(reached.alias("bucket")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )
    spine = scored.sparkSession.range(0, _COUNT + 1).select(F.col("id").cast("int").alias("bucket"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    table = spine.join(counts, "bucket", "left").select(
        "bucket",
        F.sum(z("pos")).over(above).alias("tp"), F.sum(z("neg")).over(above).alias("fp"),
        F.sum(z("pos")).over(whole).alias("all_pos"), F.sum(z("neg")).over(whole).alias("all_neg"),
    )
    return table.where("bucket > 0").select(
        (F.col("bucket") - 1).alias("step"),
        at(F.col("bucket") - 1).alias("threshold"),
        "tp", "fp",
        (F.col("all_neg") - F.col("fp")).alias("tn"), (F.col("all_pos") - F.col("tp")).alias("fn"),
    ).withColumns(_rates())


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of the highest accuracy."""
    return sweep.orderBy(F.desc("accuracy"), "step").limit(1)


def rates_at_thresholds(scored: DataFrame, thresholds: list[float], truth: str = "same", score: str = "score") -> DataFrame:
    """Accuracy, false-accept and false-reject rate at each listed threshold, in one pass."""
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [c.alias(f"{n}{i}") for c, n in zip(_confusion(F.col(score) >= t, F.col(truth)), ("tp", "fp", "tn", "fn"))]
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")])
            for i, t in enumerate(thresholds)
        ]
    )
    return scored.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumns(_rates())


def threshold_sensitivity(scored: DataFrame, thresholds: list[float], group: str, score: str = "score") -> DataFrame:
    """Share of each group's scores that reach each threshold."""
    aggs = [F.count_if(F.col(score) >= t).alias(f"n{i}") for i, t in enumerate(thresholds)]
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), share(F.col(f"n{i}"), F.col("n")).alias("rate"))
            for i, t in enumerate(thresholds)
        ]
    )
    return scored.groupBy(group).agg(F.count("*").alias("n"), *aggs).select(
        group, F.explode(rows).alias("r")
    ).select(group, "r.*")


def exact_percentiles(scored: DataFrame, group: str, score: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """Linearly interpolated percentiles without sorting a group in one task.

    Equal scores are merged first; ranks come from bin counts plus a window inside
    each bin. Scores are expected in 0..1, others fall into the outer bins.
    """
    values = scored.where(F.col(score).isNotNull()).groupBy(group, F.col(score).alias("_v")).agg(F.count("*").alias("_c"))
    binned = values.withColumn(
        "_bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("_v") * bins))).cast("int")
    )
    per_bin = binned.groupBy(group, "_bin").agg(F.sum("_c").alias("_n"))
    across = Window.partitionBy(group).orderBy("_bin")
    offsets = per_bin.select(
        group, "_bin",
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.sum("_n").over(Window.partitionBy(group)).alias("_total"),
    )
    inside = Window.partitionBy(group, "_bin").orderBy("_v")
    ranked = binned.withColumn("_upto", F.sum("_c").over(inside)).join(offsets, [group, "_bin"]).select(
        group, "_v", "_total",
        (F.col("_o") + F.col("_upto") - F.col("_c")).alias("_first"),
        (F.col("_o") + F.col("_upto") - 1).alias("_last"),
    )
    picks = []
    for i, q in enumerate(shares):
        place = F.lit(q) * (F.col("_total") - 1)
        holds = lambda rank: F.when((F.col("_first") <= rank) & (F.col("_last") >= rank), F.col("_v"))
        picks += [
            F.max(holds(F.floor(place))).alias(f"_lo{i}"), F.max(holds(F.ceil(place))).alias(f"_hi{i}"),
        ]
    found = ranked.groupBy(group).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for i, q in enumerate(shares):
        place = F.lit(q) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(f"p{round(q * 100)}"))
    return found.select(group, *out)


def score_distribution(scored: DataFrame, group: str, score: str = "score", shares: list[float] | None = None) -> DataFrame:
    """Count, mean, population deviation, range and percentiles per group."""
    s = F.col(score)
    base = scored.groupBy(group).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
        F.min(s).alias("min"), F.max(s).alias("max"),
    )
    return base.join(exact_percentiles(scored, group, score, shares or [0.5, 0.9, 0.99]), group)


# --- gallery at scale -------------------------------------------------------------


def impostor_scores(probes: DataFrame, gallery: DataFrame, identity: str) -> DataFrame:
    """Highest similarity of each probe to any gallery row of another identity."""
    best = gallery_best_match(probes, gallery, threshold=0.0, exclude=identity)
    return probes.select(F.col("case_id").cast("long").alias("case_id")).join(best, "case_id", "left").select(
        "case_id", F.coalesce("similarity", F.lit(0.0)).alias("score")
    )


def one_to_many_far(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """False-accept rate of the search at each threshold, with the score spread."""
    one = scores.withColumn("grp", F.lit("impostor"))
    rates = threshold_sensitivity(one, thresholds, "grp").withColumnRenamed("rate", "far")
    return rates.join(score_distribution(one, "grp", "score", [0.99]), "grp").drop("grp")


def duplicate_recall(probes: DataFrame, gallery: DataFrame, identity: str, threshold: float = fixed.GALLERY_MATCH_THRESHOLD) -> DataFrame:
    """Second captures that find a match, and those that find the right identity.

    Attribution looks at the best row whether or not it reaches the threshold.
    """
    best = gallery_best_match(probes, gallery, threshold=0.0)
    truth = probes.select(F.col("case_id").cast("long").alias("case_id"), F.col(identity).alias("_true"))
    owner = gallery.select(F.col("case_id").cast("long").alias("match_case_id"), F.col(identity).alias("_found"))
    joined = truth.join(best, "case_id", "left").join(owner, "match_case_id", "left")
    s = F.coalesce("similarity", F.lit(0.0))
    return joined.agg(
        F.count("*").alias("probes"),
        F.count_if(s >= threshold).alias("flagged"),
        share(F.count_if(s >= threshold), F.count("*")).alias("recall"),
        F.count_if(F.col("_found") == F.col("_true")).alias("correct_identity"),
        F.avg(s).alias("mean_similarity"),
        F.min(s).alias("min_similarity"),
    )


# --- machine-readable zones ---------------------------------------------------------


def _closest(candidates: Column, truth: Column) -> Column:
    """Distance and length of the candidate nearest to the truth line, first wins."""
    scored = F.transform(
        candidates,
        lambda line, i: F.struct(F.levenshtein(line, truth).alias("d"), i.alias("i"), F.length(line).alias("n")),
    )
    return F.array_min(scored)


def mrz_line_accuracy(reads: DataFrame, kind: str = "doc_type") -> DataFrame:
    """Mean character accuracy per type, and the share of pages without a zone.

    ``reads``: line1, line2 (truth), ocr_lines (array). A page's candidates sit in
    its own row, so picking the closest one needs no join.
    """
    lines = F.col("ocr_lines")
    enough = F.size(lines) >= 2

    def accuracy(truth: Column) -> Column:
        near = _closest(lines, truth)
        return F.when(enough, 1.0 - near["d"] / F.greatest(F.length(truth), near["n"]))

    per_page = reads.select(
        kind, enough.alias("found"), accuracy(F.col("line1")).alias("a1"), accuracy(F.col("line2")).alias("a2")
    )
    total = F.sum(F.col("a1").cast("decimal(20,12)") + F.col("a2").cast("decimal(20,12)")).cast("double")
    return per_page.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("found")).alias("not_found"),
        share(F.count_if(~F.col("found")), F.count("*")).alias("not_found_share"),
        share(total, F.count("a1") * 2).alias("mean_line_accuracy"),
    )


def _both_parsed(reads: DataFrame) -> DataFrame:
    """Truth and read zones side by side; pages with a malformed truth are skipped."""
    truth = parse_mrz_lines(reads, "TD3", "line1", "line2").withColumnRenamed("mrz", "truth")
    truth = truth.where(F.col("truth.is_valid"))
    lines = F.col("ocr_lines")
    fmt = F.when(F.size(lines) >= 3, "TD1").when(F.size(lines) == 2, "TD3")
    staged = truth.withColumns({f"_o{n}": F.get(lines, F.lit(n - 1)) for n in (1, 2, 3)})
    return parse_mrz_lines(staged, fmt, "_o1", "_o2", "_o3").drop("_o1", "_o2", "_o3")


def mrz_field_accuracy(reads: DataFrame) -> DataFrame:
    """Exact matches per field among the pages that parsed at all."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                (F.trim(F.col(f"mrz.{f}")) == F.trim(F.col(f"truth.{f}"))).alias("hit"),
            )
            for f in MRZ_FIELDS
        ]
    )
    long = _both_parsed(reads).where(F.col("mrz").isNotNull()).select(F.explode(rows).alias("r")).select("r.*")
    return long.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("matched"),
        share(F.count_if("hit"), F.count("*")).alias("rate"),
    )


def mrz_checksum_rates(reads: DataFrame, kind: str = "doc_type") -> DataFrame:
    """Share of fully valid reads per type and overall, over all well-formed pages."""
    both = _both_parsed(reads)
    ok = F.coalesce(F.col("mrz.is_valid"), F.lit(False))
    return (
        both.rollup(kind)
        .agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), share(F.count_if(ok), F.count("*")).alias("pass_rate"))
        .withColumn(kind, F.coalesce(kind, F.lit("ALL")))
    )


def mrz_failure_report(reads: DataFrame, kind: str = "doc_type", n: int = 8) -> DataFrame:
    """Truth beside read for the first failures of each type."""
    failed = _both_parsed(reads).where(~F.coalesce(F.col("mrz.is_valid"), F.lit(False)))
    order = Window.partitionBy(kind).orderBy("doc_id")
    verdict = F.array_join(
        F.transform("mrz.checksums", lambda c: F.concat(c["field"], F.lit("="), c["valid"].cast("string"))), ", "
    )
    return (
        failed.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= n)
        .select(kind, "doc_id", "line1", "line2", F.array_join("ocr_lines", " / ").alias("ocr"), verdict.alias("checksums"))
    )


# --- signals --------------------------------------------------------------------------


def signal_hit_rates(images: DataFrame, signals: DataFrame, group: str, groups: list[str], key: str = "case_id") -> DataFrame:
    """Per signal type: hits and rate in each of two groups, and their difference.

    ``images``: key, group (the denominators). The row ANY counts images with at
    least one signal, TOTAL counts signals.
    """
    sizes = images.groupBy(group).agg(F.count("*").alias("checked"))
    per_image = signals.groupBy(key, "type").agg(F.count("*").alias("k"))
    tagged = per_image.join(images.select(key, group), key)
    by_type = tagged.groupBy(group, "type").agg(F.sum("k").alias("hits"))
    any_hit = tagged.select(key, group).distinct().groupBy(group).agg(F.count("*").alias("hits")).withColumn("type", F.lit("ANY"))
    total = by_type.groupBy(group).agg(F.sum("hits").alias("hits")).withColumn("type", F.lit("TOTAL"))
    rows = by_type.unionByName(any_hit).unionByName(total).join(sizes, group)
    a, b = groups
    pick = lambda g, c: F.coalesce(F.max(F.when(F.col(group) == g, c)), F.lit(0))
    rate = F.col("hits") / F.col("checked")
    return rows.groupBy("type").agg(
        pick(a, F.col("hits")).alias("hits_a"), pick(b, F.col("hits")).alias("hits_b"),
        pick(a, rate).alias("rate_a"), pick(b, rate).alias("rate_b"),
    ).withColumn("delta", F.col("rate_b") - F.col("rate_a"))


def score_impact(measures: DataFrame, signals: DataFrame, family: list[str], key: str = "case_id") -> DataFrame:
    """What a family of signals does to score and tier."""
    rest = signals.where(~F.col("type").isin(*family))
    name = lambda df, s: df.select(key, F.col("tamper_risk").alias(f"score_{s}"), F.col("tamper_level").alias(f"tier_{s}"))
    both = name(tamper_score(measures, signals, key), "with").join(name(tamper_score(measures, rest, key), "without"), key)
    delta = (F.col("score_with") - F.col("score_without")).cast("decimal(18,6)")
    return both.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("tier_with") != F.col("tier_without")).alias("tier_changed"),
        (F.sum(delta).cast("double") / F.count("*")).alias("mean_delta"),
        F.max(delta).cast("double").alias("max_delta"),
    )
