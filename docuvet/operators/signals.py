"""Forensic and face measurements turned into decisions, scores and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.checks import check, evidence
from ..functions.numbers import clamp, exact_sum, round_exact
from ..functions.vectors import face_similarity

_TAMPER = ("TAMPER", "TAMPER")
_FACE = ("FACE", "FACE")

# Families of forensic signals, and the check that says a family was clean.
CLEAN_CHECKS = {
    "splice": ("TAMPER_EDGE_DISCONTINUITY", "Boundary / Edge Splicing Scan", 0.85),
    "portrait": ("TAMPER_PHOTO_BOUNDARY_ANOMALY", "Portrait Boundary Scan", 0.85),
    "exif": ("TAMPER_EXIF_METADATA", "EXIF Metadata Consistency", 0.80),
}
FAMILY = {
    "edge_discontinuity": "splice",
    "stamp_forgery": "splice",
    "photo_boundary_anomaly": "portrait",
    "exif_metadata_missing": "exif",
    "exif_editing_software": "exif",
    "exif_date_inconsistency": "exif",
}


def _signal(kind: Column | str, confidence: Column, **extra: Column) -> Column:
    empty = {"measured": "double", "threshold": "double", "unit": "string", "region": "array<int>"}
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [kind.alias("type"), confidence.cast("double").alias("confidence")]
    parts += [extra.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()]
    return F.struct(*parts)


def _explode(df: DataFrame, key: str, signals: list[Column]) -> DataFrame:
    fired = F.filter(F.array(*signals), lambda s: s.isNotNull())
    return df.select(key, F.explode(fired).alias("s")).select(key, "s.*")


def ela_signal(measures: DataFrame, key: str = "case_id") -> DataFrame:
    """Recompression signal where the mean error level is above its threshold."""
    ela = F.col("mean_ela")
    confidence = F.least(F.lit(0.92), round_exact(ela * 3.5, 2))
    return _explode(
        measures, key,
        [F.when(ela > fixed.ELA_THRESHOLD, _signal("compression_anomaly", confidence, measured=ela,
                threshold=F.lit(fixed.ELA_THRESHOLD), unit=F.lit("ela_mean_error")))],
    )


def portrait_boundary(measures: DataFrame, key: str = "case_id") -> DataFrame:
    """Seam signal around the portrait from edge density or border variance."""
    density = F.col("edge_density")
    return _explode(
        measures, key,
        [F.when((density > 0.18) | (F.col("border_var") > 9000), _signal("photo_boundary_anomaly", F.lit(0.86),
                measured=round_exact(density, 3), threshold=F.lit(0.18), unit=F.lit("edge_density")))],
    )


def compression_ratio(mrz_mean: Column, upper_mean: Column) -> Column:
    return F.abs(mrz_mean - upper_mean) / (upper_mean + F.lit(1e-5))


def text_compression(measures: DataFrame, key: str = "case_id") -> DataFrame:
    """Zone-against-body recompression verdict; not applicable without a zone."""
    has_zone = ~F.coalesce(F.col("document_type"), F.lit("")).isin(*fixed.NON_MRZ_TYPES)
    share = compression_ratio(F.col("mrz_mean"), F.col("upper_mean"))
    fired = has_zone & (share > 0.85) & (F.col("mrz_mean") > 35)
    return measures.select(
        key,
        F.when(~has_zone, fixed.NOT_APPLICABLE).when(fired, fixed.FAIL).otherwise(fixed.PASS).alias("status"),
        F.when(has_zone, round_exact(share, 3)).alias("ratio"),
        F.when(fired, F.lit(0.82)).alias("confidence"),
    )


def exif_signals(images: DataFrame, key: str = "case_id") -> DataFrame:
    """Signals from an image's tag map ``tags`` (``map<int,string>``)."""
    tag = lambda number: F.nullif(F.try_element_at(F.col("tags"), F.lit(number)), F.lit(""))
    missing = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    software = F.upper(tag(fixed.EXIF_SOFTWARE))
    edited = reduce(lambda a, b: a | b, [F.contains(software, F.lit(m)) for m in fixed.EXIF_EDITORS])
    parse = lambda text: F.try_to_timestamp(text, F.lit(fixed.EXIF_DATE_FORMAT))
    taken = parse(F.coalesce(tag(fixed.EXIF_ORIGINAL), tag(fixed.EXIF_DIGITIZED)))
    saved = parse(tag(fixed.EXIF_DATETIME))
    gap = (F.unix_timestamp(saved) - F.unix_timestamp(taken)) / 3600.0
    return _explode(
        images, key,
        [
            F.when(missing, _signal("exif_metadata_missing", F.lit(0.35))),
            F.when(~missing & edited, _signal("exif_editing_software", F.lit(0.85))),
            F.when(
                ~missing & (gap > 24.0),
                _signal("exif_date_inconsistency", F.least(F.lit(0.9), round_exact(0.6 + gap / 500.0, 2)),
                        measured=gap, threshold=F.lit(24.0), unit=F.lit("hours")),
            ),
        ],
    )


def splice_shape(w: Column, h: Column) -> Column:
    """Stamp-like patches are about three times as long as they are high."""
    aspect = F.greatest(w, h) / F.least(w, h)
    return F.when(aspect.between(2.2, 4.2), "stamp_forgery").otherwise("edge_discontinuity")


def splice_boxes(boxes: DataFrame, codes: DataFrame, cell: int = 64) -> DataFrame:
    """First five suspicious patches per image, none mostly inside a printed code.

    A code that covers more than half of a patch must contain the patch's centre,
    so patches and codes meet in the grid cell of that centre: an equi-join on
    (image, cell) instead of every patch of an image against every code in it.
    """
    w, h = F.col("w"), F.col("h")
    area = w * h
    shaped = boxes.where(
        (area > 1500) & (area < 70000) & (w > 35) & (h > 18)
        & (F.greatest(w, h) / F.least(w, h) <= 8.0) & (F.col("variance") > 1400)
    )
    cell_of = lambda v: F.floor(v / F.lit(cell))
    patches = shaped.withColumns(
        {"cx": cell_of(F.col("x") + w / 2), "cy": cell_of(F.col("y") + h / 2)}
    ).alias("p")
    q = codes.select(
        "image_id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw"), F.col("h").alias("qh")
    )
    span = lambda at, size: F.sequence(cell_of(F.col(at)), cell_of(F.col(at) + F.col(size)))
    q = q.withColumn("cx", F.explode(span("qx", "qw"))).withColumn("cy", F.explode(span("qy", "qh"))).alias("q")

    def overlap(at: str, size: str) -> Column:
        low = F.greatest(F.col(f"p.{at}"), F.col(f"q.q{at}"))
        high = F.least(F.col(f"p.{at}") + F.col(f"p.{size}"), F.col(f"q.q{at}") + F.col(f"q.q{size}"))
        return F.greatest(F.lit(0), high - low)

    covered = overlap("x", "w") * overlap("y", "h") > 0.5 * F.col("p.w") * F.col("p.h")
    same_cell = (
        (F.col("p.image_id") == F.col("q.image_id")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))
    )
    free = patches.join(q, same_cell & covered, "left_anti")
    order = Window.partitionBy("image_id").orderBy("box_no")
    confidence = F.least(F.lit(0.95), round_exact(0.65 + F.col("variance") / 5000, 2))
    return (
        free.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= 5)
        .select("image_id", "box_no", "x", "y", "w", "h", splice_shape(w, h).alias("type"),
                confidence.alias("confidence"), round_exact(F.col("variance"), 1).alias("roi_variance"))
    )


def top_bin_share(bins: DataFrame, key: str = "image_id") -> DataFrame:
    """Share of a band's energy that sits in its eight strongest bins.

    The totals are a plain aggregation and the top eight a ranked limit, which
    prunes each task's bins before the shuffle, so no image is collected whole.
    """
    low, high = fixed.FREQUENCY_BAND
    band = bins.where((F.col("radius") >= low) & (F.col("radius") < high)).withColumn(
        "energy", F.col("magnitude") * F.col("magnitude")
    )
    # a share does not depend on the unit of energy, so plain sums do for any magnitude
    totals = band.groupBy(key).agg(F.sum("energy").alias("total"))
    order = Window.partitionBy(key).orderBy(F.desc("energy"), "bin_no")
    tops = (
        band.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= fixed.FREQUENCY_TOP_BINS)
        .groupBy(key)
        .agg(F.sum("energy").alias("top"))
    )
    every = bins.select(key).distinct()
    share = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(F.lit(0.0))
    return (
        every.join(totals, key, "left")
        .join(tops, key, "left")
        .select(
            key,
            round_exact(share, 3).alias("concentration"),
            (share >= fixed.ARTIFACT_THRESHOLD).alias("artifact_detected"),
        )
    )


# --- scores -------------------------------------------------------------------


def tamper_tier(score: Column) -> Column:
    return (
        F.when(score >= 0.85, "CRITICAL").when(score >= 0.70, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")
    )


def tamper_score(measures: DataFrame, signals: DataFrame, key: str = "case_id") -> DataFrame:
    """Score and tier per case: the stronger baseline plus weighted signals.

    ``measures``: key, mean_ela and optionally cnn_prob. ``signals``: key, type,
    confidence. Confidences are added exactly, so the result does not depend on
    how rows are spread over tasks.
    """
    weight = F.when(
        F.col("type") != "compression_anomaly", F.coalesce(F.col("confidence"), F.lit(0.8)) * 0.25
    )
    added = signals.groupBy(key).agg(exact_sum(weight).alias("added"))
    cnn = F.col("cnn_prob") if "cnn_prob" in measures.columns else F.lit(None).cast("double")
    base = measures.groupBy(key).agg(
        F.max("mean_ela").alias("mean_ela"), F.max(cnn).alias("cnn_prob")
    )
    raw = F.greatest(F.col("mean_ela") * 2.0, F.col("cnn_prob") * 0.85) + F.coalesce(F.col("added"), F.lit(0.0))
    score = clamp(round_exact(raw.cast("decimal(18,6)").cast("double"), 2), 0.04, 0.96)
    return base.join(added, key, "left").select(
        key, score.alias("tamper_risk"), tamper_tier(score).alias("tamper_level")
    )


def _severity(confidence: Column) -> Column:
    return (
        F.when(F.col("tamper_level") == "CRITICAL", "CRITICAL").when(confidence > 0.85, "HIGH").otherwise("MEDIUM")
    )


def _impact(confidence: Column) -> Column:
    return round_exact(confidence * 18.0, 1)


def region_checks(regions: DataFrame, tiers: DataFrame, key: str = "case_id") -> DataFrame:
    """A check per classified region; the tier of the document sets the severity."""
    p, region = F.col("probability"), F.col("region_name")
    bad = p >= fixed.REGION_THRESHOLD
    made = check(
        F.concat(F.lit("TAMPER_CNN_"), F.upper(region), F.lit("_REGION")), *_TAMPER,
        F.concat(F.lit("Forensic CNN — "), F.initcap(region), F.lit(" Region")),
        F.when(bad, fixed.FAIL).otherwise(fixed.PASS), F.when(bad, p).otherwise(1.0 - p),
        F.concat(F.lit("Tampering probability "), round_exact(p * 100, 1).cast("string"), F.lit("%.")),
        _severity(p), _impact(p), evidence(round_exact(p, 3), fixed.REGION_THRESHOLD, "tamper_probability"),
    )
    return regions.join(tiers.select(key, "tamper_level"), key).select(key, made.alias("c")).select(key, "c.*")


def region_max(regions: DataFrame, key: str = "case_id") -> DataFrame:
    return regions.groupBy(key).agg(F.max("probability").alias("cnn_prob"))


def tamper_checks(measures: DataFrame, signals: DataFrame, tiers: DataFrame, key: str = "case_id") -> DataFrame:
    """Every forensic check of every case.

    One row per signal, a PASS row for each family that stayed silent, and one
    verdict each for error level and zone compression. Families that fired come
    out of one aggregation, so silence needs no anti-join per family.
    """
    ela = round_exact(F.col("mean_ela"), 3)
    ela_confidence = F.least(F.lit(0.92), round_exact(F.col("mean_ela") * 3.5, 2))
    hot = F.col("mean_ela") > fixed.ELA_THRESHOLD
    has_zone = ~F.coalesce(F.col("document_type"), F.lit("")).isin(*fixed.NON_MRZ_TYPES)
    ratio = compression_ratio(F.col("mrz_mean"), F.col("upper_mean"))
    torn = has_zone & (ratio > 0.85) & (F.col("mrz_mean") > 35)
    zone_key, zone_label = "TAMPER_TEXT_COMPRESSION_ANOMALY", "Text/MRZ Compression Consistency"
    fired = signals.groupBy(key).agg(
        *[
            F.bool_or(F.col("type").isin(*[t for t, f in FAMILY.items() if f == family])).alias(f"_{family}")
            for family in CLEAN_CHECKS
        ]
    )
    base = (
        measures.join(tiers.select(key, "tamper_level"), key).join(fired, key, "left")
    )
    clean = [
        F.when(
            ~F.coalesce(F.col(f"_{family}"), F.lit(False)),
            check(check_key, *_TAMPER, label, fixed.PASS, confidence, "Nothing suspicious found."),
        )
        for family, (check_key, label, confidence) in CLEAN_CHECKS.items()
    ]
    verdicts = F.array(
        check("TAMPER_ELA", *_TAMPER, "Error Level Analysis",
              F.when(hot, fixed.FAIL).otherwise(fixed.PASS), F.when(hot, ela_confidence).otherwise(0.9),
              "Mean recompression error against its threshold.", _severity(ela_confidence),
              _impact(ela_confidence), evidence(ela, fixed.ELA_THRESHOLD, "ela_mean_error")),
        F.when(~has_zone, check(zone_key, *_TAMPER, zone_label, fixed.NOT_APPLICABLE, 0.95,
                                "This document type carries no machine-readable zone."))
        .otherwise(
            check(zone_key, *_TAMPER, zone_label, F.when(torn, fixed.FAIL).otherwise(fixed.PASS),
                  F.when(torn, 0.82).otherwise(0.8), "Compression of the zone against the body.",
                  _severity(F.lit(0.82)), _impact(F.lit(0.82)),
                  evidence(round_exact(ratio, 3), 0.85, "mrz_body_compression_ratio"))
        ),
        *clean,
    )
    per_case = base.select(key, F.explode(F.filter(verdicts, lambda c: c.isNotNull())).alias("c")).select(key, "c.*")

    confidence = F.coalesce(F.col("confidence"), F.lit(0.8))
    extra = {n: F.col(n) if n in signals.columns else F.lit(None) for n in ("measured", "threshold", "unit", "region")}
    one = check(
        F.concat(F.lit("TAMPER_"), F.upper("type")), *_TAMPER,
        F.concat(F.lit("Forensic Anomaly ("), F.initcap(F.regexp_replace("type", "_", " ")), F.lit(")")),
        fixed.FAIL, confidence, "A forensic measurement left its normal range.",
        _severity(confidence), _impact(confidence),
        evidence(extra["measured"], extra["threshold"], extra["unit"], extra["region"],
                 F.when(extra["region"].isNotNull(), "document")),
    )
    per_signal = (
        signals.where(F.col("type").isin(*FAMILY))
        .join(tiers.select(key, "tamper_level"), key)
        .select(key, one.alias("c"))
        .select(key, "c.*")
    )
    return per_case.unionByName(per_signal)


# --- faces ----------------------------------------------------------------------


def face_status(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """Status, similarity and the check behind it, from counts and a similarity.

    The document side is judged first, then the live side, then the match.
    """
    doc, live, sim = F.col("doc_faces"), F.col("live_faces"), F.col("similarity")
    match = sim >= fixed.FACE_MATCH_THRESHOLD
    status = (
        F.when((doc == 0), "NO_FACE_DETECTED")
        .when(doc > 1, "MULTIPLE_FACES")
        .when(live == 0, "NO_FACE_DETECTED")
        .when(live > 1, "MULTIPLE_FACES")
        .when(match, "MATCH")
        .otherwise("REVIEW_REQUIRED")
    )
    made = (
        F.when(doc == 0, check("FACE_DOCUMENT_PORTRAIT_DETECTION", *_FACE, "Document Portrait Undetected", fixed.FAIL,
                               0.90, "No portrait found on the document.", "HIGH", 20.0))
        .when(doc > 1, check("FACE_DOCUMENT_FACE_COUNT", *_FACE, "Multiple Faces in Document Image", fixed.FAIL, 0.85,
                             "More than one face on the document.", "MEDIUM", 15.0, evidence(doc, 1, "face_count")))
        .when(live == 0, check("FACE_LIVE_CAPTURE_DETECTION", *_FACE, "Live Subject Face Not Detected", fixed.FAIL,
                               0.90, "No face in the live capture.", "HIGH", 20.0))
        .when(live > 1, check("FACE_LIVE_CAPTURE_FACE_COUNT", *_FACE, "Multiple Faces in Live Capture", fixed.FAIL,
                              0.95, "More than one face in the live capture.", "MEDIUM", 15.0,
                              evidence(live, 1, "face_count")))
        .otherwise(
            check("FACE_BIOMETRIC_MATCH", *_FACE,
                  F.when(match, "Biometric Face Match").otherwise("Biometric Face Mismatch"),
                  F.when(match, fixed.PASS).otherwise(fixed.FAIL),
                  round_exact(F.when(match, sim).otherwise(1.0 - sim), 2),
                  "Similarity of portrait and live capture against the match threshold.", "HIGH", 25.0,
                  evidence(round_exact(sim, 3), fixed.FACE_MATCH_THRESHOLD, "cosine_similarity"))
        )
    )
    compared = status.isin("MATCH", "REVIEW_REQUIRED")
    return faces.select(
        key, status.alias("face_status"),
        F.when(compared, round_exact(sim, 3)).otherwise(F.lit(0.0)).alias("face_similarity"),
        made.alias("c"),
    ).select(key, "face_status", "face_similarity", "c.*")


def face_quality(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """Quality flags and the liveness indicator of a live capture."""
    dark, bright = F.col("mean_brightness") < 45, F.col("mean_brightness") > 220
    blurry = F.col("sharpness") < 35.0
    artifact = F.col("concentration") >= fixed.ARTIFACT_THRESHOLD
    off = lambda cond, by: F.when(cond, F.lit(by)).otherwise(F.lit(0.0))
    live = F.lit(0.95) - off(blurry, 0.25) - off(dark | bright, 0.15) - off(artifact, 0.35)
    return faces.select(
        key, "mean_brightness", "sharpness", "concentration",
        dark.alias("is_dark"), bright.alias("is_overexposed"), blurry.alias("is_blurry"),
        artifact.alias("artifact_detected"),
        round_exact(F.greatest(F.lit(0.20), live), 2).alias("liveness_score"),
    )


def face_quality_checks(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """Three low-severity checks: brightness, sharpness, recapture pattern."""
    bad = lambda cond: F.when(cond, fixed.FAIL).otherwise(fixed.PASS)
    brightness = round_exact(F.col("mean_brightness"), 1)
    sharpness = round_exact(F.col("sharpness"), 1)
    light = F.col("is_dark") | F.col("is_overexposed")
    pattern = F.col("artifact_detected")
    checks = F.array(
        check("FACE_QUALITY_BRIGHTNESS", *_FACE, "Live Capture Brightness", bad(light), 0.85,
              "Mean brightness of the live capture.", "LOW", 2.5,
              evidence(brightness, "45–220", "mean_brightness_0_255")),
        check("FACE_QUALITY_SHARPNESS", *_FACE, "Live Capture Sharpness", bad(F.col("is_blurry")), 0.85,
              "Sharpness of the live capture.", "LOW", 2.5, evidence(sharpness, 35.0, "laplacian_variance")),
        check("FACE_QUALITY_MOIRE", *_FACE,
              F.when(pattern, "Possible Screen/Print Recapture Pattern").otherwise("Liveness Frequency-Pattern Scan"),
              bad(pattern), 0.5, "Indicator only: periodic pattern in the live capture.", "LOW", 5.0,
              evidence(F.col("concentration"), fixed.ARTIFACT_THRESHOLD, "energy_concentration")),
    )
    return face_quality(faces, key).select(key, F.explode(checks).alias("c")).select(key, "c.*")


def portrait_comparison(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """Two portraits of one claimed identity: same, changed, or undetected."""
    sim = face_similarity(F.col("embedding_a"), F.col("embedding_b"))
    found = (F.col("faces_a") > 0) & (F.col("faces_b") > 0)
    return pairs.select(key, found.alias("_found"), sim.alias("_sim")).select(
        key,
        F.when(F.col("_found"), round_exact(F.col("_sim"), 3)).otherwise(F.lit(0.0)).alias("similarity"),
        F.when(~F.col("_found"), "NO_FACE_DETECTED")
        .when(F.col("_sim") >= fixed.FACE_MATCH_THRESHOLD, "SAME_PORTRAIT")
        .otherwise("PORTRAIT_CHANGED")
        .alias("portrait_status"),
    )
