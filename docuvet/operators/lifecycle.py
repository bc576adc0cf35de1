"""Privacy operations and the life of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.hashing import canonical_json, hash_identifier
from ..functions.text import blank_to_null
from ..session import spread
from .ledger import block_status
from .ranking import numbered, stable_hash


def purge_biometrics(
    purge: DataFrame, cases: DataFrame, analyses: DataFrame, gallery: DataFrame, at: Column, triggered_by: str,
    stored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scrub the biometrics of the listed cases; the cases and scores stay.

    ``purge``: case_id. ``stored`` (path): the files that exist; without it every file a
    case may have is taken to exist. Only existing files are listed and counted. Returns the new cases, analyses and gallery, the paths of
    artefacts to delete, and the events to seal into the ledger.
    """
    listed = purge.select("case_id").distinct().withColumn("_purge", F.lit(True))
    hit = F.coalesce("_purge", F.lit(False))
    flag = lambda df: df.join(listed, "case_id", "left")
    marker = F.lit(fixed.PURGED_MARKER)
    swap = lambda c: F.when(hit, marker).otherwise(F.col(c)).alias(c)
    purged_flag = (F.col("biometrics_purged") | hit).alias("biometrics_purged")

    def rewrite(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
        return flag(df).select(*[changed.get(c, F.col(c)) for c in df.columns])

    paths = analyses.join(listed.select("case_id"), "case_id", "left_semi").select(
        "case_id", F.explode(F.array("document_image_path", "face_image_path")).alias("path")
    )
    live = paths.where(F.col("path").isNotNull() & ~F.startswith("path", F.lit("[PURGED")))
    derived = listed.select(
        "case_id",
        F.explode(
            F.array(
                F.concat(F.lit("crops/"), F.col("case_id"), F.lit("_doc_face.jpg")),
                F.concat(F.lit("crops/"), F.col("case_id"), F.lit("_live_face.jpg")),
                F.concat(F.lit("heatmaps/"), F.col("case_id"), F.lit("_tamper_heatmap.jpg")),
            )
        ).alias("path"),
    )
    known = listed.join(cases.select("case_id", "case_number"), "case_id")
    artefacts = live.unionByName(derived.join(cases.select("case_id"), "case_id", "left_semi"))
    if stored is not None:
        artefacts = artefacts.join(stored.select("path").distinct(), "path", "left_semi").select("case_id", "path")
    counts = artefacts.groupBy("case_id").agg(F.count("*").alias("n"))
    meta = F.create_map(
        F.lit("protocol"), F.lit("GDPR-Art17-Privacy-by-Design"),
        F.lit("purged_files_count"), F.coalesce("n", F.lit(0)).cast("string"),
        F.lit("case_number"), F.col("case_number"),
        F.lit("retained_metadata"), F.lit("Anonymized hash and risk score only"),
        F.lit("triggered_by"), F.lit(triggered_by),
    )
    events = known.join(counts, "case_id", "left").select(
        "case_id", F.lit("BIOMETRICS_PURGED").alias("action"), F.lit("PRIVACY-SCRUBBER-ENGINE").alias("actor"),
        at.alias("event_ts"), canonical_json(meta).alias("metadata"),
    )
    return {
        "cases": rewrite(cases, {"biometrics_purged": purged_flag}),
        "analyses": rewrite(
            analyses,
            {"document_image_path": swap("document_image_path"), "face_image_path": swap("face_image_path"),
             "biometrics_purged": purged_flag},
        ),
        "gallery": gallery.join(listed.select("case_id"), "case_id", "left_anti"),
        "artefacts": artefacts,
        "events": events,
    }


def delete_cases(doomed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove the listed cases from every table that carries case_id.

    The ids are hashed in each task, as a merge would sort every table's rows for one look
    at them. Rows are dealt by a fixed number of parts: re-planning would put parts
    together whose few bytes stand for very many narrow rows. An anti join would slip
    below the dealing, so listed rows are marked and left out.
    """
    listed = doomed.select("case_id").distinct().withColumn("_listed", F.lit(True)).hint("shuffle_hash")

    def rest(df: DataFrame) -> DataFrame:
        return spread(df, "case_id").join(listed, "case_id", "left").where(F.col("_listed").isNull()).select(*df.columns)

    return {name: rest(df) for name, df in tables.items()}


def deletion_impact(ledger: DataFrame, doomed: DataFrame) -> DataFrame:
    """Blocks whose link breaks once the listed cases' blocks are gone."""
    rest = ledger.join(doomed.select("case_id").distinct(), "case_id", "left_anti")
    broken = block_status(rest, ["case_id"]).where("break_reason is not null")
    return broken.select("chain_id", "seq", "case_id", "position", "break_reason")


def apply_decisions(cases: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest valid decision per case; also the rejected rows and the events.

    ``decisions``: case_id, decision, notes, officer, decided_at, decision_seq.
    """
    valid = F.col("decision").isin(*fixed.OFFICER_DECISIONS)
    rejects = decisions.where(~F.coalesce(valid, F.lit(False)))
    accepted = decisions.where(valid)
    latest = accepted.groupBy("case_id").agg(
        F.max_by(F.struct("decision", "notes"), F.struct("decided_at", "decision_seq")).alias("d")
    )
    made = F.col("d").isNotNull()
    new = {
        "officer_decision": F.coalesce(F.col("d.decision"), F.col("officer_decision")),
        "status": F.coalesce(F.col("d.decision"), F.col("status")),
        "officer_notes": F.when(made, F.col("d.notes")).otherwise(
            F.col("officer_notes") if "officer_notes" in cases.columns else F.lit(None).cast("string")
        ),
    }
    updated = cases.join(latest, "case_id", "left").withColumns(new).drop("d")
    meta = F.create_map(F.lit("decision"), F.col("decision"), F.lit("notes"), F.col("notes"))
    events = accepted.join(cases.select("case_id"), "case_id", "left_semi").select(
        "case_id", F.lit("OFFICER_DECISION_RECORDED").alias("action"), F.col("officer").alias("actor"),
        F.col("decided_at").alias("event_ts"), canonical_json(meta).alias("metadata"),
    )
    return updated, rejects, events


def backfill_case_fields(cases: DataFrame, read: DataFrame) -> DataFrame:
    """Country from the zone where unknown; hashed number from the zone, else the print.

    ``read``: case_id, mrz_country, mrz_number, ocr_number.
    """
    unknown = F.coalesce("country", F.lit("")).isin("", "Unknown")
    found = blank_to_null(F.col("mrz_country"))
    number = F.coalesce(blank_to_null(F.col("mrz_number")), blank_to_null(F.col("ocr_number")))
    prior = F.col("document_number_hash") if "document_number_hash" in cases.columns else F.lit(None).cast("string")
    return (
        cases.join(read, "case_id", "left")
        .withColumn("country", F.when(unknown & found.isNotNull(), found).otherwise(F.col("country")))
        .withColumn("document_number_hash", F.when(number.isNotNull(), hash_identifier(number)).otherwise(prior))
        .drop("mrz_country", "mrz_number", "ocr_number")
    )


def case_number(number: Column, prefix: str = "CS-2026-", width: int = 5) -> Column:
    """A human number: padded to ``width`` digits, and as long as it is beyond them (``lpad`` would cut it)."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def assign_case_numbers(
    new: DataFrame, existing: DataFrame, key: str = "case_id", prefix: str = "CS-2026-", width: int = 5,
) -> DataFrame:
    """Consecutive human numbers after the largest existing one with the prefix."""
    digits = F.try_to_number(
        F.regexp_extract("case_number", f"^{prefix}([0-9]+)$", 1), F.lit("9" * 18)
    ).cast("long")
    last = existing.agg(F.coalesce(F.max(digits), F.lit(0)).alias("_last"), F.lit(1).alias("_one"))
    rows = numbered(
        new.withColumn("_h", stable_hash(F.col(key))), [], ["_h", key], F.substring("_h", 1, 3), "_no"
    ).drop("_h")
    # The right side is a one-row aggregate.
    return (
        rows.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one")
        .withColumn("case_number", case_number(F.col("_no") + F.col("_last"), prefix, width))
        .drop("_one", "_last", "_no")
    )


def duplicate_case_numbers(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_number").agg(F.count("*").alias("n")).where("n > 1")


def stuck_cases(cases: DataFrame, audit: DataFrame) -> DataFrame:
    """Cases still PROCESSING that never reached a score."""
    scored = audit.where(F.col("action") == "RISK_CALCULATED").select("case_id").distinct()
    return cases.where(F.col("status") == "PROCESSING").join(scored, "case_id", "left_anti").select("case_id")


def drop_stuck_cases(cases: DataFrame, audit: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return delete_cases(stuck_cases(cases, audit), {"cases": cases, "audit": audit, **children})


def encrypt_embeddings(gallery: DataFrame, key: Column, vector: str = "embedding") -> DataFrame:
    """Embeddings as AES-GCM blobs; each row gets its own random nonce."""
    return gallery.withColumn(vector, F.aes_encrypt(F.to_json(vector).cast("binary"), key, F.lit("GCM")))


def decrypt_embeddings(gallery: DataFrame, key: Column, vector: str = "embedding", kind: str = "array<float>") -> DataFrame:
    """The vectors back; a blob that fails authentication becomes NULL."""
    text = F.try_aes_decrypt(F.col(vector), key, F.lit("GCM")).cast("string")
    return gallery.withColumn(vector, F.from_json(text, kind))
