"""Typed loading and idempotent writing of the case store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVIDENCE = (
    "struct<measured_value:string,threshold_value:string,unit:string,region:array<int>,region_source:string,"
    "match:array<struct<method:string,query_token:string,matched_token:string,edit_distance:int>>>"
)
OCR_FIELDS = (
    "struct<full_name:string,document_number:string,nationality:string,country:string,date_of_birth:string,"
    "date_of_issue:string,date_of_expiry:string,sex:string,document_type:string,visa_type:string,"
    "entry_validation:string,stay_duration_until:string,permit_type:string,issuing_authority:string>"
)
BREAKDOWN = "array<struct<factor:string,weight:double,raw_risk:double,weighted_contribution:double>>"

# Column types of the case store; JSON columns arrive as text and are typed below.
TABLES = {
    "cases": "case_id bigint, case_number string, created_at timestamp, document_type string, "
             "document_number_hash string, country string, risk_score double, risk_level string, "
             "recommendation string, status string, officer_decision string, officer_notes string, "
             "biometrics_purged boolean",
    "document_analysis": "case_id bigint, document_image_path string, face_image_path string, ocr_result string, "
                         "mrz_result string, validation_result string, tamper_result string, face_result string, "
                         "risk_breakdown string, processing_time_ms double, biometrics_purged boolean",
    "risk_checks": "case_id bigint, check_key string, category string, factor string, label string, status string, "
                   "severity string, confidence double, explanation string, evidence string, score_impact double",
    "audit_logs": "seq bigint, chain_id bigint, case_id bigint, action string, actor string, event_ts timestamp, "
                  "metadata string, previous_hash string, entry_hash string",
    "blockchain_anchors": "anchor_id bigint, chain_id bigint, head_hash string, total_records bigint, network string, "
                          "tx_hash string, created_epoch bigint",
    "face_embedding_gallery": "case_id bigint, case_number string, full_name string, document_number_hash string, "
                              "embedding array<float>, created_at timestamp",
    "watchlist_entries": "entry_order bigint, watchlist_id string, name string, document_number string, "
                         "category string, reason string, severity string, active boolean",
    "policy_settings": "policy_id bigint, weight_mrz double, weight_tamper double, weight_face double, "
                       "weight_consistency double, weight_watchlist double, threshold_low double, "
                       "threshold_medium double, threshold_high double, updated_at timestamp",
}
JSON_COLUMNS = {
    "document_analysis": {
        "ocr_result": f"struct<raw_text:string,fields:{OCR_FIELDS},confidence:double,"
                      "detected_lines:array<string>,mrz_lines:array<string>>",
        "mrz_result": "struct<format:string,line1:string,line2:string,line3:string,document_type:string,"
                      "country:string,surname:string,given_names:string,document_number:string,nationality:string,"
                      "birth_date:string,sex:string,expiry_date:string,optional_data:string,"
                      "checksums:array<struct<field:string,value:string,check_digit:string,"
                      "calculated_check_digit:string,valid:boolean>>,is_valid:boolean>",
        "tamper_result": "struct<tamper_risk:double,risk_level:string>",
        "face_result": "struct<similarity:double,status:string,live_embedding:array<float>>",
        "risk_breakdown": BREAKDOWN,
    },
    "risk_checks": {"evidence": EVIDENCE},
}


def typed_json(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace JSON text columns by their declared types; nothing is inferred."""
    return df.withColumns({name: F.from_json(name, kind) for name, kind in columns.items()})


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One store table with its fixed schema. Ledger metadata stays text: hashes cover its bytes."""
    raw = spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")
    return typed_json(raw, JSON_COLUMNS.get(name, {}))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Add rows with new keys; present rows are never changed or repeated.

    Of incoming rows with one key the first in ``order`` is taken.
    """
    columns = existing.columns
    order = order or next(c for c in columns if c != key)
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(order)).alias("r")).select("r.*")
    fresh = first.join(existing.select(key), key, "left_anti").select(*columns)
    return existing.unionByName(fresh)


def replace_per_case(existing: DataFrame, new: DataFrame, key: str = "case_id") -> DataFrame:
    """All rows of re-evaluated cases are replaced by the new set."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_by_case(df: DataFrame, path: str, buckets: int, files: int = 1, key: str = "case_id") -> None:
    """Write under hash buckets of the case, overwriting only the buckets present.

    ``buckets`` should leave a few gigabytes in each; ``files`` tasks write one bucket.

    Re-running after a lost executor rewrites the same buckets with the same rows.
    """
    bucketed = df.withColumn("case_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (
        bucketed.repartition("case_bucket", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("case_bucket").parquet(path)
    )
