"""Image manifests: paths, identities, uploads and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed

FGNET_NAME = r"^(\d{3})[Aa](\d{2})"
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|bmp)$"


def image_paths(spark: SparkSession, root: str, glob: str = "*", content: bool = False) -> DataFrame:
    """Path, size and optionally bytes of image files; bytes are not read unless asked for."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    )
    columns = ["path", F.col("length").alias("file_size")] + (["content"] if content else [])
    return files.select(*columns)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(name), r"[^.](\.[^.]+)$", 1))


def identity_manifest(fgnet: DataFrame, folders: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, identity) from three layouts: coded names, folder names, a CSV table.

    ``fgnet``/``folders``: path. ``metadata``: file_name, identity.
    """
    name = file_name(F.col("path"))
    coded = fgnet.where(F.upper(name).endswith(".JPG")).select(
        "path", F.regexp_extract(name, FGNET_NAME, 1).alias("id")
    )
    by_name = coded.where("id <> ''").select("path", F.concat(F.lit("FGNET:"), F.col("id")).alias("identity"))
    parent = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    by_folder = folders.where(name.rlike(IMAGE_SUFFIX)).select(
        "path", F.concat(F.lit("YLFW:"), parent).alias("identity")
    )
    by_table = metadata.select(
        F.col("file_name").alias("path"), F.concat(F.lit("CALFW:"), F.col("identity")).alias("identity")
    )
    return by_name.unionByName(by_folder).unionByName(by_table)


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("file_name string, identity string").csv(path)


def content_format(content: Column) -> Column:
    """Real image format from the leading bytes; NULL when it is no known image."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("89504E470D0A1A0A"), "PNG")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
        .when(head.startswith("47494638"), "GIF")
    )


def upload_manifest(files: DataFrame) -> DataFrame:
    """Accept or quarantine uploads with the first reason that applies.

    ``files``: filename, file_size, content (the first 12 bytes are enough).
    """
    ext, found = suffix(F.col("filename")), content_format(F.col("content"))
    reason = (
        F.when(~ext.isin(*fixed.IMAGE_EXTENSIONS), "EXTENSION")
        .when(F.col("file_size") > fixed.MAX_IMAGE_BYTES, "TOO_LARGE")
        .when(F.col("file_size") == 0, "EMPTY")
        .when(found.isNull(), "NOT_AN_IMAGE")
        .when(~found.isin("JPEG", "PNG", "WEBP"), "FORMAT")
    )
    return files.select(
        "filename", "file_size", ext.alias("extension"), found.alias("format"),
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


_FLAG = "struct<fraud_type:string,is_fraud:string,fraud:string>"


def image_labels(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Fraud label per image from its sidecar JSON, else from its path.

    ``images``: path. ``sidecars``: stem, meta (JSON text). A sidecar that cannot
    be read counts as not fraud.
    """
    stem = F.regexp_replace(file_name(F.col("path")), r"(.)\.[^.]*$", "$1")
    truthy = lambda c: F.coalesce(~F.lower(c).isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))
    flags = F.from_json("meta", _FLAG)
    flagged = truthy(flags["fraud_type"]) | truthy(flags["is_fraud"]) | truthy(flags["fraud"])
    by_path = F.lower("path").rlike("fraud|forg")
    joined = images.withColumn("stem", stem).join(sidecars.select("stem", "meta"), "stem", "left")
    return joined.select(
        "path", F.col("meta").isNotNull().alias("has_sidecar"),
        F.when(F.col("meta").isNotNull(), flagged).otherwise(by_path).alias("is_fraud"),
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count_if("is_fraud").alias("fraud_images"), F.count_if(~F.col("is_fraud")).alias("authentic_images")
    )
