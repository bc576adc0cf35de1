"""Nested region annotations as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ANNOTATION = (
    "struct<_via_img_metadata:map<string,struct<filename:string,regions:array<struct<"
    "shape_attributes:struct<x:int,y:int,width:int,height:int>,"
    "region_attributes:struct<field_name:string,value:string>>>>>>"
)


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """One row per annotation file: doctype (the file's stem) and its JSON text."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return files.select(stem.alias("doctype"), F.col("value").alias("annotation_json"))


def via_regions(files: DataFrame) -> DataFrame:
    """One row per annotated region."""
    images = files.select(
        "doctype", F.explode(F.from_json("annotation_json", ANNOTATION)["_via_img_metadata"]).alias("key", "img")
    )
    return images.select("doctype", "key", "img.filename", F.explode("img.regions").alias("r")).select(
        "doctype", "key", "filename",
        F.col("r.region_attributes.field_name").alias("field"),
        F.col("r.region_attributes.value").alias("value"),
        F.col("r.shape_attributes.x").alias("x"), F.col("r.shape_attributes.y").alias("y"),
        F.col("r.shape_attributes.width").alias("w"), F.col("r.shape_attributes.height").alias("h"),
    )


def via_annotations(files: DataFrame, fields: list[str]) -> DataFrame:
    """One row per image with a column per listed field; the last region of a field wins.

    An image's regions lie in its own array, so the pivot is a lookup in the row
    and needs no shuffle.
    """
    images = files.select(
        "doctype", F.explode(F.from_json("annotation_json", ANNOTATION)["_via_img_metadata"]).alias("key", "img")
    )

    def value_of(field: str):
        hits = F.filter("img.regions", lambda r: r["region_attributes"]["field_name"] == field)
        return F.try_element_at(hits, F.lit(-1))["region_attributes"]["value"].alias(field)

    return images.select("doctype", F.col("img.filename").alias("filename"), *[value_of(f) for f in fields])


def resolve_tamper_regions(forgeries: DataFrame, regions: DataFrame) -> DataFrame:
    """The box of each forged field in its source image; unresolved ones are weak labels.

    ``forgeries``: image, src, field. Adds x, y, w, h (NULL when unresolved), resolved.
    """
    pattern = r"^(.+)_(\d+)\.jpg$"
    named = F.coalesce((F.col("src") != "None") & (F.col("field") != "None") & (F.col("field") != ""), F.lit(False))
    part = lambda g: F.when(named, F.nullif(F.regexp_extract("src", pattern, g), F.lit("")))
    asked = forgeries.withColumns({"_type": part(1), "_index": part(2)})
    boxes = regions.groupBy(
        F.col("doctype").alias("_type"), F.regexp_extract("key", r"^(\d+)\.jpg", 1).alias("_index"), F.col("field")
    ).agg(F.min(F.struct("x", "y", "w", "h")).alias("box"))
    return (
        asked.join(boxes, ["_type", "_index", "field"], "left")
        .select(*forgeries.columns, "box.x", "box.y", "box.w", "box.h", F.col("box").isNotNull().alias("resolved"))
    )


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved")
    )
