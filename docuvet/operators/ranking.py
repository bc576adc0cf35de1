"""Exact positions over huge or very uneven groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stable_hash(*parts: Column | str | int) -> Column:
    """A hexadecimal digest that any engine reproduces."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary"))


def hash_number(digest: Column) -> Column:
    """The first 60 bits of a digest as a non-negative number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "position") -> DataFrame:
    """1-based position inside ``group`` by (bucket, order).

    ``bucket`` must ascend with ``order``. Windows run inside a bucket, and what
    lies before a bucket comes from one count per bucket, so a group holding a
    third of all rows is numbered by many tasks.
    """
    rows = df.withColumn("_b", bucket)
    by = [*group, "_b"]
    inside = Window.partitionBy(*by).orderBy(*order)
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    offsets = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(offsets, by)
        .withColumn(name, (F.col("_o") + F.col("_r")).cast("long"))
        .select(*df.columns, name)
    )


def shuffled(df: DataFrame, group: list[str], key: str, seed: int | str, name: str = "position", digits: int = 3) -> DataFrame:
    """Positions in a seeded random order that ignores how rows are partitioned."""
    hashed = df.withColumn("_h", stable_hash(seed, F.col(key)))
    return numbered(hashed, group, ["_h", key], F.substring("_h", 1, digits), name).drop("_h")
