"""Training-set preparation: shares, splits, labels and patch manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import hash_number, numbered, shuffled, stable_hash

PATCH = 64
#: Identities that the order of all of them is cut at, and the sample they come from.
CUTS = 256
CUT_SAMPLE = 4096


def present_shares(rows: DataFrame, shares: dict[str, float], domain: str = "domain") -> dict[str, float]:
    """The shares of listed domains that have rows, scaled to a sum of one. Reads back one row per listed domain."""
    found = {r[0] for r in rows.where(F.col(domain).isin(list(shares))).select(domain).distinct().collect()}
    total = sum(share for name, share in shares.items() if name in found)
    return {name: share / total for name, share in shares.items() if name in found and share > 0} if total else {}


def domain_weights(rows: DataFrame, shares: dict[str, float], domain: str = "domain") -> DataFrame:
    """Sampling weight of every row: its domain's share over the domain's size.

    Shares are those among the listed domains that have rows; unlisted domains weigh 0.
    """
    shares = present_shares(rows, shares, domain)
    counts = rows.groupBy(domain).agg(F.count("*").alias("_n"))
    if not shares:
        return rows.withColumn("weight", F.lit(0.0))
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(domain)]
    sized = counts.select(domain, (F.coalesce(share, F.lit(0.0)) / F.col("_n")).alias("weight"))
    return rows.join(sized, domain)


def domain_balanced_sample(
    rows: DataFrame, shares: dict[str, float], n: int, seed: int = 42, key: str = "id", domain: str = "domain",
) -> DataFrame:
    """Draw ``n`` rows with replacement so that domains appear by their shares.

    Each draw hashes to a domain and then to a position in it. Positions come from
    bucketed numbering, so the largest domain is not sorted by one task, and the
    same seed gives the same sample on any cluster. Shares are those among the listed
    domains that have rows, so every draw finds one; unlisted domains are never drawn.
    """
    shares = present_shares(rows, shares, domain)
    if not shares:
        return rows.limit(0).withColumn("draw", F.lit(0).cast("long"))
    placed = shuffled(rows, [domain], key, seed, "_pos")
    counts = rows.groupBy(domain).agg(F.count("*").alias("_n"))
    spin = hash_number(stable_hash(seed, "domain", F.col("draw"))) / F.lit(float(1 << 60))
    reached, chosen = 0.0, None
    for name, share in shares.items():
        reached += share
        cond = spin < F.lit(reached)
        chosen = F.when(cond, name) if chosen is None else chosen.when(cond, name)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn(
        domain, chosen.otherwise(list(shares)[-1])
    )
    at = F.pmod(hash_number(stable_hash(seed, "row", F.col("draw"))), F.col("_n")) + 1
    return (
        draws.join(counts, domain)
        .withColumn("_pos", at)
        .drop("_n")
        .join(placed, [domain, "_pos"])
        .drop("_pos")
    )


def train_val_split(rows: DataFrame, fraction: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Mark exactly ``floor(fraction * n)`` rows as validation, by seeded hash order."""
    placed = shuffled(rows.withColumn("_one", F.lit(1)), [], key, seed, "_pos")
    size = rows.agg((F.count("*") * F.lit(fraction)).cast("long").alias("_val"), F.lit(1).alias("_one"))
    return (
        # The right side is a one-row aggregate.
        placed.join(F.broadcast(size), "_one")
        .withColumn("split", F.when(F.col("_pos") <= F.col("_val"), "val").otherwise("train"))
        .drop("_pos", "_val", "_one")
    )


def identity_labels(images: DataFrame, min_images: int = 2, identity: str = "identity") -> DataFrame:
    """Dense label ids in sorted identity order; too small identities are dropped.

    Works on one row per identity. The order is cut at identities taken from a bounded
    sample, so stretches are about equal whatever the names look like, and no window
    spans all identities.
    """
    sizes = images.groupBy(identity).agg(F.count("*").alias("n_images"))
    kept = sizes.where(F.col("n_images") >= min_images)
    spread = kept.select(identity).orderBy(F.xxhash64(identity)).limit(CUT_SAMPLE).toPandas()[identity].sort_values()
    cuts = spread.iloc[:: max(1, len(spread) // CUTS)].tolist()
    stretch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(identity))) if cuts else F.lit(0)
    labelled = numbered(kept, [], [identity], stretch, "label")
    return labelled.select(identity, "n_images", (F.col("label") - 1).alias("label"))


def identity_report(images: DataFrame, min_images: int = 2, identity: str = "identity") -> DataFrame:
    """Per source: identities and images kept and dropped."""
    sizes = images.groupBy(identity).agg(F.count("*").alias("n"))
    small = F.col("n") < min_images
    return sizes.groupBy(F.substring_index(identity, ":", 1).alias("source")).agg(
        F.count_if(~small).alias("identities"),
        F.sum(F.when(~small, F.col("n")).otherwise(0)).alias("images"),
        F.count_if(small).alias("dropped_identities"),
        F.sum(F.when(small, F.col("n")).otherwise(0)).alias("dropped_images"),
    )


def per_identity_holdout(
    images: DataFrame, fraction: float = 0.15, seed: int = 42, identity: str = "identity", key: str = "path",
) -> DataFrame:
    """Per identity, ``max(1, floor(fraction * n))`` images held out when n > 3."""
    placed = shuffled(images, [identity], key, seed, "_pos", digits=1)
    sizes = images.groupBy(identity).agg(F.count("*").alias("_n"))
    held = F.when(
        F.col("_n") > 3, F.greatest(F.lit(1), (F.col("_n") * F.lit(fraction)).cast("long"))
    ).otherwise(F.lit(0))
    return (
        placed.join(sizes, identity)
        .withColumn("split", F.when(F.col("_pos") <= held, "val").otherwise("train"))
        .drop("_pos", "_n")
    )


def group_accuracy(scored: DataFrame, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Accuracy per domain (NULL for an empty one) and overall."""
    right = F.when(F.col("predicted") == F.col("y"), 1).otherwise(0)
    per = scored.groupBy(domain).agg(F.sum(right).alias("right"), F.count("*").alias("n"))
    rows = domains.select(domain).distinct().join(per, domain, "left")
    overall = per.agg(F.lit("OVERALL").alias(domain), F.sum("right").alias("right"), F.sum("n").alias("n"))
    return rows.unionByName(overall).select(
        domain, F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n") > 0, F.col("right") / F.col("n")).alias("accuracy"),
    )


def patch_manifest(
    images: DataFrame, inside: int = 4, outside: int = 2, seed: int = 42, key: str = "image",
) -> DataFrame:
    """Patch corners and labels per image.

    ``images``: key, img_w, img_h and the tampered box x, y, w, h (NULL when it is
    not known). Known box: ``inside`` patches in it labelled 1, and up to
    ``outside`` elsewhere labelled 0, tried at most five times as often. Unknown
    box: ``inside`` patches anywhere carry the weak label 1. ``forged`` false
    (optional column) gives ``inside`` patches labelled 0.
    """
    forged = F.col("forged") if "forged" in images.columns else F.lit(True)
    known = forged & F.col("x").isNotNull()
    # Draws are rows before they are hashed: one digest each, in generated code. The
    # first digits of it place x, the next ones y.
    draws = F.array(*[F.struct(F.lit("in").alias("kind"), F.lit(i).alias("no")) for i in range(1, inside + 1)],
                    *[F.struct(F.lit("out").alias("kind"), F.lit(i).alias("no")) for i in range(1, outside * 5 + 1)])
    box = [c for c in ("x", "y", "w", "h", "forged") if c in images.columns]
    drawn = (
        images.select(key, "img_w", "img_h", *box, F.explode(draws).alias("d"))
        .where((F.col("d.kind") == "in") | known)
        .withColumn("digest", stable_hash(seed, F.col(key), F.col("d.kind"), F.col("d.no")))
    )
    number = lambda first: F.conv(F.substring("digest", first, 15), 16, 10).cast("long")

    def within(first: int, span: Column) -> Column:
        # Uniform over 0 .. max(1, span - 1), both ends included.
        return F.pmod(number(first), F.greatest(F.lit(1), span - 1) + 1)

    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    out = F.col("d.kind") == "out"
    placed = drawn.withColumns({
        "cx": F.when(out, F.pmod(number(1), F.col("img_w"))).when(known, x + within(1, w)).otherwise(within(1, F.col("img_w"))),
        "cy": F.when(out, F.pmod(number(16), F.col("img_h"))).when(known, y + within(16, h)).otherwise(within(16, F.col("img_h"))),
    }).where(~out | ~(F.col("cx").between(x, x + w) & F.col("cy").between(y, y + h)))
    # A handful of draws per image: fold them back to number the free ones.
    corner = lambda at, size: F.greatest(F.lit(0), F.least(size - PATCH, at - PATCH // 2)).cast("long")
    patch = F.struct(
        out.alias("out"), F.col("d.no").alias("no"), corner(F.col("cx"), F.col("img_w")).alias("patch_x"),
        corner(F.col("cy"), F.col("img_h")).alias("patch_y"),
        F.when(out, 0).when(known, 1).otherwise(forged.cast("int")).alias("label"),
        F.when(out, "OUTSIDE").when(known, "INSIDE").when(forged, "WEAK").otherwise("REAL").alias("origin"))
    folded = placed.groupBy(key).agg(F.array_sort(F.collect_list(patch)).alias("p"))
    return folded.select(key, F.posexplode(F.slice("p", 1, inside + outside)).alias("pos", "p")).select(
        key, (F.col("pos") + 1).alias("patch_no"), "p.patch_x", "p.patch_y", "p.label", "p.origin")
