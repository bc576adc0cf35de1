"""Fuzzy and phonetic matching as blocked equi-joins."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.dates import yymmdd
from ..functions.phonetic import metaphone
from ..functions.text import alnum_upper, blank_to_null, deletions, fuzzy_equal, within_one_edit
from ..session import materialize, spread
from .ranking import numbered

#: Versions of one identity that are numbered together.
SUBMISSION_STRETCH = 1024

_EVIDENCE = "struct<method:string,query_token:string,matched_token:string,edit_distance:int>"


def clean_query_name(name: Column) -> Column:
    """Screened names keep letters and white space only."""
    return F.trim(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z\s]", "")))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.upper(name)), r"\s+"), lambda t: t != "")


def _coded(tokens: Column) -> Column:
    """Tokens with their phonetic codes, computed once per name."""
    return F.transform(
        tokens, lambda t: F.struct(t.alias("t"), F.soundex(t).alias("s"), metaphone(t).alias("m"))
    )


def _method(a: Column, b: Column) -> Column:
    """How two coded tokens match, strongest reading first; NULL if they do not."""
    la, lb = F.length(a["t"]), F.length(b["t"])
    sound = (la >= 3) & (lb >= 3) & (F.abs(la - lb) <= 3)
    return (
        F.when(a["t"] == b["t"], "EXACT")
        .when((la >= 4) & (lb >= 4) & within_one_edit(a["t"], b["t"]), "EDIT_DISTANCE")
        .when(sound & (a["s"] == b["s"]), "SOUNDEX")
        .when(sound & (a["m"] == b["m"]), "METAPHONE")
    )


def _keys(token: Column) -> Column:
    """Join keys: two tokens that match by any reading share at least one."""
    t = token["t"]
    edits = F.when(F.length(t) >= 4, deletions(t)).otherwise(F.array(t))
    sounds = F.when(
        F.length(t) >= 3,
        F.array(F.concat(F.lit("S:"), token["s"]), F.concat(F.lit("M:"), token["m"])),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(edits, lambda k: F.concat(F.lit("D:"), k)), sounds)


def token_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matching pairs of two token tables ``(token)``, with method and distance.

    Only distinct tokens are joined, and only through shared keys.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.upper("token").alias("t")).where("t <> ''").distinct()
        coded = one.select(F.get(_coded(F.array("t")), F.lit(0)).alias(name))
        return coded.select(name, F.explode(_keys(F.col(name))).alias("key"))

    pairs = keyed(left, "a").join(keyed(right, "b"), "key").withColumn("method", _method(F.col("a"), F.col("b")))
    distance = F.when(F.col("method") == "EXACT", 0).when(F.col("method") == "EDIT_DISTANCE", 1)
    return (
        pairs.where(F.col("method").isNotNull())
        .select(F.col("a.t").alias("token_a"), F.col("b.t").alias("token_b"), "method", distance.alias("edit_distance"))
        .distinct()
    )


def _entry_evidence(entry: Column, query: Column) -> Column:
    """Per entry token: the exact match if there is one, else the first match."""

    def best(e: Column) -> Column:
        read = F.transform(query, lambda q: F.struct(_method(e, q).alias("method"), q["t"].alias("query_token")))
        found = F.filter(read, lambda m: m["method"].isNotNull())
        exact = F.filter(found, lambda m: m["method"] == "EXACT")
        return F.struct(F.coalesce(F.get(exact, F.lit(0)), F.get(found, F.lit(0))).alias("m"), e["t"].alias("t"))

    def shown(b: Column) -> Column:
        method = b["m"]["method"]
        return F.struct(
            method.alias("method"), b["m"]["query_token"].alias("query_token"), b["t"].alias("matched_token"),
            F.when(method == "EXACT", 0).when(method == "EDIT_DISTANCE", 1).alias("edit_distance"),
        ).cast(_EVIDENCE)

    return F.transform(F.transform(entry, best), shown)


def _covered(entry: Column, query: Column) -> Column:
    return F.forall(entry, lambda e: F.exists(query, lambda q: _method(e, q).isNotNull()))


def _coded_names(names: DataFrame, name: str, coded: str) -> DataFrame:
    """Distinct names with their coded tokens. Names are few bytes and much work: all tasks get some."""
    rows = spread(names.select(F.col("name").alias(name)), name).distinct().where(F.size(name_tokens(F.col(name))) > 0)
    return rows.withColumn(coded, _coded(name_tokens(F.col(name))))


def _entry_keys(e: DataFrame) -> DataFrame:
    return e.select("entry_name", F.posexplode("e").alias("pos", "tok")).select(
        "entry_name", "pos", F.explode(_keys(F.col("tok"))).alias("key"))


def _reached(e: DataFrame, e_keys: DataFrame, q: DataFrame) -> DataFrame:
    """Matching pairs of distinct names: ``(entry_name, query_name, e, q)``.

    Every entry token has to match, so an entry can be reached through any one of
    its tokens. It is reached through the one whose keys are rarest among the
    queries; common tokens then only verify and never generate pairs. Key counts
    are map-side combined, so a key held by a third of all names stays one row.
    Query names are coded once and written; pairs are dealt to all tasks before they
    are verified.
    """
    q = materialize(q, "coded-names")
    q_keys = q.select("query_name", F.explode(F.array_distinct(F.flatten(F.transform("q", _keys)))).alias("key"))
    counts = q_keys.groupBy("key").agg(F.count("*").alias("n"))
    cost = (
        e_keys.join(counts, "key", "left")
        .groupBy("entry_name", "pos")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
        .groupBy("entry_name")
        .agg(F.min_by("pos", F.struct("cost", "pos")).alias("anchor"))
    )
    anchored = e.join(cost, "entry_name").select(
        "entry_name", "e", F.explode(_keys(F.get("e", F.col("anchor")))).alias("key")
    )
    reached = (
        spread(anchored.select("entry_name", "key"))
        .join(q_keys, "key")
        .select("entry_name", "query_name")
        .distinct()
    )
    return (
        spread(reached, "query_name").join(e, "entry_name").join(spread(q, "query_name"), "query_name")
        .where(_covered(F.col("e"), F.col("q")))
    )


def _name_candidates(entries: DataFrame, queries: DataFrame) -> DataFrame:
    e = _coded_names(entries, "entry_name", "e")
    return _reached(e, _entry_keys(e), _coded_names(queries, "query_name", "q"))


def name_match(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of distinct names in which every entry token finds a query token.

    The distinct names of both sides are written once: several joins read them, and their
    filters are not to sink into what the names come from.
    """
    once = lambda name, df, side: materialize(df.select(name.alias("name")).distinct(), f"{side}-names")
    pairs = _name_candidates(once(F.col("name"), entries, "entry"), once(clean_query_name(F.col("name")), queries, "query"))
    return pairs.select("entry_name", "query_name", _entry_evidence(F.col("e"), F.col("q")).alias("match_evidence"))


def _number_keys(df: DataFrame, name: str) -> DataFrame:
    one = df.select(F.col("number").alias(name)).where(F.col(name) != "").distinct()
    keys = F.when(F.length(name) >= 6, deletions(F.col(name))).otherwise(F.array(name))
    return one.select(name, F.explode(keys).alias("key"))


def _equal_numbers(entry_keys: DataFrame, query_keys: DataFrame) -> DataFrame:
    pairs = entry_keys.join(query_keys, "key")
    same = F.col("entry_number") == F.col("query_number")
    return (
        pairs.where(same | fuzzy_equal(F.col("entry_number"), F.col("query_number")))
        .select("entry_number", "query_number")
        .distinct()
    )


def number_match(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of distinct cleaned numbers that are equal or one misread apart.

    Equality has no length limit; one edit needs six characters on both sides.
    """
    return _equal_numbers(_number_keys(entries, "entry_number"), _number_keys(queries, "query_number"))


def screening_identity(cases: DataFrame) -> DataFrame:
    """Name and number to screen: machine-read first, printed otherwise.

    ``cases``: case_id, mrz struct (may be NULL), full_name, document_number.
    """
    mrz = F.col("mrz")
    read = F.when(
        blank_to_null(mrz["surname"]).isNotNull(),
        F.trim(F.concat_ws(" ", mrz["surname"], F.coalesce(mrz["given_names"], F.lit("")))),
    )
    return cases.select(
        "case_id",
        F.coalesce(read, blank_to_null(F.col("full_name"))).alias("full_name"),
        F.coalesce(blank_to_null(mrz["document_number"]), blank_to_null(F.col("document_number"))).alias("document_number"),
    )


@dataclass
class Watchlist:
    """A version of the watchlist made ready: its active entries, and the keys of their distinct numbers and names."""

    order: str
    active: DataFrame
    number_ranks: DataFrame
    number_keys: DataFrame
    name_ranks: DataFrame
    names: DataFrame
    name_keys: DataFrame


def prepare_watchlist(entries: DataFrame, order: str = "entry_order") -> Watchlist:
    """Everything of a screening that depends on the watchlist alone, written once for any number of screenings."""
    active = materialize(entries.where("active").select(
        order, "watchlist_id", "category", "severity",
        F.col("document_number").alias("entry_document"),
        alnum_upper(F.col("document_number")).alias("entry_number"),
        F.upper("name").alias("entry_name"), F.col("name").alias("listed_name"),
    ), "watchlist-entries")
    number_ranks = active.groupBy("entry_number").agg(F.min(order).alias("rank"))
    name_ranks = active.groupBy("entry_name").agg(F.min(order).alias("rank"))
    names = _coded_names(name_ranks.withColumnRenamed("entry_name", "name"), "entry_name", "e")
    return Watchlist(
        order, active, number_ranks, _number_keys(number_ranks.withColumnRenamed("entry_number", "number"), "entry_number"),
        name_ranks, names, _entry_keys(names))


def keep_prepared(watchlist: Watchlist) -> Watchlist:
    """The same with its keys written too, for a watchlist that many micro-batches meet."""
    staged = {f: materialize(getattr(watchlist, f), f"watchlist-{f.replace('_', '-')}") for f in (
        "number_ranks", "number_keys", "name_ranks", "names", "name_keys")}
    return replace(watchlist, **staged)


def watchlist_screen(cases: DataFrame, entries: DataFrame | Watchlist, order: str = "entry_order") -> DataFrame:
    """The first active entry each case matches, by number or by name.

    Entries count in ``order``; inside one entry the number is tried before the
    name. Matching runs on distinct numbers and distinct names only: each distinct
    value keeps its first entry, however many cases share it, and the hit is
    attached to the cases afterwards. Cleaned cases, entries and the distinct values are
    written once: several joins read them. ``entries`` may come prepared.
    """
    watchlist = entries if isinstance(entries, Watchlist) else prepare_watchlist(entries, order)
    order, active = watchlist.order, watchlist.active
    asked = materialize(cases.select(
        "case_id",
        alnum_upper(F.coalesce("document_number", F.lit(""))).alias("query_number"),
        clean_query_name(F.col("full_name")).alias("query_name"),
    ), "watchlist-asked")
    numbers = materialize(asked.select(F.col("query_number").alias("number")).distinct(), "watchlist-numbers")
    names = materialize(asked.select(F.col("query_name").alias("name")).distinct(), "watchlist-names")
    by_number = (
        _equal_numbers(watchlist.number_keys, _number_keys(numbers, "query_number"))
        .join(watchlist.number_ranks, "entry_number")
        .groupBy("query_number")
        .agg(F.min("rank").alias("number_rank"))
    )
    by_name = (
        _reached(watchlist.names, watchlist.name_keys, _coded_names(names, "query_name", "q"))
        .join(watchlist.name_ranks, "entry_name")
        .groupBy("query_name")
        .agg(F.min_by(F.struct("rank", "e", "q"), "rank").alias("hit"))
        .select(
            "query_name", F.col("hit.rank").alias("name_rank"),
            _entry_evidence(F.col("hit.e"), F.col("hit.q")).alias("name_evidence"),
        )
    )
    # Inner joins drop the cases without a hit before anything is shuffled by case.
    no_evidence = F.lit(None).cast(f"array<{_EVIDENCE}>")
    number_hits = asked.join(by_number, "query_number").select(
        "case_id", F.col("number_rank").alias("rank"), F.lit(0).alias("field"), no_evidence.alias("match_evidence")
    )
    name_hits = asked.join(by_name, "query_name").select(
        "case_id", F.col("name_rank").alias("rank"), F.lit(1).alias("field"), F.col("name_evidence").alias("match_evidence")
    )
    hits = (
        number_hits.unionByName(name_hits)
        .groupBy("case_id")
        .agg(F.min_by(F.struct("rank", "field", "match_evidence"), F.struct("rank", "field")).alias("hit"))
        .select(
            "case_id",
            F.col("hit.rank").alias(order),
            F.when(F.col("hit.field") == 0, "Document Number").otherwise("Full Name").alias("match_field"),
            F.col("hit.match_evidence").alias("match_evidence"),
        )
    )
    return hits.join(
        active.select(order, "watchlist_id", F.col("listed_name").alias("entry_name"), "entry_document", "category", "severity"),
        order,
    )


# --- submissions of one identity ------------------------------------------------


def _consecutive(submissions: DataFrame, key: str, order: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Submissions that have one before them, and those by the position of the next.

    Positions follow ``order``, whatever gaps it has. They are counted in stretches of
    it, so the history of one identity is spread over tasks.
    """
    placed = numbered(submissions.select(*columns), [key], [order], F.floor(F.col(order) / SUBMISSION_STRETCH), "_position")
    return placed.where(F.col("_position") > 1), placed.withColumn("_position", F.col("_position") + 1)


def change_detection(submissions: DataFrame, key: str = "identity_key", order: str = "version") -> DataFrame:
    """Field-by-field difference between consecutive submissions of an identity.

    The previous submission is the one with the next smaller ``order``; a whole number
    that need not be gapless, but differs between an identity's submissions.
    """
    fields = list(fixed.CHANGE_FIELDS)
    keep = [c for c in ("mrz_parsed", "portrait_status") if c in submissions.columns]
    later, earlier = _consecutive(submissions, key, order, [key, order, *keep, *fields])
    later = later.select(key, order, "_position", *keep, F.struct(*fields).alias("v2"))
    parsed = F.col("mrz_parsed") if "mrz_parsed" in keep else F.lit(True)
    earlier = earlier.select(key, "_position", F.struct(*fields).alias("v1"), parsed.alias("v1_parsed"))
    # A pair with an unreadable side is never reported as unchanged.
    pairs = later.join(earlier, [key, "_position"]).where(parsed & F.col("v1_parsed"))

    def shown(field: str, value: Column) -> Column:
        if field not in ("birth_date", "expiry_date"):
            return value
        return F.coalesce(F.date_format(yymmdd(value), "dd/MM/yyyy"), value)

    rows = []
    for field, (label, severity) in fixed.CHANGE_FIELDS.items():
        v1, v2 = F.col(f"v1.{field}"), F.col(f"v2.{field}")
        changed = ~blank_to_null(v1).eqNullSafe(blank_to_null(v2))
        rows.append(
            F.struct(
                F.lit(field).alias("field"), F.lit(label).alias("label"),
                shown(field, v1).alias("v1_value"), shown(field, v2).alias("v2_value"),
                changed.alias("changed"), F.when(changed, severity).otherwise("LOW").alias("severity"),
            )
        )
    if "portrait_status" in keep:
        moved = F.coalesce(F.col("portrait_status") == "PORTRAIT_CHANGED", F.lit(False))
        rows.append(
            F.struct(
                F.lit("portrait").alias("field"), F.lit("Portrait Photo").alias("label"),
                F.lit("See image").alias("v1_value"), F.lit("See image").alias("v2_value"),
                moved.alias("changed"), F.when(moved, "HIGH").otherwise("LOW").alias("severity"),
            )
        )
    return pairs.select(key, order, F.explode(F.array(*rows)).alias("d")).select(key, order, "d.*")


def change_summary(submissions: DataFrame, key: str = "identity_key", order: str = "version") -> DataFrame:
    """Changed fields per pair; a pair with an unreadable zone is unverifiable."""
    diffs = change_detection(submissions, key, order)
    position = {name: i for i, name in enumerate([*fixed.CHANGE_FIELDS, "portrait"])}
    rank = F.create_map(*[F.lit(x) for kv in position.items() for x in kv])[F.col("field")]
    # At most nine fields per pair, so the list is bounded by the schema.
    labels = F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct(rank.alias("i"), "label"))))
    changed = diffs.groupBy(key, order).agg(
        F.count_if("changed").alias("changed_field_count"),
        F.transform(labels, lambda x: x["label"]).alias("changed_fields"),
    )
    pairs = _consecutive(submissions, key, order, [key, order])[0].select(key, order)
    return pairs.join(changed, [key, order], "left").select(
        key, order,
        F.when(F.col("changed_field_count").isNull(), "UNVERIFIABLE")
        .when(F.col("changed_field_count") > 0, "CHANGED").otherwise("UNCHANGED").alias("status"),
        "changed_field_count", "changed_fields",
    )
