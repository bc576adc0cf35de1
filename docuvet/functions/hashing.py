"""Identifier and ledger hashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from .fixed import GENESIS, SYSTEM_CASE
from .text import alnum_upper


def hash_identifier(identifier: Column) -> Column:
    """SHA-256 of the letters and digits; the empty identifier stays empty."""
    return F.when(
        F.coalesce(identifier, F.lit("")) == "", F.lit("")
    ).otherwise(F.sha2(alnum_upper(identifier), 256))


def canonical_json(entries: Column) -> Column:
    """Sorted-key, space-free JSON of a flat ``map<string,string>``.

    NULL and empty maps give ``{}``; non-ASCII characters are escaped as UTF-16
    units, as the stored hashes expect.
    """
    # to_json keeps insertion order, so sorting the entries sorts the keys.
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
    units = lambda ch: F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    escaped = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(ch.rlike(r"^[\x00-\x7F]*$"), ch).otherwise(
                F.regexp_replace(units(ch), "(.{4})", r"\\u$1")
            ),
        ),
        "",
    )
    ascii_safe = F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, F.lit("{}")).otherwise(ascii_safe)


def _sorted_keys():
    """The rewriting of JSON texts, as a closure that travels with its tasks."""

    def rewrite(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        return json.dumps(value, sort_keys=True, separators=(",", ":")) if value else "{}"

    return lambda texts: pd.Series([rewrite(t) for t in texts], dtype=object)


def canonical_json_text(text: Column) -> Column:
    """JSON text of any depth with sorted keys on every level, no spaces and non-ASCII characters escaped.

    NULL, empty text and empty objects give ``{}``; text that is not JSON gives NULL. Depth
    and keys differ from row to row, which no expression can follow, so rows are rewritten
    in Arrow batches. Numbers keep their value in the shortest form that reads back alike.
    """
    return F.pandas_udf(_sorted_keys(), "string")(text.cast("string"))


def canonical_json_of(value: Column) -> Column:
    """Canonical JSON of nested structs, arrays and maps; missing fields are ``null``.

    Times print with their fraction unless it is zero (also in a text that looks just like one).
    """
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"}
    text = F.regexp_replace(F.to_json(value, options), r'"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\.000000"', '"$1"')
    return F.when(value.isNull(), "{}").otherwise(canonical_json_text(text))


def iso_timestamp(ts: Column) -> Column:
    """ISO text; the fraction is printed only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.when(micros == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )


def payload_tail(case_id: Column, action: Column, actor: Column, ts: Column, metadata: Column) -> Column:
    """Everything of a block that does not depend on its predecessor.

    Each part is coalesced first: ``concat_ws`` skips NULLs and would shift fields.
    """
    case_text = F.coalesce(F.nullif(case_id.cast("string"), F.lit("")), F.lit(SYSTEM_CASE))
    meta = F.coalesce(F.nullif(metadata, F.lit("")), F.lit("{}"))
    return F.concat_ws(
        "|",
        case_text,
        F.coalesce(action, F.lit("")),
        F.coalesce(actor, F.lit("")),
        F.coalesce(iso_timestamp(ts), F.lit("")),
        meta,
    )


def block_hash(previous: Column, tail: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.nullif(previous, F.lit("")), F.lit(GENESIS)), tail), 256)
