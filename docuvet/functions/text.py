"""String expressions shared by extraction and matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .fixed import DATE_PATTERN

# Line terminators, with the white space around them.
_BREAKS = r"(?U)\s*[\n\r\x0B\f\x1C\x1D\x1E\x85  ]\s*"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def alnum_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def body_of(raw: Column) -> Column:
    """Raw text as stripped, non-empty lines joined by single newlines."""
    return F.regexp_replace(F.regexp_replace(raw, _BREAKS, "\n"), r"(?U)^\s+|\s+$", "")


def lines_of(body: Column) -> Column:
    """The lines of a :func:`body_of` text; empty array for an empty text."""
    return F.filter(F.split(body, "\n"), lambda line: line != "")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def value_after_label(body: Column, label: str, unless: tuple[str, ...] = ()) -> Column:
    """The line under the first line that matches ``label``.

    One multi-line regular expression over the whole body instead of a lambda
    over an array of lines: it stays inside generated code. A label on the last
    line has nothing under it and is passed over.
    """
    skip = "".join(f"(?![^\\n]*{word})" for word in unless)
    return first_match(body, rf"(?im)^{skip}[^\n]*?{label}[^\n]*\n([^\n]+)", 1)


def _resembles(word: str):
    budget = 2 if len(word) >= 5 else 1
    return lambda token: F.levenshtein(token, F.lit(word), budget) >= 0


def value_after_fuzzy_label(lines: Column, words: list[str]) -> Column:
    """The line under the first line holding every label word up to a small misread."""

    def holds_all(line: Column) -> Column:
        tokens = F.regexp_extract_all(F.upper(line), F.lit("[A-Z0-9]+"), F.lit(0))
        hits = [F.exists(tokens, _resembles(word)) for word in words]
        return reduce(lambda a, b: a & b, hits)

    under = F.filter(
        F.transform(
            lines, lambda line, i: F.when((i + 1 < F.size(lines)) & holds_all(line), i + 1)
        ),
        lambda i: i.isNotNull(),
    )
    return F.get(lines, F.get(under, F.lit(0)))


def printed_date(value: Column) -> Column:
    """``DD/MM/YYYY`` from the first date-shaped run, if its year is 1900-2099."""
    day, month, year = (F.regexp_extract(value, DATE_PATTERN, g) for g in (1, 2, 3))
    return F.when(
        year.between("1900", "2099"),
        F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year),
    )


def deletions(text: Column) -> Column:
    """The string and every string with one character removed.

    Two strings are within one edit exactly when they can share one of these,
    which turns an edit-distance join into an equi-join plus verification.
    """
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, shorter).otherwise(F.array())))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def fuzzy_equal(a: Column, b: Column, min_length: int = 6) -> Column:
    """At most one edit apart, both long enough for that to mean something."""
    long_enough = (F.length(a) >= min_length) & (F.length(b) >= min_length)
    return F.coalesce(long_enough & within_one_edit(a, b), F.lit(False))
