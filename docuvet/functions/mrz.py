"""ICAO 9303 machine-readable-zone expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import DIGIT_TO_LETTER, LETTER_TO_DIGIT, MRZ_ALPHABET

_BRACKETS = "«»‹›{}[]()"


def check_digit(text: Column) -> Column:
    """Weighted 7-3-1 sum modulo 10; letters count 10-35, filler and unknowns 0."""
    weighted = F.transform(
        F.split(F.upper(text), ""),
        lambda ch, i: F.greatest(F.instr(F.lit(MRZ_ALPHABET), ch) - 1, F.lit(0))
        * F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3),
    )
    return (F.aggregate(weighted, F.lit(0), lambda total, v: total + v) % 10).cast("string")


def clean_line(line: Column) -> Column:
    """Filler look-alikes to ``<``, everything outside the MRZ alphabet dropped."""
    filled = F.translate(line, _BRACKETS, "<" * len(_BRACKETS))
    # Each letter of a run of two or more is replaced by itself, so length holds.
    filled = F.regexp_replace(filled, "(?<=[ceo])[ceo]|[ceo](?=[ceo])", "<")
    return F.upper(F.regexp_replace(filled, "[^A-Za-z0-9<]", ""))


def as_digits(text: Column) -> Column:
    return F.translate(F.upper(text), *LETTER_TO_DIGIT)


def as_letters(text: Column) -> Column:
    return F.translate(F.upper(text), *DIGIT_TO_LETTER)


def restore_length(line: Column, width: Column | int) -> Column:
    """Widen the last filler run of a short line; cut a long one."""
    width = F.lit(width) if isinstance(width, int) else width
    tail = F.substring_index(line, "<", -1)
    head = F.substring(line, F.lit(1), F.length(line) - F.length(tail))
    missing = width - F.length(line)
    widened = F.concat(head, F.repeat(F.lit("<"), missing), tail)
    return (
        F.when(missing <= 0, F.substring(line, F.lit(1), width))
        .when(F.instr(line, "<") > 0, widened)
        .otherwise(F.rpad(line, width, F.lit("<")))
    )


def without_filler(text: Column) -> Column:
    return F.regexp_replace(text, "<", "")


def name_piece(names: Column, index: int) -> Column:
    """Piece ``index`` between double fillers, single fillers read as spaces."""
    pieces = F.split(names, "<<")
    return F.coalesce(F.trim(F.regexp_replace(F.get(pieces, F.lit(index)), "<", " ")), F.lit(""))
