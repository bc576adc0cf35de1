"""Field extraction from document text, one row per document and no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.numbers import clamp, round_exact
from ..functions.text import (
    blank_to_null, body_of, first_match, lines_of, printed_date,
    value_after_fuzzy_label, value_after_label,
)

AADHAAR, PAN, LICENCE, VOTER, VISA, PERMIT = fixed.DOCUMENT_MARKERS
PASSPORT = fixed.DEFAULT_DOCUMENT_TYPE


def ocr_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, raw_text)`` to ordered, stripped, non-empty lines (1-based)."""
    body = body_of(F.col("raw_text"))
    return docs.select("doc_id", F.posexplode(lines_of(body)).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), "line"
    )


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def document_type(raw: Column) -> Column:
    """The first type, in fixed order, one of whose issuer markers occurs."""
    upper = F.upper(raw)
    kinds = list(fixed.DOCUMENT_MARKERS.items())
    chain = F.when(_contains_any(upper, kinds[0][1]), kinds[0][0])
    for kind, markers in kinds[1:]:
        chain = chain.when(_contains_any(upper, markers), kind)
    return chain.otherwise(PASSPORT)


def aadhaar_number(raw: Column) -> Column:
    """The first run of digits and single spaces holding exactly twelve digits."""
    clusters = F.regexp_extract_all(raw, F.lit(fixed.AADHAAR_CLUSTER), F.lit(0))
    digits = F.transform(clusters, lambda run: F.regexp_replace(run, r"\s", ""))
    return F.get(F.filter(digits, lambda d: F.length(d) == 12), F.lit(0))


def aadhaar_birth_date(lines: Column) -> Column:
    """First date on a birth-labelled line, or on the line under it."""
    dates = F.transform(
        lines,
        lambda line, i: F.when(
            line.rlike(r"(?i)\b(DOB|DATE OF BIRTH)\b"),
            F.coalesce(printed_date(line), printed_date(F.get(lines, i + 1))),
        ),
    )
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def _is_title(line: Column) -> Column:
    """Every run of letters starts upper and goes on lower."""
    return line.rlike(r"[A-Z]") & ~line.rlike(r"[A-Za-z][A-Z]") & ~line.rlike(r"(^|[^A-Za-z])[a-z]")


def _is_upper(line: Column) -> Column:
    return line.rlike(r"(?U)\p{Lu}") & ~line.rlike(r"(?U)\p{Ll}")


def aadhaar_name(lines: Column) -> Column:
    """First of fifteen lines that is shaped like a printed multi-word name."""

    def name_like(line: Column) -> Column:
        return (
            (F.length(line) > 4)
            & F.contains(line, F.lit(" "))
            & line.rlike(r"^[A-Za-z.'\- ]+$")
            & ~line.rlike(r"(?i)\b(DOB|DATE OF BIRTH|MALE|FEMALE|TRANSGENDER)\b")
            & ~_contains_any(F.upper(line), fixed.AADHAAR_BOILERPLATE)
            & (_is_title(line) | _is_upper(line))
        )

    return F.get(F.filter(F.slice(lines, 1, 15), name_like), F.lit(0))


def passport_name(body: Column, lines: Column) -> Column:
    """Surname and given names by their labels, else the first upper-case line."""
    labelled = blank_to_null(
        F.concat_ws(
            " ", value_after_label(body, r"\bNOM\b"), value_after_label(body, r"\bPRENOM")
        )
    )
    shouted = F.filter(
        F.slice(lines, 1, 8),
        lambda line: (F.length(line) > 4)
        & _is_upper(line)
        & ~_contains_any(line, fixed.PASSPORT_BOILERPLATE),
    )
    return F.coalesce(labelled, F.get(shouted, F.lit(0)))


def _sex_word(raw: Column, other: str) -> Column:
    return F.upper(first_match(raw, rf"(?i)\b(MALE|FEMALE|{other})\b"))


def _sex_code(word: Column) -> Column:
    """Printed words and letters to M, F, X; words of a third gender are X."""
    return (
        F.when(word.isin("MALE", "M"), "M").when(word.isin("FEMALE", "F"), "F").when(word.isNotNull(), "X")
    )


def _with_lines(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    return (
        docs.withColumn("_raw", raw)
        .withColumn("_upper", F.upper(raw))
        .withColumn("_body", body_of(raw))
        .withColumn("_lines", lines_of(F.col("_body")))
        .withColumn("document_type", document_type(raw))
    )


FIELDS = [
    "document_type", "full_name", "document_number", "nationality", "country", "date_of_birth",
    "date_of_issue", "date_of_expiry", "sex", "visa_type", "entry_validation",
    "stay_duration_until", "permit_type", "issuing_authority",
]


def extract_fields(docs: DataFrame) -> DataFrame:
    """``(doc_id, raw_text, ...)`` to one uniform row of typed fields.

    The type is decided once; each field then picks the expression of its type,
    so every document is parsed in the same pass over the scan. A document whose
    text could not be read (NULL) keeps its row with ``ocr_status`` FAILED.
    """
    d = _with_lines(docs)
    raw, upper, body, lines = (F.col(c) for c in ("_raw", "_upper", "_body", "_lines"))
    kind = F.col("document_type")
    failed = F.col("raw_text").isNull()

    def per_type(table: dict, default=None) -> Column:
        chain = None
        for types, value in table.items():
            cond = kind.isin(*(types if isinstance(types, tuple) else (types,)))
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        return chain if default is None else chain.otherwise(default)

    under = lambda label, unless=(): value_after_label(body, label, unless)
    fuzzy = lambda label, words: F.coalesce(under(label), value_after_fuzzy_label(lines, words))
    licence = F.concat(*(F.regexp_extract(upper, fixed.LICENCE_PATTERN, g) for g in range(1, 5)))

    # First the printed values, then what is read out of them: a value used
    # several times is named once and not repeated inside other expressions.
    columns = {
        "document_number": per_type(
            {
                AADHAAR: aadhaar_number(raw),
                PAN: first_match(upper, fixed.PAN_PATTERN),
                LICENCE: blank_to_null(licence),
                VOTER: first_match(upper, fixed.VOTER_PATTERN),
                VISA: fuzzy(r"\bVISA NUMBER\b", ["VISA", "NUMBER"]),
                PERMIT: fuzzy(r"\bPERMIT NUMBER\b", ["PERMIT", "NUMBER"]),
            },
            first_match(raw, fixed.PASSPORT_PATTERN),
        ),
        "full_name": per_type(
            {
                AADHAAR: aadhaar_name(lines),
                PAN: under(r"\bNAME\b", ("FATHER",)),
                LICENCE: under(r"\bNAME\b"),
                VOTER: under(r"\bNAME\b", ("FATHER", "HUSBAND", "MOTHER")),
                (VISA, PERMIT): under(r"\bFULL NAME\b"),
            },
            passport_name(body, lines),
        ),
        "nationality": F.when(failed, "UNKNOWN").otherwise(
            per_type(
                {
                    tuple(fixed.INDIAN_TYPES): F.lit("INDIA"),
                    (VISA, PERMIT): under(r"\bNATIONALITY\b"),
                },
                under(r"\bNATIONALITE\b"),
            )
        ),
        "country": F.when(failed, "UNKNOWN").otherwise(
            per_type(
                {
                    tuple(fixed.INDIAN_TYPES): F.lit("INDIA"),
                    tuple(fixed.UTOPIAN_TYPES): F.lit("REPUBLIC OF UTOPIA"),
                },
                under(r"\bPAYS\b"),
            )
        ),
        "date_of_birth": per_type(
            {
                AADHAAR: aadhaar_birth_date(lines),
                PASSPORT: under(r"\bNAISSANCE\b"),
            },
            under(r"\bDATE OF BIRTH\b"),
        ),
        "date_of_issue": per_type(
            {
                LICENCE: fuzzy(r"\bVALID FROM\b", ["VALID", "FROM"]),
                (VISA, PERMIT): under(r"\bDATE OF ISSUE\b"),
            }
        ),
        "date_of_expiry": per_type(
            {
                LICENCE: fuzzy(r"\bVALID TILL\b", ["VALID", "TILL"]),
                PERMIT: fuzzy(r"\bDATE OF EXPIRY\b", ["DATE", "OF", "EXPIRY"]),
                PASSPORT: under(r"EXPIRATION\b"),
            }
        ),
        "sex": per_type(
            {
                AADHAAR: _sex_word(raw, "TRANSGENDER"),
                VOTER: _sex_word(raw, "THIRD GENDER"),
                PASSPORT: F.nullif(
                    F.regexp_extract(F.upper(under(r"\bSEXE\b")), "^[MFX]", 0), F.lit("")
                ),
            }
        ),
        "visa_type": per_type({VISA: under(r"\bVISA TYPE\b")}),
        "entry_validation": per_type({VISA: under(r"\bENTRY VALIDATION\b")}),
        "stay_duration_until": per_type({VISA: under(r"\bSTAY DURATION\b")}),
        "permit_type": per_type({PERMIT: under(r"\bPERMIT TYPE\b")}),
        "issuing_authority": per_type({PERMIT: under(r"\bISSUING AUTHORITY\b")}),
    }
    keep = [c for c in docs.columns if c != "raw_text" and c not in FIELDS]
    printed = d.select(
        *keep,
        "document_type",
        *[columns[name].alias(name) for name in FIELDS[1:]],
        F.when(failed, "FAILED").otherwise("OK").alias("ocr_status"),
    )
    dates = ("date_of_birth", "date_of_issue", "date_of_expiry", "stay_duration_until")
    return printed.withColumns(
        {**{name: printed_date(F.col(name)) for name in dates}, "sex": _sex_code(F.col("sex"))}
    )


def ocr_confidence(words: DataFrame) -> DataFrame:
    """Mean word confidence per document as a 0.40-0.99 share; 0.88 without words."""
    scored = F.when(F.col("conf") >= 0, F.col("conf"))
    mean = F.coalesce(F.avg(scored) / 100.0, F.lit(0.88))
    return words.groupBy("doc_id").agg(clamp(round_exact(mean, 2), 0.40, 0.99).alias("ocr_confidence"))
