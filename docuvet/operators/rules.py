"""Document consistency rules, evaluated as one array of checks per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.checks import check, evidence
from ..functions.dates import ddmmyyyy, iso_day, yymmdd
from ..functions.numbers import ladder
from ..functions.text import alnum_upper, blank_to_null, fuzzy_equal

_VALIDATION = ("VALIDATION", "MRZ_VALIDATION")
_CONSISTENCY = ("VALIDATION", "CONSISTENCY")
_MRZ = ("MRZ", "MRZ_VALIDATION")


def _checksum_checks(kind: Column, mrz: Column) -> Column:
    """An array: one check per checksum, or one about the zone's presence."""

    def one(s: Column) -> Column:
        found, expected, field = s["check_digit"], s["calculated_check_digit"], s["field"]
        return check(
            F.concat(F.lit("MRZ_"), F.regexp_replace(F.upper(field), " ", "_")), *_MRZ,
            F.when(s["valid"], field).otherwise(F.concat(F.lit("MRZ Checksum Mismatch ("), field, F.lit(")"))),
            F.when(s["valid"], fixed.PASS).otherwise(fixed.FAIL), 0.99,
            F.when(s["valid"], F.concat(field, F.lit(" agrees with the computed digit.")))
            .otherwise(F.concat(field, F.lit(": read "), found, F.lit(", computed "), expected, F.lit("."))),
            "HIGH", 18.0, evidence(found, expected, "check_digit"),
        )

    presence = F.when(
        kind.isin(*fixed.NON_MRZ_TYPES),
        check("MRZ_PRESENCE", *_MRZ, "MRZ Presence", fixed.NOT_APPLICABLE, 0.95,
              "This document type carries no machine-readable zone."),
    ).when(
        mrz.isNull(),
        check("MRZ_PRESENCE", *_MRZ, "Missing Machine Readable Zone", fixed.FAIL, 0.92,
              "A travel document must carry a readable zone.", "HIGH", 20.0),
    )
    return F.when(F.size(mrz["checksums"]) > 0, F.transform(mrz["checksums"], one)).otherwise(F.array(presence))


def _pan(kind: Column, number: Column) -> Column:
    number = F.coalesce(number, F.lit(""))
    letter = F.substring(number, 4, 1)
    entity = ladder(letter, fixed.PAN_ENTITY_CODES)
    shape = evidence(number, "AAAAA9999A", "pan_format")
    codes = ", ".join(sorted(fixed.PAN_ENTITY_CODES))
    rule = "PAN_FORMAT_VALIDATION"
    return F.when(
        kind == "PAN",
        F.when(
            ~number.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]$"),
            check(rule, *_VALIDATION, "Malformed PAN Structure", fixed.FAIL, 0.97,
                  "Not five letters, four digits and a letter.", "HIGH", 20.0, shape),
        )
        .when(
            entity.isNotNull(),
            check(rule, *_VALIDATION, "PAN Format Validation", fixed.PASS, 0.97,
                  F.concat(F.lit("Well-formed; holder type "), entity, F.lit(".")), proof=shape),
        )
        .otherwise(
            check(rule, *_VALIDATION, "Unrecognized PAN Entity-Type Code", fixed.FAIL, 0.70,
                  F.concat(F.lit("Unknown holder code "), letter, F.lit(".")), "MEDIUM", 8.0,
                  evidence(letter, codes, "pan_entity_code"))
        ),
    )


def _voter(kind: Column, number: Column) -> Column:
    number = F.coalesce(number, F.lit(""))
    ok = number.rlike(r"^[A-Z]{3}[0-9]{7}$")
    return F.when(
        kind == "VOTER_ID",
        check("VOTER_ID_FORMAT_VALIDATION", *_VALIDATION,
              F.when(ok, "Voter ID Format Validation").otherwise("Non-Standard EPIC Format"),
              F.when(ok, fixed.PASS).otherwise(fixed.FAIL), F.when(ok, 0.90).otherwise(0.65),
              F.when(ok, "Three letters and seven digits.").otherwise("Not three letters and seven digits; older cards may differ."),
              "MEDIUM", 8.0, evidence(number, "AAA9999999", "epic_format")),
    )


def _expiry(printed: Column, mrz: Column, as_of: Column) -> Column:
    machine = blank_to_null(mrz["expiry_date"])
    # A machine-read expiry that cannot be parsed still rules out the printed one.
    day = F.when(machine.isNotNull(), yymmdd(machine)).otherwise(ddmmyyyy(printed))
    expired = day < as_of
    proof = evidence(iso_day(day), iso_day(as_of), "expiry_date_vs_today")
    rule = "DOCUMENT_EXPIRATION"
    return F.when(
        day.isNull(),
        check(rule, *_VALIDATION, "Document Expiration Check", fixed.PASS, 0.85,
              "No readable expiry date; left to the officer."),
    ).otherwise(
        check(rule, *_VALIDATION,
              F.when(expired, "Document Expired").otherwise("Document Expiration Check"),
              F.when(expired, fixed.FAIL).otherwise(fixed.PASS), 0.99,
              F.concat(F.when(expired, "Expired on ").otherwise("Valid until "), iso_day(day), F.lit(".")),
              "CRITICAL", 28.0, proof)
    )


def _birth(mrz: Column, as_of: Column) -> Column:
    raw = blank_to_null(mrz["birth_date"])
    day = yymmdd(raw)
    return F.when(
        raw.isNotNull(),
        F.when(
            day.isNull(),
            check("IMPOSSIBLE_DATE", *_VALIDATION, "Impossible Date in MRZ", fixed.FAIL, 0.98,
                  "The birth date is not a calendar date.", "HIGH", 15.0,
                  evidence(raw, unit="birth_date_raw")),
        )
        .when(
            day > as_of,
            check("FUTURE_BIRTH_DATE", *_VALIDATION, "Future Date of Birth", fixed.FAIL, 0.99,
                  "The birth date lies in the future.", "CRITICAL", 25.0,
                  evidence(iso_day(day), iso_day(as_of), "dob_vs_today")),
        )
        .otherwise(
            check("BIRTH_DATE_PLAUSIBILITY", *_VALIDATION, "Birth Date Plausibility", fixed.PASS, 0.99,
                  F.concat(F.lit("Plausible birth date "), iso_day(day), F.lit(".")))
        ),
    )


def numbers_agree(printed: Column, machine: Column) -> Column:
    """Equal, contained with at least five characters, or one edit apart."""
    a, b = alnum_upper(printed), alnum_upper(machine)
    contained = (F.least(F.length(a), F.length(b)) >= 5) & (F.contains(a, b) | F.contains(b, a))
    return (a == b) | contained | fuzzy_equal(a, b)


def _number_crosscheck(printed: Column, machine: Column) -> Column:
    rule = "DOC_NUMBER_CROSSCHECK"
    label = "Document Number Crosscheck"
    ok = numbers_agree(printed, machine)
    return F.when(
        printed.isNull() | machine.isNull(),
        check(rule, *_CONSISTENCY, label, fixed.NOT_APPLICABLE, 0.5, "Only one source gave a number."),
    ).otherwise(
        check(rule, *_CONSISTENCY, F.when(ok, label).otherwise("Document Number Inconsistency"),
              F.when(ok, fixed.PASS).otherwise(fixed.FAIL), 0.95,
              F.when(ok, "Printed and machine-read numbers agree.").otherwise("Printed and machine-read numbers differ."),
              "HIGH", 22.0, evidence(printed, machine, "document_number"))
    )


def _required(name: Column, surname: Column, printed: Column, machine: Column) -> Column:
    missing = F.concat_ws(
        ", ",
        F.when(F.coalesce(name, surname).isNull(), "Full Name"),
        F.when(F.coalesce(printed, machine).isNull(), "Document Number"),
    )
    lacking = missing != ""
    return check(
        "REQUIRED_FIELDS_PRESENCE", *_VALIDATION,
        F.when(lacking, "Missing Mandatory Identity Fields").otherwise("Required Fields Presence"),
        F.when(lacking, fixed.FAIL).otherwise(fixed.PASS), F.when(lacking, 0.90).otherwise(0.95),
        F.when(lacking, F.concat(F.lit("Not found: "), missing)).otherwise("Name and number are present."),
        "MEDIUM", 10.0,
        F.when(lacking, evidence(missing, "Full Name, Document Number", "required_fields")),
    )


def _plausible(name: Column, mrz: Column, printed: Column, machine: Column) -> Column:
    machine_name = blank_to_null(
        F.trim(F.concat_ws(" ", blank_to_null(mrz["given_names"]), blank_to_null(mrz["surname"])))
    )
    shown = F.coalesce(name, machine_name)
    odd = F.length(shown) - F.length(F.regexp_replace(shown, r"[^A-Za-z\s'\-.]", ""))
    bad_name = F.coalesce((odd / F.length(shown) > 0.15) | (F.length(shown) > 80), F.lit(False))
    number = F.coalesce(printed, machine)
    bad_number = F.coalesce(~number.rlike(r"[0-9]"), F.lit(False))
    bad = bad_name | bad_number
    # The quoted name is shortened for display only.
    quoted = F.concat(F.substring(shown, 1, 60), F.when(F.length(shown) > 60, "…").otherwise(""))
    found = F.concat_ws(
        "; ",
        F.when(bad_name, F.concat(F.lit("name ('"), quoted, F.lit("')"))),
        F.when(bad_number, F.concat(F.lit("document number ('"), number, F.lit("')"))),
    )
    return check(
        "DOCUMENT_CONTENT_PLAUSIBILITY", *_VALIDATION,
        F.when(bad, "Extracted Content Does Not Resemble an Identity Document").otherwise("Extracted Content Plausibility"),
        F.when(bad, fixed.FAIL).otherwise(fixed.PASS), 0.80,
        F.when(bad, "The text does not look like an identity document.").otherwise("Name and number look genuine."),
        "CRITICAL", 30.0,
        F.when(bad, evidence(found, "plausible name / alphanumeric ID", "extracted_content_plausibility")),
    )


def _format_rule(value, ok, rule, good, bad, wanted, unit, impact, bad_confidence) -> Column:
    return F.when(
        value.isNotNull(),
        check(rule, *_VALIDATION, F.when(ok, good).otherwise(bad),
              F.when(ok, fixed.PASS).otherwise(fixed.FAIL), F.when(ok, 0.98).otherwise(bad_confidence),
              F.concat(F.lit("Code read: "), value), "MEDIUM", impact, evidence(value, wanted, unit)),
    )


def _visa_stay(kind: Column, until: Column, as_of: Column) -> Column:
    day = ddmmyyyy(until)
    over = day < as_of
    rule, label = "VISA_STAY_DURATION_VALIDATION", "Visa Stay Duration Validation"
    return F.when(
        kind == "VISA",
        F.when(
            day.isNull(),
            check(rule, *_VALIDATION, label, fixed.PASS, 0.80, "No readable stay date; left to the officer."),
        ).otherwise(
            check(rule, *_VALIDATION, F.when(over, "Visa Stay Duration Expired").otherwise(label),
                  F.when(over, fixed.FAIL).otherwise(fixed.PASS), 0.97,
                  F.concat(F.lit("Stay permitted until "), iso_day(day), F.lit(".")), "CRITICAL", 24.0,
                  evidence(iso_day(day), iso_day(as_of), "stay_until_vs_today"))
        ),
    )


def _visa_entry(kind: Column, entry: Column) -> Column:
    value = F.upper(F.trim(F.coalesce(entry, F.lit(""))))
    known = value.isin(*fixed.VISA_ENTRY_TYPES)
    proof = evidence(value, ", ".join(sorted(fixed.VISA_ENTRY_TYPES)), "visa_entry_type")
    rule, label = "VISA_ENTRY_VALIDATION_CHECK", "Visa Entry Validation Check"
    return F.when(
        kind == "VISA",
        F.when(
            value == "",
            check(rule, *_VALIDATION, label, fixed.PASS, 0.75, "No entry type printed; left to the officer."),
        ).otherwise(
            check(rule, *_VALIDATION, F.when(known, label).otherwise("Unrecognized Visa Entry Validation Value"),
                  F.when(known, fixed.PASS).otherwise(fixed.FAIL), F.when(known, 0.90).otherwise(0.60),
                  F.concat(F.lit("Entry type read: "), value), "MEDIUM", 8.0, proof)
        ),
    )


def _jurisdiction(declared: Column, country: Column, mrz: Column) -> Column:
    said = F.upper(F.trim(F.coalesce(declared, F.lit(""))))
    printed = blank_to_null(F.upper(F.trim(country)))
    code = blank_to_null(F.upper(F.trim(mrz["country"])))
    said_code = ladder(said, fixed.JURISDICTION_CODES)
    by_code = printed.isNull() & code.isNotNull() & said_code.isNotNull()
    compared = F.when(by_code, code).otherwise(printed)
    ok = F.when(by_code, code == said_code).otherwise(printed == said)
    rule, label = "JURISDICTION_COUNTRY_CROSSCHECK", "Declared Jurisdiction Crosscheck"
    return F.when(
        (said != "") & (said != "UNKNOWN"),
        F.when(
            compared.isNull(),
            check(rule, *_CONSISTENCY, label, fixed.NOT_APPLICABLE, 0.5, "The document names no country."),
        ).otherwise(
            check(rule, *_CONSISTENCY, F.when(ok, label).otherwise("Declared Jurisdiction Does Not Match Document"),
                  F.when(ok, fixed.PASS).otherwise(fixed.FAIL), F.when(ok, 0.90).otherwise(0.85),
                  F.concat(F.lit("Declared "), said, F.lit(", document says "), compared, F.lit(".")),
                  "HIGH", 15.0, evidence(compared, said, "issuing_country"))
        ),
    )


RULES = [
    "checksums", "pan", "voter", "expiry", "birth", "number", "required", "plausible",
    "nationality", "sex", "stay", "entry", "jurisdiction",
]


def evaluate_rules(docs: DataFrame, as_of: str, key: str = "doc_id", rules: list[str] | None = None) -> DataFrame:
    """Every applicable check of every document, in long format.

    ``docs`` needs document_type, full_name, document_number, country,
    date_of_expiry, entry_validation, stay_duration_until, declared_country and a
    ``mrz`` struct (NULL without a zone). ``as_of`` is the day to judge by. Checks
    are built beside each other in the row and exploded: no shuffle.
    """
    today = F.to_date(F.lit(as_of))
    col = lambda name: blank_to_null(F.col(name))
    kind, mrz = F.col("document_type"), F.col("mrz")
    printed, machine = col("document_number"), blank_to_null(F.col("mrz.document_number"))
    nationality = blank_to_null(mrz["nationality"])
    sex = F.upper(blank_to_null(mrz["sex"]))
    built = {
        "checksums": lambda: _checksum_checks(kind, mrz),
        "pan": lambda: F.array(_pan(kind, printed)),
        "voter": lambda: F.array(_voter(kind, printed)),
        "expiry": lambda: F.array(_expiry(F.col("date_of_expiry"), mrz, today)),
        "birth": lambda: F.array(_birth(mrz, today)),
        "number": lambda: F.array(_number_crosscheck(printed, machine)),
        "required": lambda: F.array(_required(col("full_name"), blank_to_null(mrz["surname"]), printed, machine)),
        "plausible": lambda: F.array(_plausible(col("full_name"), mrz, printed, machine)),
        "nationality": lambda: F.array(
            _format_rule(nationality, nationality.rlike("^[A-Za-z]{3}$"), "NATIONALITY_CODE_FORMAT",
                         "Nationality Code Format", "Malformed Nationality Code", "3-letter ISO alpha code",
                         "nationality_code", 8.0, 0.95)),
        "sex": lambda: F.array(
            _format_rule(sex, sex.isin("M", "F", "X"), "SEX_CODE_FORMAT", "Sex/Gender Code Format",
                         "Malformed Sex/Gender Code", "M, F, or X", "sex_code", 6.0, 0.90)),
        "stay": lambda: F.array(_visa_stay(kind, F.col("stay_duration_until"), today)),
        "entry": lambda: F.array(_visa_entry(kind, F.col("entry_validation"))),
        "jurisdiction": lambda: F.array(_jurisdiction(F.col("declared_country"), F.col("country"), mrz)),
    }
    groups = [built[name]() for name in (rules or RULES)]
    checks = F.filter(reduce(lambda a, b: F.concat(a, b), groups), lambda c: c.isNotNull())
    return docs.select(key, F.posexplode(checks).alias("pos", "c")).select(
        key, (F.col("pos") + 1).alias("check_seq"), "c.*"
    )


def rule_counts(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passed and failed checks per document."""
    return checks.groupBy(key).agg(
        F.count_if(F.col("status") == fixed.PASS).alias("passed_count"),
        F.count_if(F.col("status") == fixed.FAIL).alias("failed_count"),
    )
