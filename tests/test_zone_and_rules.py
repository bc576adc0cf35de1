"""Unit vectors of the machine-readable zone, extraction and rules."""

import datetime

from pyspark.sql import functions as F

from docuvet.functions import dates, mrz as zone, text
from docuvet.operators import extract, mrz, rules

L1 = "P<UTOKAUL<<ARIHANT" + "<" * 26
BLANK = "struct<{}>".format(
    "surname:string,given_names:string,document_number:string,nationality:string,sex:string,birth_date:string,"
    "expiry_date:string,country:string,checksums:array<struct<field:string,value:string,check_digit:string,"
    "calculated_check_digit:string,valid:boolean>>"
)


def digit(data):
    values = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return str(sum(values.get(c, 0) * (7, 3, 1)[i % 3] for i, c in enumerate(data)) % 10)


def td3(number="X1234567<", dob="000101", expiry="300101", sex="M", optional="<" * 15):
    body = number + digit(number) + "UTO" + dob + digit(dob) + sex + expiry + digit(expiry) + optional
    payload = number + digit(number) + dob + digit(dob) + expiry + digit(expiry) + optional
    return body + digit(payload)


def parse(spark, *lines, fmt="TD3"):
    names = [f"line{i + 1}" for i in range(len(lines))]
    df = spark.createDataFrame([lines], ", ".join(f"{n} string" for n in names))
    return mrz.parse_mrz_lines(df, fmt, *names).select("mrz.*").first()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_check_digits(spark):
    for data, expected in [("740812", "2"), ("L898902C<", "3"), ("", "0"), ("l898902c<", "3")]:
        assert one(spark, zone.check_digit(F.lit(data))) == expected


def test_genuine_passport(spark):
    got = parse(spark, L1, td3())
    assert got.is_valid and len(got.checksums) == 4
    assert (got.surname, got.given_names, got.document_number) == ("KAUL", "ARIHANT", "X1234567")
    assert (got.birth_date, got.expiry_date, got.sex, got.country) == ("000101", "300101", "M", "UTO")


def test_wrong_document_digit_is_found(spark):
    line = td3()
    wrong = "9" if line[9] != "9" else "8"
    got = parse(spark, L1, line[:9] + wrong + line[10:])
    assert not got.is_valid and not got.checksums[0].valid


def test_swallowed_filler_is_restored_before_the_last_digit(spark):
    line = td3()
    got = parse(spark, L1, line[:28] + "<" * 7 + line[-1])
    assert got.is_valid and len(got.line2) == 44


def test_confused_digits_and_letters(spark):
    assert parse(spark, L1, td3().replace("000101", "O00101", 1)).is_valid
    assert parse(spark, L1.replace("UTO", "UT0"), td3()).country == "UTO"


def test_optional_data_may_be_letters_or_misread_digits(spark):
    assert parse(spark, L1, td3(optional="KEK2K556" + "<" * 7)).is_valid
    line = td3(optional="1" + "<" * 14)
    assert parse(spark, L1, line[:28] + "I" + line[29:]).is_valid


def test_unknown_sex_is_kept_and_filler_is_x(spark):
    assert parse(spark, L1, td3(sex="1")).sex == "1"
    assert parse(spark, L1, td3(sex="<")).sex == "X"


def test_card_and_visa_formats(spark):
    number, dob, exp = "I12345678", "900512", "300101"
    opt1, opt2 = "<" * 15, "<" * 11
    composite = digit(number + digit(number) + opt1 + dob + digit(dob) + exp + digit(exp) + opt2)
    got = parse(
        spark, "I<UTO" + number + digit(number) + opt1,
        dob + digit(dob) + "F" + exp + digit(exp) + "UTO" + opt2 + composite, "KAUL<<ARIHANT" + "<" * 17, fmt="TD1",
    )
    assert got.is_valid and got.document_number == number and got.format == "TD1"
    line = td3()
    got = parse(spark, "V<UTOKAUL<<ARIHANT" + "<" * 18, line[:28] + "<" * 7 + line[-1], fmt="TD2")
    assert got.is_valid and got.document_type == "V"


def test_zone_is_found_and_cards_have_none(spark):
    docs = spark.createDataFrame(
        [(1, "PASSPORT", ["REPUBLIC", L1, td3(), "X"], None), (2, "AADHAAR", [L1, td3()], [L1, td3()]),
         (3, "PASSPORT", ["nothing"], None), (4, "PASSPORT", ["nothing"], [L1, td3()[:40]]), (5, "PASSPORT", [], None)],
        "doc_id int, document_type string, lines array<string>, band array<string>",
    )
    got = {r.doc_id: r.mrz for r in mrz.parse_mrz(mrz.find_mrz_lines(docs)).collect()}
    assert got[1].is_valid and got[1].format == "TD3"
    assert got[2] is None and got[3] is None and got[5] is None
    assert got[4].document_number == "X1234567"


def test_dates(spark):
    assert one(spark, dates.yymmdd(F.lit("450101"))) == datetime.date(2045, 1, 1)
    assert one(spark, dates.yymmdd(F.lit("460101"))) == datetime.date(1946, 1, 1)
    for bad in ("900230", "901301", "9001", "90O101", ""):
        assert one(spark, dates.yymmdd(F.lit(bad))) is None
    assert one(spark, dates.ddmmyyyy(F.lit("29/02/2024"))) == datetime.date(2024, 2, 29)
    assert one(spark, dates.ddmmyyyy(F.lit("1/2/2024"))) is None
    assert one(spark, text.printed_date(F.lit("0101/2000"))) == "01/01/2000"
    assert one(spark, text.printed_date(F.lit("PIN 560039"))) is None


def fields(spark, raw):
    return extract.extract_fields(spark.createDataFrame([(1, raw)], "doc_id int, raw_text string")).first()


def test_aadhaar(spark):
    raw = "Government of India\nnot proof of date of birth (DOB) or citizenship\nRavi Kumar\nDOB: 15/08/1990\nMALE\n"
    got = fields(spark, raw + "VID 1234 5678 9012 3456\n4050/00286/01675\nAadhaar 12345678 9012")
    assert (got.document_type, got.document_number) == ("AADHAAR", "123456789012")
    assert (got.full_name, got.date_of_birth, got.sex, got.country) == ("Ravi Kumar", "15/08/1990", "M", "INDIA")
    assert fields(spark, "AADHAAR\nweddseah Ja hMA so Hsod\nCENDAIEAD\nO'Brien Mary").full_name == "O'Brien Mary"
    assert fields(spark, "AADHAAR\n1234 5678 9012 3456").document_number is None


def test_label_anchored_cards(spark):
    pan = fields(spark, "INCOME TAX DEPARTMENT\nFather's Name\nOLD ONE\nName\nYOUNG ONE\nabcpk1234f")
    assert (pan.document_type, pan.full_name, pan.document_number) == ("PAN", "YOUNG ONE", "ABCPK1234F")
    licence = fields(spark, "DRIVING LICENCE\nMH-12 2011-0012345\nVAUD TILL\n20/03/2031")
    assert (licence.document_number, licence.date_of_expiry) == ("MH1220110012345", "20/03/2031")
    visa = fields(spark, "ENTRY VISA\nVISA NUMBEF\nUV1234567\nNAME LAST LINE")
    assert (visa.document_number, visa.country, visa.full_name) == ("UV1234567", "REPUBLIC OF UTOPIA", None)


def test_passport(spark):
    got = fields(spark, "REPUBLIC\nJRNAME / NOM\nKAUL\nGIVEN / PRENOMS\nARIHANT\nDEXPIRATION\n0101/2031\nSEXE\nfemale\nP1234567")
    assert (got.full_name, got.date_of_expiry, got.sex, got.document_number) == ("KAUL ARIHANT", "01/01/2031", "F", "P1234567")
    assert fields(spark, "PASSPORT\nJANE Q DOE").full_name == "JANE Q DOE"
    assert fields(spark, None).ocr_status == "FAILED"


def checks(spark, as_of="2026-01-01", **given):
    row = {
        "doc_id": 1, "document_type": "PASSPORT", "full_name": "ANN LEE", "document_number": "X1234567", "country": None,
        "date_of_expiry": None, "entry_validation": None, "stay_duration_until": None, "declared_country": None, "mrz": None,
    }
    row.update(given)
    schema = "doc_id int, document_type string, full_name string, document_number string, country string, " \
             "date_of_expiry string, entry_validation string, stay_duration_until string, declared_country string, mrz " + BLANK
    df = spark.createDataFrame([row], schema)
    return {r.check_key: r for r in rules.evaluate_rules(df, as_of).collect()}


def machine(**given):
    base = dict(surname="LEE", given_names="ANN", document_number="X1234567", nationality="UTO", sex="F",
                birth_date="900101", expiry_date="300101", country="UTO", checksums=[])
    base.update(given)
    return base


def test_rules(spark):
    good = checks(spark, mrz=machine())
    assert all(c.status in ("PASS", "NOT_APPLICABLE") for c in good.values())
    assert "MRZ_PRESENCE" not in good
    expired = checks(spark, mrz=machine(expiry_date="200101"))["DOCUMENT_EXPIRATION"]
    assert (expired.status, expired.severity, expired.score_impact) == ("FAIL", "CRITICAL", 28.0)
    differs = checks(spark, document_number="A9999999", mrz=machine(document_number="B8888888"))["DOC_NUMBER_CROSSCHECK"]
    assert (differs.status, differs.factor, differs.score_impact) == ("FAIL", "CONSISTENCY", 22.0)
    assert checks(spark, document_number="ABC", mrz=machine(document_number="ABCX"))["DOC_NUMBER_CROSSCHECK"].status == "FAIL"
    assert checks(spark, mrz=machine(sex="1"))["SEX_CODE_FORMAT"].status == "FAIL"
    assert checks(spark, mrz=machine(birth_date="900230"))["IMPOSSIBLE_DATE"].severity == "HIGH"
    assert checks(spark, mrz=machine(birth_date="400101"))["FUTURE_BIRTH_DATE"].severity == "CRITICAL"
    assert checks(spark)["MRZ_PRESENCE"].status == "FAIL"
    assert checks(spark, document_type="PAN", document_number="ABCPK1234F")["MRZ_PRESENCE"].status == "NOT_APPLICABLE"


def test_unreadable_machine_expiry_rules_out_the_printed_one(spark):
    got = checks(spark, date_of_expiry="01/01/2020", mrz=machine(expiry_date="30O101"))["DOCUMENT_EXPIRATION"]
    assert (got.status, got.confidence) == ("PASS", 0.85)


def test_wrong_file_is_critical(spark):
    got = checks(spark, full_name="R= {(1, 1), 22), (8,3)}", document_number="DIFFERENT")["DOCUMENT_CONTENT_PLAUSIBILITY"]
    assert (got.status, got.severity, got.score_impact) == ("FAIL", "CRITICAL", 30.0)


def test_jurisdiction(spark):
    key = "JURISDICTION_COUNTRY_CROSSCHECK"
    assert key not in checks(spark, declared_country="Unknown")
    assert checks(spark, declared_country="India")[key].status == "NOT_APPLICABLE"
    assert checks(spark, declared_country="India", mrz=machine())[key].status == "FAIL"
    assert checks(spark, declared_country="Republic of Utopia", mrz=machine())[key].status == "PASS"
    assert checks(spark, declared_country="India", country="INDIA", mrz=machine())[key].status == "PASS"
