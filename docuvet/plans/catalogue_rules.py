"""Document rules, forensic and face signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fixed
from ..operators import mrz, rules, signals
from .catalogue_extract import CHECKSUMS
from .harness import Catalogue, py_round

CATALOGUE = Catalogue()
add = CATALOGUE.add

AS_OF = "2026-01-01"


def day6(value: str) -> str:
    """Oracle: YYMMDD to a date."""
    return (
        f"(case when regexp_full_match({value}, '[0-9]{{6}}') then cast(try_strptime((case when {value}[1:2] <= '45' then '20' else '19' end) || {value}, '%Y%m%d') as date) end)"
    )


def day10(value: str) -> str:
    """Oracle: strict DD/MM/YYYY to a date."""
    return f"(case when regexp_full_match({value}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then cast(try_strptime({value}, '%d/%m/%Y') as date) end)"


_TODAY = f"date '{AS_OF}'"
iso = lambda d: f"strftime({d}, '%Y-%m-%d')"


def with_zone(docs):
    """Rule inputs: the flat machine-read columns as a zone struct without checksums."""
    zone = F.struct(
        F.col("surname"), F.col("given_names"), F.col("mrz_number").alias("document_number"), F.col("nationality"),
        F.col("sex"), F.col("birth_date"), F.col("expiry_date"), F.col("mrz_country").alias("country"),
        F.array().cast("array<struct<field:string,value:string,check_digit:string,calculated_check_digit:string,valid:boolean>>").alias("checksums"),
    )
    own = ["doc_id", "document_type", "full_name", "document_number", "date_of_expiry", "entry_validation",
           "stay_duration_until", "declared_country"]
    return docs.select(*own, docs["country"], F.when(F.col("has_mrz"), zone).alias("mrz"))


SHOWN = ["doc_id", "check_key", "factor", "label", "status", "severity", "confidence", "measured_value", "threshold_value", "unit", "score_impact"]


def shown(checks, key="doc_id"):
    return checks.select(
        key, "check_key", "factor", "label", "status", "severity", "confidence", "evidence.measured_value",
        "evidence.threshold_value", "evidence.unit", "score_impact",
    )


def row(key, factor, label, status, severity, confidence, measured, threshold, unit, impact, source, where="true") -> str:
    """Oracle: one rule's rows; severity and impact apply to failures only."""
    return f"""select doc_id, {key} as check_key, {factor} as factor, {label} as label, {status} as status,
 case when {status} = 'FAIL' then {severity} end as severity, cast({confidence} as double) as confidence, cast({measured} as string) as measured_value,
 cast({threshold} as string) as threshold_value, {unit} as unit, cast(case when {status} = 'FAIL' then {impact} else 0 end as double) as score_impact
 from {source} where {where}"""


# Rule inputs as the oracle sees them: machine-read values only where there is a zone.
_DOCS = f"""(select *, case when has_mrz then mrz_number end as zn, case when has_mrz then nullif(nationality, '') end as znat,
 case when has_mrz then upper(nullif(sex, '')) end as zsex, case when has_mrz then nullif(birth_date, '') end as zbirth,
 case when has_mrz then nullif(expiry_date, '') end as zexp, case when has_mrz then mrz_country end as zcountry,
 case when has_mrz then nullif(surname, '') end as zsurname from @fx_rule_docs r)"""
_V, _C, _M = "'MRZ_VALIDATION'", "'CONSISTENCY'", "'MRZ_VALIDATION'"

SQL: dict[str, str] = {}
SQL["checksums"] = row("'MRZ_PRESENCE'", _M, "case when document_type = 'PASSPORT' then 'Missing Machine Readable Zone' else 'MRZ Presence' end",
                       "case when document_type = 'PASSPORT' then 'FAIL' else 'NOT_APPLICABLE' end", "'HIGH'",
                       "case when document_type = 'PASSPORT' then 0.92 else 0.95 end", "null", "null", "null", "20", _DOCS,
                       "document_type <> 'PASSPORT' or not has_mrz")
_bad_pan = "not regexp_full_match(coalesce(document_number, ''), '[A-Z]{5}[0-9]{4}[A-Z]')"
_known = "document_number[4] in ('P', 'C', 'H', 'F', 'A', 'T', 'B', 'L', 'J', 'G')"
SQL["pan"] = row("'PAN_FORMAT_VALIDATION'", _V,
                 f"case when {_bad_pan} then 'Malformed PAN Structure' when {_known} then 'PAN Format Validation' else 'Unrecognized PAN Entity-Type Code' end",
                 f"case when {_bad_pan} then 'FAIL' when {_known} then 'PASS' else 'FAIL' end", f"case when {_bad_pan} then 'HIGH' else 'MEDIUM' end",
                 f"case when {_bad_pan} or {_known} then 0.97 else 0.70 end",
                 f"case when {_bad_pan} or {_known} then coalesce(document_number, '') else document_number[4] end",
                 f"case when {_bad_pan} or {_known} then 'AAAAA9999A' else 'A, B, C, F, G, H, J, L, P, T' end",
                 f"case when {_bad_pan} or {_known} then 'pan_format' else 'pan_entity_code' end", f"case when {_bad_pan} then 20 else 8 end", _DOCS, "document_type = 'PAN'")
_epic = "regexp_full_match(coalesce(document_number, ''), '[A-Z]{3}[0-9]{7}')"
SQL["voter"] = row("'VOTER_ID_FORMAT_VALIDATION'", _V, f"case when {_epic} then 'Voter ID Format Validation' else 'Non-Standard EPIC Format' end",
                   f"case when {_epic} then 'PASS' else 'FAIL' end", "'MEDIUM'", f"case when {_epic} then 0.90 else 0.65 end",
                   "coalesce(document_number, '')", "'AAA9999999'", "'epic_format'", "8", _DOCS, "document_type = 'VOTER_ID'")
_exp = f"(select *, case when zexp is not null then {day6('zexp')} else {day10('date_of_expiry')} end as d from {_DOCS} x)"
SQL["expiry"] = row("'DOCUMENT_EXPIRATION'", _V, f"case when d < {_TODAY} then 'Document Expired' else 'Document Expiration Check' end",
                    f"case when d < {_TODAY} then 'FAIL' else 'PASS' end", "'CRITICAL'", "case when d is null then 0.85 else 0.99 end",
                    iso("d"), f"case when d is not null then '{AS_OF}' end", "case when d is not null then 'expiry_date_vs_today' end", "28", _exp + " e")
_dob = f"(select *, {day6('zbirth')} as d from {_DOCS} x where zbirth is not null)"
SQL["birth"] = row(f"case when d is null then 'IMPOSSIBLE_DATE' when d > {_TODAY} then 'FUTURE_BIRTH_DATE' else 'BIRTH_DATE_PLAUSIBILITY' end", _V,
                   f"case when d is null then 'Impossible Date in MRZ' when d > {_TODAY} then 'Future Date of Birth' else 'Birth Date Plausibility' end",
                   f"case when d is null or d > {_TODAY} then 'FAIL' else 'PASS' end", "case when d is null then 'HIGH' else 'CRITICAL' end",
                   "case when d is null then 0.98 else 0.99 end", f"case when d is null then zbirth when d > {_TODAY} then {iso('d')} end",
                   f"case when d > {_TODAY} then '{AS_OF}' end", f"case when d is null then 'birth_date_raw' when d > {_TODAY} then 'dob_vs_today' end",
                   "case when d is null then 15 else 25 end", _dob + " e")
_a, _b = "upper(regexp_replace(document_number, '[^A-Za-z0-9]', '', 'g'))", "upper(regexp_replace(zn, '[^A-Za-z0-9]', '', 'g'))"
_agree = (f"({_a} = {_b} or (least(length({_a}), length({_b})) >= 5 and (contains({_a}, {_b}) or contains({_b}, {_a}))) or "
          f"(length({_a}) >= 6 and length({_b}) >= 6 and abs(length({_a}) - length({_b})) <= 1 and levenshtein({_a}, {_b}) <= 1))")
_both = "(document_number is not null and zn is not null)"
SQL["number"] = row("'DOC_NUMBER_CROSSCHECK'", _C, f"case when not {_both} or {_agree} then 'Document Number Crosscheck' else 'Document Number Inconsistency' end",
                    f"case when not {_both} then 'NOT_APPLICABLE' when {_agree} then 'PASS' else 'FAIL' end", "'HIGH'", f"case when {_both} then 0.95 else 0.5 end",
                    f"case when {_both} then document_number end", f"case when {_both} then zn end", f"case when {_both} then 'document_number' end", "22", _DOCS)
_missing = "concat_ws(', ', case when coalesce(full_name, zsurname) is null then 'Full Name' end, case when coalesce(document_number, zn) is null then 'Document Number' end)"
SQL["required"] = row("'REQUIRED_FIELDS_PRESENCE'", _V, f"case when {_missing} <> '' then 'Missing Mandatory Identity Fields' else 'Required Fields Presence' end",
                      f"case when {_missing} <> '' then 'FAIL' else 'PASS' end", "'MEDIUM'", f"case when {_missing} <> '' then 0.90 else 0.95 end",
                      f"nullif({_missing}, '')", f"case when {_missing} <> '' then 'Full Name, Document Number' end",
                      f"case when {_missing} <> '' then 'required_fields' end", "10", _DOCS)
_names = f"""(select *, coalesce(length(regexp_replace(nm, '[A-Za-z\\s''.\\-]', '', 'g')) / length(nm)::double > 0.15 or length(nm) > 80, false) as bad_name,
 coalesce(not regexp_matches(num, '[0-9]'), false) as bad_no from (select *, coalesce(full_name, nullif(trim(concat_ws(' ', case when has_mrz then given_names end, zsurname)), '')) as nm,
 coalesce(document_number, zn) as num from {_DOCS} x) y)"""
_odd = "concat_ws('; ', case when bad_name then 'name (''' || nm[1:60] || case when length(nm) > 60 then '…' else '' end || ''')' end, case when bad_no then 'document number (''' || num || ''')' end)"
SQL["plausible"] = row("'DOCUMENT_CONTENT_PLAUSIBILITY'", _V, "case when bad_name or bad_no then 'Extracted Content Does Not Resemble an Identity Document' else 'Extracted Content Plausibility' end",
                       "case when bad_name or bad_no then 'FAIL' else 'PASS' end", "'CRITICAL'", "0.80", f"nullif({_odd}, '')",
                       "case when bad_name or bad_no then 'plausible name / alphanumeric ID' end", "case when bad_name or bad_no then 'extracted_content_plausibility' end", "30", _names + " n")
_nat = "regexp_full_match(znat, '[A-Za-z]{3}')"
SQL["nationality"] = row("'NATIONALITY_CODE_FORMAT'", _V, f"case when {_nat} then 'Nationality Code Format' else 'Malformed Nationality Code' end",
                         f"case when {_nat} then 'PASS' else 'FAIL' end", "'MEDIUM'", f"case when {_nat} then 0.98 else 0.95 end", "znat",
                         "'3-letter ISO alpha code'", "'nationality_code'", "8", _DOCS, "znat is not null")
_sx = "zsex in ('M', 'F', 'X')"
SQL["sex"] = row("'SEX_CODE_FORMAT'", _V, f"case when {_sx} then 'Sex/Gender Code Format' else 'Malformed Sex/Gender Code' end",
                 f"case when {_sx} then 'PASS' else 'FAIL' end", "'MEDIUM'", f"case when {_sx} then 0.98 else 0.90 end", "zsex", "'M, F, or X'", "'sex_code'", "6", _DOCS, "zsex is not null")
_stay = f"(select *, {day10('stay_duration_until')} as d from {_DOCS} x where document_type = 'VISA')"
SQL["stay"] = row("'VISA_STAY_DURATION_VALIDATION'", _V, f"case when d < {_TODAY} then 'Visa Stay Duration Expired' else 'Visa Stay Duration Validation' end",
                  f"case when d < {_TODAY} then 'FAIL' else 'PASS' end", "'CRITICAL'", "case when d is null then 0.80 else 0.97 end", iso("d"),
                  f"case when d is not null then '{AS_OF}' end", "case when d is not null then 'stay_until_vs_today' end", "24", _stay + " e")
_ent = "(select *, upper(trim(coalesce(entry_validation, ''))) as e from " + _DOCS + " x where document_type = 'VISA')"
_ek = "e in ('SINGLE ENTRY', 'DOUBLE ENTRY', 'MULTIPLE ENTRY', 'TRANSIT')"
SQL["entry"] = row("'VISA_ENTRY_VALIDATION_CHECK'", _V, f"case when e = '' or {_ek} then 'Visa Entry Validation Check' else 'Unrecognized Visa Entry Validation Value' end",
                   f"case when e = '' or {_ek} then 'PASS' else 'FAIL' end", "'MEDIUM'", f"case when e = '' then 0.75 when {_ek} then 0.90 else 0.60 end", "nullif(e, '')",
                   "case when e <> '' then 'DOUBLE ENTRY, MULTIPLE ENTRY, SINGLE ENTRY, TRANSIT' end", "case when e <> '' then 'visa_entry_type' end", "8", _ent + " v")
_jur = f"""(select *, case when pc is not null then pc when zc is not null and sc is not null then zc end as cmp,
 case when pc is not null then pc = said when zc is not null and sc is not null then zc = sc end as ok from (select *, upper(trim(coalesce(declared_country, ''))) as said,
 nullif(upper(trim(country)), '') as pc, nullif(upper(trim(zcountry)), '') as zc, case upper(trim(coalesce(declared_country, ''))) when 'REPUBLIC OF UTOPIA' then 'UTO' when 'DEMO STATE' then 'DEM'
 when 'ATLANTIS FEDERATION' then 'ATL' when 'INDIA' then 'IND' when 'UNITED KINGDOM' then 'GBR' end as sc from {_DOCS} x) y where said not in ('', 'UNKNOWN'))"""
SQL["jurisdiction"] = row("'JURISDICTION_COUNTRY_CROSSCHECK'", _C, "case when cmp is null or ok then 'Declared Jurisdiction Crosscheck' else 'Declared Jurisdiction Does Not Match Document' end",
                          "case when cmp is null then 'NOT_APPLICABLE' when ok then 'PASS' else 'FAIL' end", "'HIGH'", "case when cmp is null then 0.5 when ok then 0.90 else 0.85 end",
                          "cmp", "case when cmp is not null then said end", "case when cmp is not null then 'issuing_country' end", "15", _jur + " j")
ALL_RULES = " union all ".join(SQL[r] for r in rules.RULES)


def _rule(key: str, names: list[str]) -> None:
    @add(key, ["fx_rule_docs"], " union all ".join(SQL[n] for n in names))
    def _(docs):
        return shown(rules.evaluate_rules(with_zone(docs), AS_OF, rules=names))


@add("d1_parse_dates", ["fx_rule_docs"],
     f"select doc_id, {iso(day6('birth_date'))} as born, {iso(day6('expiry_date'))} as expires, {iso(day10('date_of_expiry'))} as printed, {iso(day10('stay_duration_until'))} as stay from @fx_rule_docs r")
def _(docs):
    six, ten = lambda c: dates.iso_day(dates.yymmdd(F.col(c))), lambda c: dates.iso_day(dates.ddmmyyyy(F.col(c)))
    return docs.select("doc_id", six("birth_date").alias("born"), six("expiry_date").alias("expires"),
                       ten("date_of_expiry").alias("printed"), ten("stay_duration_until").alias("stay"))


@add("d2_mrz_checksum_rules", ["fx_mrz_lines"],
     row("'MRZ_' || replace(upper(field), ' ', '_')", _M, "case when valid then field else 'MRZ Checksum Mismatch (' || field || ')' end",
         "case when valid then 'PASS' else 'FAIL' end", "'HIGH'", "0.99", "check_digit", "calculated_check_digit", "'check_digit'", "18", f"({CHECKSUMS}) c"))
def _(lines):
    blank = {c: F.lit(None).cast("string") for c in ("full_name", "document_number", "country", "date_of_expiry", "entry_validation", "stay_duration_until", "declared_country")}
    docs = mrz.parse_mrz_lines(lines, "TD3").withColumns({**blank, "document_type": F.lit("PASSPORT")})
    return shown(rules.evaluate_rules(docs, AS_OF, rules=["checksums"]))


for _key, _names_ in {
    "d2_mrz_presence": ["checksums"], "d3_pan_format": ["pan"], "d4_voter_id_format": ["voter"], "d5_document_expiration": ["expiry"],
    "d6_birth_date_rules": ["birth"], "d7_doc_number_crosscheck": ["number"], "d8_required_fields": ["required"],
    "d9_content_plausibility": ["plausible"], "d10_nationality_code": ["nationality"], "d11_sex_code": ["sex"],
    "d12_visa_rules": ["stay", "entry"], "d13_jurisdiction_crosscheck": ["jurisdiction"],
}.items():
    _rule(_key, _names_)


@add("d_all_rules", ["fx_rule_docs"], ALL_RULES)
def _(docs):
    return shown(rules.evaluate_rules(with_zone(docs), AS_OF))


@add("d14_rule_counts", ["fx_rule_docs"],
     f"select doc_id, count(*) filter (where status = 'PASS') as passed_count, count(*) filter (where status = 'FAIL') as failed_count from ({ALL_RULES}) a group by doc_id")
def _(docs):
    return rules.rule_counts(rules.evaluate_rules(with_zone(docs), AS_OF))


# --- E: signals ----------------------------------------------------------------------------

SCORES = f"""(select case_id, score as tamper_risk, case when score >= 0.85 then 'CRITICAL' when score >= 0.70 then 'HIGH' when score >= 0.40 then 'MEDIUM' else 'LOW' end as tamper_level from (
 select case_id, least(0.96::double, greatest(0.04::double, {py_round('cast(cast(greatest(ela * 2.0::double, cnn * 0.85::double) + coalesce(added, 0)::double as decimal(18,6)) as double)', 2)})) as score from (
 select case_id, max(mean_ela) as ela, max(cnn_prob) as cnn, cast(sum(case when type <> 'compression_anomaly' then cast(confidence * 0.25::double as decimal(18,6)) end) as double) as added
 from @fx_signals s group by case_id) a) b)"""


@add("e1_tamper_score", ["fx_signals"], f"select case_id, tamper_risk from {SCORES} s")
def _(sig):
    return signals.tamper_score(sig, sig).select("case_id", "tamper_risk")


@add("e2_tamper_tier", ["fx_signals"], f"select tamper_level, count(*) as n from {SCORES} s group by tamper_level")
def _(sig):
    return signals.tamper_score(sig, sig).groupBy("tamper_level").agg(F.count("*").alias("n"))


_MEAS_SCORE = f"""(select case_id, mean_ela, document_type, mrz_mean, upper_mean, case when score >= 0.85 then 'CRITICAL' when score >= 0.70 then 'HIGH' when score >= 0.40 then 'MEDIUM' else 'LOW' end as lvl from (
 select m.*, least(0.96::double, greatest(0.04::double, {py_round('cast(cast(m.mean_ela * 2.0::double + coalesce(added, 0)::double as decimal(18,6)) as double)', 2)})) as score
 from @fx_measures m left join (select case_id, cast(sum(case when type <> 'compression_anomaly' then cast(confidence * 0.25::double as decimal(18,6)) end) as double) as added from @fx_signals s group by case_id) a
 on a.case_id = m.case_id) b)"""
_SEV = lambda conf: f"case when lvl = 'CRITICAL' then 'CRITICAL' when {conf} > 0.85 then 'HIGH' else 'MEDIUM' end"
_ELAC = f"least(0.92::double, {py_round('mean_ela * 3.5::double', 2)})"
_RATIO = "(abs(mrz_mean - upper_mean) / (upper_mean + 0.00001::double))"
_ZONE = "(document_type not in ('AADHAAR', 'PAN', 'DRIVING_LICENSE', 'VOTER_ID', 'VISA', 'PERMIT'))"
_TORN = f"({_ZONE} and {_RATIO} > 0.85 and mrz_mean > 35)"
_FAMS = {"splice": ("TAMPER_EDGE_DISCONTINUITY", "Boundary / Edge Splicing Scan", 0.85, "'edge_discontinuity', 'stamp_forgery'"),
         "portrait": ("TAMPER_PHOTO_BOUNDARY_ANOMALY", "Portrait Boundary Scan", 0.85, "'photo_boundary_anomaly'"),
         "exif": ("TAMPER_EXIF_METADATA", "EXIF Metadata Consistency", 0.80, "'exif_metadata_missing', 'exif_editing_software', 'exif_date_inconsistency'")}
_TITLE = {"edge_discontinuity": "Edge Discontinuity", "photo_boundary_anomaly": "Photo Boundary Anomaly", "exif_metadata_missing": "Exif Metadata Missing"}
_TCHECKS = " union all ".join(
    [f"""select case_id, 'TAMPER_ELA' as check_key, 'Error Level Analysis' as label, case when mean_ela > 0.22 then 'FAIL' else 'PASS' end as status, case when mean_ela > 0.22 then {_SEV(_ELAC)} end as severity,
 case when mean_ela > 0.22 then {_ELAC} else 0.9::double end as confidence, cast({py_round('mean_ela', 3)} as string) as measured_value, case when mean_ela > 0.22 then {py_round(_ELAC + ' * 18.0::double', 1)} else 0.0::double end as score_impact from {_MEAS_SCORE} m""",
     f"""select case_id, 'TAMPER_TEXT_COMPRESSION_ANOMALY', 'Text/MRZ Compression Consistency', case when not {_ZONE} then 'NOT_APPLICABLE' when {_TORN} then 'FAIL' else 'PASS' end,
 case when {_TORN} then {_SEV('0.82')} end, case when not {_ZONE} then 0.95::double when {_TORN} then 0.82::double else 0.8::double end, case when {_ZONE} then format('{{}}', {py_round(_RATIO, 3)}) end, case when {_TORN} then 14.8::double else 0.0::double end from {_MEAS_SCORE} m"""]
    + [f"select case_id, '{k}', '{l}', 'PASS', null, {c}::double, null, 0.0::double from {_MEAS_SCORE} m where case_id not in (select case_id from @fx_signals s where type in ({t}))" for k, l, c, t in _FAMS.values()]
    + [f"""select s.case_id, 'TAMPER_' || upper(type), 'Forensic Anomaly (' || case type {' '.join(f"when '{k}' then '{v}'" for k, v in _TITLE.items())} end || ')', 'FAIL', {_SEV('confidence')}, confidence, null, {py_round('confidence * 18.0::double', 1)}
 from @fx_signals s join {_MEAS_SCORE} m on m.case_id = s.case_id where type in ({', '.join(repr(k) for k in _TITLE)})"""]
)


@add("e3_tamper_checks", ["fx_measures", "fx_signals"], _TCHECKS)
def _(measures, sig):
    tiers = signals.tamper_score(measures, sig)
    return signals.tamper_checks(measures, sig, tiers).select(
        "case_id", "check_key", "label", "status", "severity", "confidence", "evidence.measured_value", "score_impact"
    )


@add("e4_ela_signal", ["fx_measures"], f"select case_id, 'compression_anomaly' as type, {_ELAC} as confidence from @fx_measures m where mean_ela > 0.22")
def _(measures):
    return signals.ela_signal(measures).select("case_id", "type", "confidence")


BOXES = f"""(select * from (select *, row_number() over (partition by image_id order by box_no) as rn from @fx_boxes b
 where not is_qr and w * h > 1500 and w * h < 70000 and w > 35 and h > 18 and greatest(w, h) / least(w, h)::double <= 8.0 and variance > 1400
 and not exists (select 1 from @fx_boxes q where q.is_qr and q.image_id = b.image_id
  and greatest(0, least(b.x + b.w, q.x + q.w) - greatest(b.x, q.x)) * greatest(0, least(b.y + b.h, q.y + q.h) - greatest(b.y, q.y)) > 0.5 * b.w * b.h)) z where rn <= 5)"""
_SHAPE = "case when greatest(w, h) / least(w, h)::double between 2.2 and 4.2 then 'stamp_forgery' else 'edge_discontinuity' end"


@add("e5_splice_boxes", ["fx_boxes"],
     f"select image_id, box_no, x, y, w, h, least(0.95::double, {py_round('0.65::double + variance / 5000', 2)}) as confidence, {py_round('variance', 1)} as roi_variance from {BOXES} b")
def _(boxes):
    return signals.splice_boxes(boxes.where("not is_qr"), boxes.where("is_qr")).drop("type")


@add("e6_splice_shape", ["fx_boxes"], f"select {_SHAPE} as type, count(*) as n from {BOXES} b group by 1")
def _(boxes):
    return signals.splice_boxes(boxes.where("not is_qr"), boxes.where("is_qr")).groupBy("type").agg(F.count("*").alias("n"))


@add("e7_portrait_boundary", ["fx_measures"],
     f"select case_id, 'photo_boundary_anomaly' as type, 0.86::double as confidence, {py_round('edge_density', 3)} as measured from @fx_measures m where edge_density > 0.18 or border_var > 9000")
def _(measures):
    return signals.portrait_boundary(measures).select("case_id", "type", "confidence", "measured")


@add("e8_text_compression", ["fx_measures"],
     f"""select case_id, case when not {_ZONE} then 'NOT_APPLICABLE' when {_TORN} then 'FAIL' else 'PASS' end as status, case when {_ZONE} then {py_round(_RATIO, 3)} end as ratio,
 case when {_TORN} then 0.82::double end as confidence from @fx_measures m""")
def _(measures):
    return signals.text_compression(measures)


_REG = f"""select r.case_id, 'TAMPER_CNN_' || upper(region_name) || '_REGION' as check_key, case when probability >= 0.5 then 'FAIL' else 'PASS' end as status,
 case when probability >= 0.5 then case when lvl = 'CRITICAL' then 'CRITICAL' when probability > 0.85 then 'HIGH' else 'MEDIUM' end end as severity,
 case when probability >= 0.5 then probability else 1.0::double - probability end as confidence, case when probability >= 0.5 then {py_round('probability * 18.0::double', 1)} else 0.0::double end as score_impact
 from @fx_regions r join (select case_id, case when s >= 0.85 then 'CRITICAL' when s >= 0.70 then 'HIGH' when s >= 0.40 then 'MEDIUM' else 'LOW' end as lvl from (
  select m.case_id, least(0.96::double, greatest(0.04::double, {py_round('cast(cast(greatest(max(mean_ela) * 2.0::double, max(probability) * 0.85::double) as decimal(18,6)) as double)', 2)})) as s
  from @fx_measures m join @fx_regions g on g.case_id = m.case_id group by m.case_id) a) t on t.case_id = r.case_id"""


@add("e9_cnn_region_checks", ["fx_measures", "fx_regions"], _REG)
def _(measures, regions):
    with_cnn = measures.join(signals.region_max(regions), "case_id", "left")
    none = measures.select("case_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence")).limit(0)
    tiers = signals.tamper_score(with_cnn, none)
    return signals.region_checks(regions, tiers).select("case_id", "check_key", "status", "severity", "confidence", "score_impact")


_EXIF_GAP = "(epoch(try_strptime(modified, '%Y:%m:%d %H:%M:%S')) - epoch(try_strptime(coalesce(original, digitized), '%Y:%m:%d %H:%M:%S'))) / 3600.0::double"
_NOTAG = "(software is null and modified is null and original is null and digitized is null)"
EXIF = f"""(select case_id, 'exif_metadata_missing' as type, 0.35::double as confidence from @fx_exif x where {_NOTAG}
 union all select case_id, 'exif_editing_software', 0.85::double from @fx_exif x where regexp_matches(upper(software), 'PHOTOSHOP|GIMP|PAINT\\.NET|AFFINITY PHOTO|LIGHTROOM|SNAPSEED|PIXLR|CANVA|PICSART')
 union all select case_id, 'exif_date_inconsistency', least(0.9::double, {py_round(f'0.6::double + {_EXIF_GAP} / 500.0::double', 2)}) from @fx_exif x where {_EXIF_GAP} > 24)"""


def tags(images):
    """The tag map a reader would have produced, without absent tags."""
    pairs = {fixed.EXIF_SOFTWARE: "software", fixed.EXIF_DATETIME: "modified", fixed.EXIF_ORIGINAL: "original", fixed.EXIF_DIGITIZED: "digitized"}
    full = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))])
    return images.select("case_id", F.map_filter(full, lambda k, v: v.isNotNull()).alias("tags"))


@add("e10_exif_signals", ["fx_exif"], f"select * from {EXIF} e")
def _(images):
    return signals.exif_signals(tags(images)).select("case_id", "type", "confidence")


_FACE_STATUS = "case when doc_faces = 0 then 'NO_FACE_DETECTED' when doc_faces > 1 then 'MULTIPLE_FACES' when live_faces = 0 then 'NO_FACE_DETECTED' when live_faces > 1 then 'MULTIPLE_FACES' when similarity >= 0.72 then 'MATCH' else 'REVIEW_REQUIRED' end"
FACES = f"(select *, {_FACE_STATUS} as fs from @fx_faces f)"


@add("e11_face_status", ["fx_faces"],
     f"""select case_id, fs as face_status, case when fs in ('MATCH', 'REVIEW_REQUIRED') then {py_round('similarity', 3)} else 0.0::double end as face_similarity,
 case when fs in ('MATCH', 'REVIEW_REQUIRED') then 'FACE_BIOMETRIC_MATCH' when doc_faces = 0 then 'FACE_DOCUMENT_PORTRAIT_DETECTION' when doc_faces > 1 then 'FACE_DOCUMENT_FACE_COUNT'
  when live_faces = 0 then 'FACE_LIVE_CAPTURE_DETECTION' else 'FACE_LIVE_CAPTURE_FACE_COUNT' end as check_key,
 case when fs = 'MATCH' then 'PASS' else 'FAIL' end as status, case when fs = 'MATCH' then null when fs = 'MULTIPLE_FACES' then 'MEDIUM' else 'HIGH' end as severity,
 case when fs = 'MATCH' then {py_round('similarity', 2)} when fs = 'REVIEW_REQUIRED' then {py_round('1.0::double - similarity', 2)} when fs = 'NO_FACE_DETECTED' then 0.90::double when doc_faces > 1 then 0.85::double else 0.95::double end as confidence,
 case when fs = 'MATCH' then 0.0::double when fs = 'REVIEW_REQUIRED' then 25.0::double when fs = 'NO_FACE_DETECTED' then 20.0::double else 15.0::double end as score_impact from {FACES} f""")
def _(faces):
    return signals.face_status(faces).select("case_id", "face_status", "face_similarity", "check_key", "status", "severity", "confidence", "score_impact")


_QUALITY = f"""(select case_id, mean_brightness < 45 as is_dark, mean_brightness > 220 as is_overexposed, sharpness < 35 as is_blurry, concentration >= 0.25 as artifact_detected,
 {py_round('greatest(0.20::double, 0.95::double - (case when sharpness < 35 then 0.25::double else 0.0::double end) - (case when mean_brightness < 45 or mean_brightness > 220 then 0.15::double else 0.0::double end) - (case when concentration >= 0.25 then 0.35::double else 0.0::double end))', 2)} as liveness_score
 from @fx_faces f)"""


@add("e12_face_quality", ["fx_faces"], f"select * from {_QUALITY} q")
def _(faces):
    return signals.face_quality(faces).drop("mean_brightness", "sharpness", "concentration")


@add("e12_face_quality_checks", ["fx_faces"],
     f"""select case_id, unnest(['FACE_QUALITY_BRIGHTNESS', 'FACE_QUALITY_SHARPNESS', 'FACE_QUALITY_MOIRE']) as check_key,
 unnest([case when is_dark or is_overexposed then 'FAIL' else 'PASS' end, case when is_blurry then 'FAIL' else 'PASS' end, case when artifact_detected then 'FAIL' else 'PASS' end]) as status,
 unnest([case when is_dark or is_overexposed then 2.5::double else 0.0::double end, case when is_blurry then 2.5::double else 0.0::double end, case when artifact_detected then 5.0::double else 0.0::double end]) as score_impact from {_QUALITY} q""")
def _(faces):
    return signals.face_quality_checks(faces).select("case_id", "check_key", "status", "score_impact")


@add("e13_top_k_energy_share", ["fx_bins"],
     f"""select i.image_id, {py_round('coalesce(case when total > 0 then top / total end, 0.0::double)', 3)} as concentration, coalesce(case when total > 0 then top / total end, 0.0::double) >= 0.25 as artifact_detected
 from (select distinct image_id from @fx_bins b) i left join (select image_id, sum(magnitude * magnitude) as total, sum(case when rn <= 8 then magnitude * magnitude end) as top from (
 select *, row_number() over (partition by image_id order by magnitude desc, bin_no) as rn from @fx_bins b where radius >= 0.12 and radius < 0.55) a group by image_id) t on t.image_id = i.image_id""")
def _(bins):
    return signals.top_bin_share(bins)


@add("e14_face_status_portraits", ["fx_captures"],
     f"""select case_id, case when case_id % 11 = 0 then 0.0::double else {py_round('s', 3)} end as similarity, case when case_id % 11 = 0 then 'NO_FACE_DETECTED' when s >= 0.72 then 'SAME_PORTRAIT' else 'PORTRAIT_CHANGED' end as portrait_status
 from (select case_id, greatest(0.0::double, least(1.0::double, (list_cosine_similarity(list_transform(doc_embedding, lambda x: x::double), live_embedding) + 1.0::double) / 2.0::double)) as s from @fx_captures c) x""")
def _(captures):
    pairs = captures.select(
        "case_id", F.col("doc_embedding").alias("embedding_a"), F.col("live_embedding").alias("embedding_b"),
        F.when(F.col("case_id") % 11 == 0, 0).otherwise(1).alias("faces_a"), F.lit(1).alias("faces_b"),
    )
    return signals.portrait_comparison(pairs)
