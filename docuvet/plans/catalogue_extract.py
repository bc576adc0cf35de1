"""Sources, field extraction and machine-readable zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, mrz as zone
from ..functions.text import body_of, lines_of, printed_date, value_after_fuzzy_label, value_after_label
from ..operators import extract, mrz
from ..sources import annotations, manifests, published, store
from ..session import materialize, scratch_dir, spread
from .harness import Catalogue, py_round

CATALOGUE = Catalogue()
add = CATALOGUE.add

# --- oracle building blocks ---------------------------------------------------------

# Document text as a list of stripped lines.
LINES = """(select doc_id, raw_text, list_filter(list_transform(string_split(raw_text, chr(10)), lambda s: trim(s)), lambda s: s <> '') as lines
 from @fx_ocr_text t)"""


def after(label: str, unless: list[str] | None = None) -> str:
    """Oracle expression: the line under the first matching line that has one."""
    skip = "".join(f" and not contains(upper(lines[i]), '{w}')" for w in unless or [])
    return f"lines[list_filter(range(1, len(lines)), lambda i: regexp_matches(lines[i], '{label}', 'i'){skip})[1] + 1]"


def near(words: list[str]) -> str:
    tests = " and ".join(
        f"len(list_filter(regexp_extract_all(upper(lines[i]), '[A-Z0-9]+'), lambda w: levenshtein(w, '{w}') <= {2 if len(w) >= 5 else 1})) > 0"
        for w in words
    )
    return f"lines[list_filter(range(1, len(lines)), lambda i: {tests})[1] + 1]"


def date_of(value: str) -> str:
    pat = r"(\d{1,2})\D{0,2}(\d{1,2})\D{0,2}(\d{4})"
    g = lambda n: f"regexp_extract({value}, '{pat}', {n})"
    return (
        f"(case when {g(3)} between '1900' and '2099' then lpad({g(1)}, 2, '0') || '/' || lpad({g(2)}, 2, '0') || '/' || {g(3)} end)"
    )


def found(value: str, pattern: str) -> str:
    return f"nullif(regexp_extract({value}, '{pattern}', 1), '')"


_KIND = "case " + " ".join(
    "when " + " or ".join(f"contains(upper(raw_text), '{m}')" for m in markers) + f" then '{kind}'"
    for kind, markers in fixed.DOCUMENT_MARKERS.items()
) + " else 'PASSPORT' end"

TYPED = f"(select *, {_KIND} as document_type from {LINES} l)"

# --- A: sources ------------------------------------------------------------------------


@add("a1_load_store", ["fx_audit"],
     """select seq, action, cast(json_extract(metadata, '$.k') as integer) as k from @fx_audit a""")
def _(audit):
    root = scratch_dir(audit.sparkSession, "case-store")
    rows = audit.withColumns({"event_ts": F.col("event_ts").cast("timestamp"), "previous_hash": F.lit(None).cast("string"), "entry_hash": F.lit(None).cast("string")})
    rows.write.parquet(f"{root}/audit_logs")
    held = store.load_table(audit.sparkSession, root, "audit_logs")
    return store.typed_json(held, {"metadata": "struct<k:int>"}).select("seq", "action", "metadata.k")


@add("a2_ocr_lines", ["fx_ocr_text"],
     f"select doc_id, i as line_no, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from {LINES} l) x")
def _(docs):
    return extract.ocr_lines(docs)


@add("a2_ocr_lines_of_documents", ["documents"],
     r"""select doc_id, count(*) as n_lines, sum(length(line)) as n_chars from (select doc_id, unnest(list_filter(list_transform(
 string_split(text, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) as line from documents) x group by doc_id""")
def _(documents):
    lines = extract.ocr_lines(documents.select("doc_id", F.col("text").alias("raw_text")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_FLAT = """select 'type' || cast(c_nationkey as string) as doctype, cast(c_custkey as string) || '.jpg' as filename,
 upper(c_mktsegment) as surname, 'X' || lpad(cast(c_custkey as string), 7, '0') as number from customer"""


@add("a3_via_annotations", ["fx_annotations"], _FLAT)
def _(files):
    return annotations.via_annotations(files, ["surname", "number"])


_RESOLVED = """select f.image, f.src, f.field, case when r.x is not null then r.x end as x, r.y, r.w, r.h, r.x is not null as resolved
 from @fx_forgeries f left join (
  select 'type' || cast(c_nationkey as string) || '_' || cast(c_custkey as string) || '.jpg' as src, 'surname' as field, cast(c_custkey % 50 as int) as x, 10 as y, 80 as w, 20 as h from customer
  union all select 'type' || cast(c_nationkey as string) || '_' || cast(c_custkey as string) || '.jpg', 'number', 5, 200, 400, 18 from customer) r
 on r.src = f.src and r.field = f.field"""


@add("a4_resolve_tamper_regions", ["fx_forgeries", "fx_annotations"], _RESOLVED)
def _(forgeries, files):
    resolved = annotations.resolve_tamper_regions(forgeries, annotations.via_regions(files))
    return resolved.drop("img_w", "img_h")


@add("a4_resolution_counts", ["fx_forgeries", "fx_annotations"],
     f"select count(*) filter (where resolved) as resolved, count(*) filter (where not resolved) as unresolved from ({_RESOLVED}) x")
def _(forgeries, files):
    return annotations.resolution_counts(annotations.resolve_tamper_regions(forgeries, annotations.via_regions(files)))


@add("a5_identity_manifest", ["fx_paths", "fx_face_csv"],
     r"""select path, 'FGNET:' || regexp_extract(split_part(path, '/', -1), '^(\d{3})[Aa](\d{2})', 1) as identity from @fx_paths p
 where contains(path, '/fgnet/') and upper(path) like '%.JPG' and regexp_matches(split_part(path, '/', -1), '^(\d{3})[Aa](\d{2})')
 union all select path, 'YLFW:' || split_part(path, '/', -2) from @fx_paths p where contains(path, '/ylfw/') and regexp_matches(lower(path), '\.(jpg|jpeg|png|bmp)$')
 union all select file_name, 'CALFW:' || identity from @fx_face_csv c""")
def _(paths, metadata):
    listing = scratch_dir(metadata.sparkSession, "face-listing")
    metadata.write.option("header", "true").csv(listing)
    metadata = manifests.read_metadata_csv(metadata.sparkSession, listing)
    return manifests.identity_manifest(
        paths.where(F.contains("path", F.lit("/fgnet/"))), paths.where(F.contains("path", F.lit("/ylfw/"))), metadata
    )


@add("a6_upload_manifest", ["fx_uploads"],
     r"""select filename, file_size, extension, format, reason is null as accepted, reason from (
 select *, case when extension not in ('.jpg', '.jpeg', '.png', '.webp') then 'EXTENSION' when file_size > 10485760 then 'TOO_LARGE'
  when file_size = 0 then 'EMPTY' when format is null then 'NOT_AN_IMAGE' when format not in ('JPEG', 'PNG', 'WEBP') then 'FORMAT' end as reason
 from (select filename, file_size, lower(regexp_extract(filename, '[^.](\.[^.]+)$', 1)) as extension,
  case when head_hex like 'FFD8FF%' then 'JPEG' when head_hex like '89504E470D0A1A0A%' then 'PNG'
   when head_hex like '52494646%' and substring(head_hex, 17, 8) = '57454250' then 'WEBP' when head_hex like '47494638%' then 'GIF' end as format
  from @fx_uploads u) a) b""")
def _(uploads):
    return manifests.upload_manifest(uploads.withColumn("content", F.unhex("head_hex")))


@add("a7_insert_if_absent", ["fx_watchlist", "supplier"],
     """select watchlist_id, name, document_number, severity from @fx_watchlist w where active
 union all select 'WL-' || lpad(cast(s_suppkey as string), 6, '0'), upper(s_name), 'Z' || cast(s_suppkey as string), 'LOW' from supplier
 where 'WL-' || lpad(cast(s_suppkey as string), 6, '0') not in (select watchlist_id from @fx_watchlist w where active)""")
def _(watchlist, supplier):
    existing = watchlist.where("active").select("watchlist_id", "name", "document_number", "severity")
    incoming = supplier.select(
        F.concat(F.lit("WL-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("watchlist_id"),
        F.upper("s_name").alias("name"), F.concat(F.lit("Z"), F.col("s_suppkey")).alias("document_number"),
        F.lit("LOW").alias("severity"),
    )
    return store.insert_if_absent(existing, incoming.unionByName(incoming), "watchlist_id")


_REPLACED = """select case_id, label, status from @fx_checks c where case_id not in (select case_id from @fx_measures m where mean_ela > 0.22)
 union all select case_id, 'Error Level Analysis', 'FAIL' from @fx_measures m where mean_ela > 0.22"""


@add("a8_replace_per_case", ["fx_checks", "fx_measures"], _REPLACED)
def _(checks, measures):
    new = measures.where("mean_ela > 0.22").select(
        "case_id", F.lit("Error Level Analysis").alias("label"), F.lit("FAIL").alias("status")
    )
    return store.replace_per_case(checks.select("case_id", "label", "status"), new)


@add("a8_published_replacement", ["fx_checks", "fx_measures"], _REPLACED)
def _(checks, measures):
    spark, schema = checks.sparkSession, "case_id long, label string, status string"
    root = scratch_dir(spark, "published")
    typed = lambda df: df.select(F.col("case_id").cast("long").alias("case_id"), "label", "status")
    published.publish(typed(checks), root, buckets=16)
    new = measures.where("mean_ela > 0.22").select("case_id", F.lit("Error Level Analysis").alias("label"), F.lit("FAIL").alias("status"))
    published.replace_cases(typed(new), root, schema, buckets=16)
    return published.read_published(spark, root, schema)


_LABELLED = """select path, meta is not null as has_sidecar, case when meta is null then regexp_matches(lower(path), 'fraud|forg')
 when not json_valid(meta) then false
 else coalesce(json_extract_string(meta, '$.fraud_type'), '') <> '' or coalesce(json_extract_string(meta, '$.is_fraud'), 'false') <> 'false'
  or coalesce(json_extract_string(meta, '$.fraud'), 'false') not in ('false', '0') end as is_fraud from @fx_labelled_images i"""


def _sidecars(images):
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    return images.where("meta is not null").select(stem.alias("stem"), "meta")


@add("a9_image_label_manifest", ["fx_labelled_images"], _LABELLED)
def _(images):
    return manifests.image_labels(images.select("path"), _sidecars(images))


@add("a9_label_counts", ["fx_labelled_images"],
     f"select count(*) filter (where is_fraud) as fraud_images, count(*) filter (where not is_fraud) as authentic_images from ({_LABELLED}) x")
def _(images):
    return manifests.label_counts(manifests.image_labels(images.select("path"), _sidecars(images)))


# --- B: field extraction -----------------------------------------------------------------


@add("b1_detect_document_type", ["fx_ocr_text"], f"select doc_id, document_type from {TYPED} d")
def _(docs):
    return docs.select("doc_id", extract.document_type(F.col("raw_text")).alias("document_type"))


@add("b1_detect_type_of_pages", ["pages"],
     f"select page_id, {_KIND.replace('raw_text', 'html')} as document_type from pages")
def _(pages):
    return pages.select("page_id", extract.document_type(F.col("html")).alias("document_type"))


@add("b2_value_after_label", ["fx_ocr_text"],
     f"select doc_id, {after(chr(92) + 'bNAME' + chr(92) + 'b')} as under_name, {after('EXPIRATION' + chr(92) + 'b')} as under_expiry from {LINES} l")
def _(docs):
    body = body_of(F.col("raw_text"))
    return docs.select(
        "doc_id", value_after_label(body, r"\bNAME\b").alias("under_name"),
        value_after_label(body, r"EXPIRATION\b").alias("under_expiry"),
    )


@add("b3_value_after_fuzzy_label", ["fx_ocr_text"],
     f"select doc_id, {near(['VALID', 'TILL'])} as valid_till, {near(['VISA', 'NUMBER'])} as visa_number from {LINES} l")
def _(docs):
    lines = lines_of(body_of(F.col("raw_text")))
    return spread(docs).select(
        "doc_id", value_after_fuzzy_label(lines, ["VALID", "TILL"]).alias("valid_till"),
        value_after_fuzzy_label(lines, ["VISA", "NUMBER"]).alias("visa_number"),
    )


@add("b4_extract_date", ["fx_ocr_text"],
     f"select doc_id, i as line_no, {date_of('lines[i]')} as found from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from {LINES} l) x")
def _(docs):
    return extract.ocr_lines(docs).select("doc_id", "line_no", printed_date(F.col("line")).alias("found"))


# RE2 has no look-around: clusters are cut at every character that is neither digit nor space.
_AADHAAR = r"""(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(raw_text, '\s', ' ', 'g') || ' ', '(?:^|[^\d/])\d(?: ?\d){8,19}(?:[^\d/]|$)'),
 lambda s: regexp_replace(s, '[^0-9]', '', 'g')), lambda d: length(d) = 12)[1])"""


@add("b5_aadhaar_number", ["fx_ocr_text"], f"select doc_id, {_AADHAAR} as aadhaar_number from {LINES} l")
def _(docs):
    return docs.select("doc_id", extract.aadhaar_number(F.col("raw_text")).alias("aadhaar_number"))


_BIRTH = (
    "list_filter(list_transform(range(1, len(lines) + 1), lambda i: case when regexp_matches(lines[i], '\\b(DOB|DATE OF BIRTH)\\b', 'i') "
    f"then coalesce({date_of('lines[i]')}, {date_of('lines[i + 1]')}) end), lambda d: d is not null)[1]"
)
_AADHAAR_NAME = (
    "list_filter(lines[1:15], lambda s: length(s) > 4 and contains(s, ' ') and regexp_full_match(s, '[A-Za-z.''\\- ]+') "
    "and not regexp_matches(s, '\\b(DOB|DATE OF BIRTH|MALE|FEMALE|TRANSGENDER)\\b', 'i') "
    "and not regexp_matches(upper(s), 'GOVERNMENT|UNIQUE|IDENTIFICATION|AUTHORITY|AADHAAR|ENROLMENT|UIDAI') "
    "and (s = upper(s) or regexp_full_match(s, '[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]+)*([A-Z][a-z]*)?[^A-Za-z]*')))[1]"
)


def sex_of(other: str) -> str:
    word = f"upper(regexp_extract(raw_text, '\\b(MALE|FEMALE|{other})\\b', 1, 'i'))"
    return f"(case {word} when 'MALE' then 'M' when 'FEMALE' then 'F' when '' then null else 'X' end)"


_B = chr(92) + "b"
_LICENCE = r"\b([A-Z]{2})[\s-]?(\d{2})[\s-]?(\d{4})[\s-]?(\d{7})\b"
PER_TYPE = {
    "AADHAAR": {"document_number": _AADHAAR, "full_name": _AADHAAR_NAME, "date_of_birth": _BIRTH, "sex": sex_of("TRANSGENDER"),
                "nationality": "'INDIA'", "country": "'INDIA'"},
    "PAN": {"document_number": found("upper(raw_text)", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), "full_name": after(_B + "NAME" + _B, ["FATHER"]),
            "date_of_birth": date_of(after(_B + "DATE OF BIRTH" + _B)), "nationality": "'INDIA'", "country": "'INDIA'"},
    "DRIVING_LICENSE": {
        "document_number": "nullif(" + " || ".join(f"regexp_extract(upper(raw_text), '{_LICENCE}', {g})" for g in (1, 2, 3, 4)) + ", '')",
        "full_name": after(_B + "NAME" + _B), "date_of_birth": date_of(after(_B + "DATE OF BIRTH" + _B)),
        "date_of_issue": date_of(f"coalesce({after(_B + 'VALID FROM' + _B)}, {near(['VALID', 'FROM'])})"),
        "date_of_expiry": date_of(f"coalesce({after(_B + 'VALID TILL' + _B)}, {near(['VALID', 'TILL'])})"),
        "nationality": "'INDIA'", "country": "'INDIA'"},
    "VOTER_ID": {"document_number": found("upper(raw_text)", r"\b([A-Z]{3}[0-9]{7})\b"),
                 "full_name": after(_B + "NAME" + _B, ["FATHER", "HUSBAND", "MOTHER"]),
                 "date_of_birth": date_of(after(_B + "DATE OF BIRTH" + _B)), "sex": sex_of("THIRD GENDER"),
                 "nationality": "'INDIA'", "country": "'INDIA'"},
    "VISA": {"document_number": f"coalesce({after(_B + 'VISA NUMBER' + _B)}, {near(['VISA', 'NUMBER'])})",
             "full_name": after(_B + "FULL NAME" + _B), "nationality": after(_B + "NATIONALITY" + _B),
             "country": "'REPUBLIC OF UTOPIA'", "date_of_birth": date_of(after(_B + "DATE OF BIRTH" + _B)),
             "visa_type": after(_B + "VISA TYPE" + _B), "entry_validation": after(_B + "ENTRY VALIDATION" + _B),
             "date_of_issue": date_of(after(_B + "DATE OF ISSUE" + _B)),
             "stay_duration_until": date_of(after(_B + "STAY DURATION" + _B))},
    "PERMIT": {"document_number": f"coalesce({after(_B + 'PERMIT NUMBER' + _B)}, {near(['PERMIT', 'NUMBER'])})",
               "full_name": after(_B + "FULL NAME" + _B), "nationality": after(_B + "NATIONALITY" + _B),
               "country": "'REPUBLIC OF UTOPIA'", "date_of_birth": date_of(after(_B + "DATE OF BIRTH" + _B)),
               "permit_type": after(_B + "PERMIT TYPE" + _B), "issuing_authority": after(_B + "ISSUING AUTHORITY" + _B),
               "date_of_issue": date_of(after(_B + "DATE OF ISSUE" + _B)),
               "date_of_expiry": date_of(f"coalesce({after(_B + 'DATE OF EXPIRY' + _B)}, {near(['DATE', 'OF', 'EXPIRY'])})")},
    "PASSPORT": {"document_number": found("raw_text", r"\b([A-Z]{1,2}\d{7,8})\b"),
                 "full_name": f"coalesce(nullif(concat_ws(' ', {after(_B + 'NOM' + _B)}, {after(_B + 'PRENOM')}), ''), "
                 "list_filter(lines[1:8], lambda s: length(s) > 4 and s = upper(s) and s <> lower(s) and not regexp_matches(s, 'PASSPORT|REPUBLIC|DEMO|TRAVEL|DOCUMENT'))[1])",
                 "date_of_birth": date_of(after(_B + "NAISSANCE" + _B)), "date_of_expiry": date_of(after("EXPIRATION" + _B)),
                 "country": after(_B + "PAYS" + _B), "nationality": after(_B + "NATIONALITE" + _B),
                 "sex": f"(case when upper({after(_B + 'SEXE' + _B)}[1]) in ('M', 'F', 'X') then upper({after(_B + 'SEXE' + _B)}[1]) end)"},
}


def fields_sql(kinds: list[str] | None = None) -> str:
    """Oracle: the uniform row of every document, or of the listed types."""
    cols = []
    for f in extract.FIELDS[1:]:
        arms = " ".join(f"when '{k}' then {spec[f]}" for k, spec in PER_TYPE.items() if f in spec)
        cols.append(f"(case document_type {arms} end) as {f}")
    where = "" if kinds is None else f" where document_type in ({', '.join(repr(k) for k in kinds)})"
    return f"select doc_id, document_type, {', '.join(cols)}, 'OK' as ocr_status from {TYPED} d{where}"


def _of_type(kind: str, key: str) -> None:
    @add(key, ["fx_ocr_text"], fields_sql([kind]))
    def _(docs):
        # read by the filter, the text's expression would become the condition of a join inside it, row against row
        return extract.extract_fields(materialize(spread(docs), "typed-texts")).where(F.col("document_type") == kind)


for _kind, _key in {
    "AADHAAR": "b6_aadhaar_fields", "PAN": "b7_pan_fields", "DRIVING_LICENSE": "b8_driving_licence_fields",
    "VOTER_ID": "b9_voter_id_fields", "VISA": "b10_visa_fields", "PERMIT": "b11_permit_fields", "PASSPORT": "b12_passport_fields",
}.items():
    _of_type(_kind, _key)


@add("b13_extract_fields", ["fx_ocr_text"], fields_sql())
def _(docs):
    return extract.extract_fields(docs)


@add("b14_ocr_confidence", ["fx_words"],
     f"""select doc_id, greatest(0.40::double, least(0.99::double, {py_round('m', 2)})) as ocr_confidence from (
 select doc_id, coalesce(avg(case when conf >= 0 then conf end) / 100.0::double, 0.88::double) as m from @fx_words w group by doc_id) x""")
def _(words):
    return extract.ocr_confidence(words)


# --- C: machine-readable zones ------------------------------------------------------------


def digit(text: str) -> str:
    """Oracle check digit."""
    return (
        f"cast(coalesce(list_sum(list_transform(range(1, length({text}) + 1), lambda i: greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"substring(upper({text}), i, 1)) - 1, 0) * [7, 3, 1][(i - 1) % 3 + 1])), 0) % 10 as string)"
    )


def digits(text: str) -> str:
    return f"translate(upper({text}), 'ODQILZSB<', '000112580')"


def letters(text: str) -> str:
    return f"translate(upper({text}), '01258', 'OIZSB')"


def cleaned(text: str) -> str:
    """Oracle line cleaning; runs of look-alike letters are walked position by position."""
    swapped = f"translate({text}, '«»‹›{{}}[]()', '<<<<<<<<<<')"
    walked = (
        f"array_to_string(list_transform(range(1, length({swapped}) + 1), lambda i: case when substring({swapped}, i, 1) in ('c', 'e', 'o') "
        f"and ((i > 1 and substring({swapped}, i - 1, 1) in ('c', 'e', 'o')) or substring({swapped}, i + 1, 1) in ('c', 'e', 'o')) then '<' "
        f"else substring({swapped}, i, 1) end), '')"
    )
    return f"upper(regexp_replace({walked}, '[^A-Za-z0-9<]', '', 'g'))"


def widened(text: str, width: int) -> str:
    return (
        f"(case when length({text}) >= {width} then substring({text}, 1, {width}) when contains({text}, '<') then "
        f"regexp_extract({text}, '^(.*<)[^<]*$', 1) || repeat('<', {width} - length({text})) || regexp_extract({text}, '([^<]*)$', 1) "
        f"else rpad({text}, {width}, '<') end)"
    )


_OFFSETS = {
    "TD3": {"number": "l2[1:9]", "number_cd": "l2[10]", "nationality": "l2[11:13]", "birth": "l2[14:19]", "birth_cd": "l2[20]",
            "sex": "l2[21]", "expiry": "l2[22:27]", "expiry_cd": "l2[28]", "opt1": "''", "opt2": "l2[29:43]", "comp_cd": "l2[44]", "names": "l1[6:44]"},
    "TD2": {"number": "l2[1:9]", "number_cd": "l2[10]", "nationality": "l2[11:13]", "birth": "l2[14:19]", "birth_cd": "l2[20]",
            "sex": "l2[21]", "expiry": "l2[22:27]", "expiry_cd": "l2[28]", "opt1": "''", "opt2": "l2[29:35]", "comp_cd": "l2[36]", "names": "l1[6:36]"},
    "TD1": {"number": "l1[6:14]", "number_cd": "l1[15]", "nationality": "l2[16:18]", "birth": "l2[1:6]", "birth_cd": "l2[7]",
            "sex": "l2[8]", "expiry": "l2[9:14]", "expiry_cd": "l2[15]", "opt1": "l1[16:30]", "opt2": "l2[19:29]", "comp_cd": "l2[30]", "names": "l3"},
}
_NUMERIC = {"number_cd", "birth", "birth_cd", "expiry", "expiry_cd", "comp_cd"}
SUMMARY = [
    "document_type", "country", "surname", "given_names", "document_number", "nationality", "birth_date", "sex", "expiry_date",
    "optional_data", "number_ok", "birth_ok", "expiry_ok", "composite_ok", "is_valid",
]


def parsed_sql(source: str, fmt: str, keys: str, extra: str = "") -> str:
    """Oracle: fields and verdicts of lines l1, l2, l3 of a source query."""
    width = mrz.WIDTH[fmt]
    lines = ", ".join(f"{widened(f'c{n}', width)} as l{n}" for n in (1, 2, 3))
    raw = ", ".join(f"{digits(e) if n in _NUMERIC else e} as {n}" for n, e in _OFFSETS[fmt].items())
    pay = lambda a, b: f"number || number_cd || {a} || birth || birth_cd || expiry || expiry_cd || {b}"
    piece = lambda i: f"trim(replace(coalesce(string_split(names, '<<')[{i}], ''), '<', ' '))"
    blank = "P" if fmt == "TD3" else "I"
    return f"""select *, number_ok and birth_ok and expiry_ok and composite_ok as is_valid from (
 select {keys}, coalesce(nullif(replace(l1[1:2], '<', ''), ''), '{blank}') as document_type, {letters("replace(l1[3:5], '<', '')")} as country,
  {piece(1)} as surname, {piece(2)} as given_names, replace(number, '<', '') as document_number,
  {letters("replace(nationality, '<', '')")} as nationality, birth as birth_date, case when sex = '<' then 'X' else sex end as sex,
  expiry as expiry_date, replace(opt1 || opt2, '<', '') as optional_data, number_cd, birth_cd, expiry_cd, comp_cd, number, calc1, calc2, calc3, calc4,
  number_cd = calc1 as number_ok, birth_cd = calc2 as birth_ok, expiry_cd = calc3 as expiry_ok,
  comp_cd = calc4 or comp_cd = {digit("(" + pay(digits('opt1'), digits('opt2')) + ")")} as composite_ok {extra}
 from (select *, {digit('number')} as calc1, {digit('birth')} as calc2, {digit('expiry')} as calc3, {digit("(" + pay('opt1', 'opt2') + ")")} as calc4
  from (select *, {raw} from (select *, {lines} from (select *, {', '.join(f"{cleaned(f'raw{n}')} as c{n}" for n in (1, 2, 3))} from ({source}) s0) s1) s2) s3) s4) s5"""


def summary_columns(mrz_col: str = "mrz"):
    c = lambda n: F.col(f"{mrz_col}.{n}")
    ok = [c("checksums")[i]["valid"].alias(n) for i, n in enumerate(["number_ok", "birth_ok", "expiry_ok", "composite_ok"])]
    return [c(n).alias(n) for n in SUMMARY[:10]] + ok + [c("is_valid").alias("is_valid")]


@add("c1_check_digit", ["fx_mrz_lines", "customer"],
     f"""select doc_id as id, substring(line2, 1, 9) as field, {digit('substring(line2, 1, 9)')} as digit from @fx_mrz_lines m
 union all select c_custkey, c_name, {digit('c_name')} from customer""")
def _(lines, customer):
    field = F.substring("line2", 1, 9)
    a = lines.select(F.col("doc_id").alias("id"), field.alias("field"), zone.check_digit(field).alias("digit"))
    return a.unionByName(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("field"), zone.check_digit(F.col("c_name")).alias("digit")))


@add("c2_clean_mrz_line", ["fx_mrz_ocr", "part"],
     f"""select doc_id as id, {cleaned('line1')} as clean from @fx_mrz_ocr m union all select p_partkey, {cleaned("p_name || ' [' || lower(p_brand) || '] coeee'")} from part""")
def _(lines, part):
    a = lines.select(F.col("doc_id").alias("id"), zone.clean_line(F.col("line1")).alias("clean"))
    odd = F.concat("p_name", F.lit(" ["), F.lower("p_brand"), F.lit("] coeee"))
    return a.unionByName(part.select(F.col("p_partkey").alias("id"), zone.clean_line(odd).alias("clean")))


@add("c3_normalize", ["customer"],
     f"select c_custkey, {digits('c_name')} as as_digits, {letters('c_name')} as as_letters from customer")
def _(customer):
    return customer.select("c_custkey", zone.as_digits(F.col("c_name")).alias("as_digits"), zone.as_letters(F.col("c_name")).alias("as_letters"))


@add("c4_reconstruct_length", ["fx_mrz_ocr"],
     f"select doc_id, {widened('ocr2', 44)} as full_line, {widened('ocr1', 30)} as cut_line, {widened('substring(ocr2, 1, 8)', 12)} as padded from @fx_mrz_ocr m")
def _(lines):
    return lines.select(
        "doc_id", zone.restore_length(F.col("ocr2"), 44).alias("full_line"), zone.restore_length(F.col("ocr1"), 30).alias("cut_line"),
        zone.restore_length(F.substring("ocr2", 1, 8), 12).alias("padded"),
    )


@add("c5_parse_td3", ["fx_mrz_ocr"],
     f"""select doc_id, {', '.join(SUMMARY)} from ({parsed_sql("select doc_id, ocr1 as raw1, ocr2 as raw2, '' as raw3 from @fx_mrz_ocr m where ocr2 is not null", "TD3", "doc_id")}) p
 union all select doc_id, {', '.join('null' for _ in SUMMARY)} from @fx_mrz_ocr m where ocr2 is null""")
def _(lines):
    return mrz.parse_mrz_lines(lines, "TD3", "ocr1", "ocr2").select("doc_id", *summary_columns())


# The same holders on three-line cards and two-line visas.
_TD1 = """select doc_id, 'I<UTO' || substring(line2, 1, 10) || case when doc_id % 4 = 0 then 'A1B2' else '' end as raw1,
 substring(line2, 14, 7) || substring(line2, 21, 1) || substring(line2, 22, 7) || 'UTO' || '<<<<<<<<<<<' || cast(doc_id % 10 as string) as raw2,
 substring(line1, 6, 30) as raw3 from {t}"""
_TD2 = """select doc_id, rpad(substring(line1, 1, 20), 36, '<') as raw1, substring(line2, 1, 28) || case when doc_id % 3 = 0 then 'S5O0<<<' else '<<<<<<<' end
 || substring(line2, 44, 1) as raw2, '' as raw3 from {t}"""


@add("c6_parse_td1", ["fx_mrz_lines"],
     f"select doc_id, {', '.join(SUMMARY)} from ({parsed_sql(_TD1.format(t='@fx_mrz_lines m'), 'TD1', 'doc_id')}) p")
def _(lines):
    cards = lines.sparkSession.sql(_TD1.replace("{t}", "{lines}"), lines=lines)
    return mrz.parse_mrz_lines(cards, "TD1", "raw1", "raw2", "raw3").select("doc_id", *summary_columns())


@add("c7_parse_td2", ["fx_mrz_lines"],
     f"select doc_id, {', '.join(SUMMARY)} from ({parsed_sql(_TD2.format(t='@fx_mrz_lines m'), 'TD2', 'doc_id')}) p")
def _(lines):
    visas = lines.sparkSession.sql(_TD2.replace("{t}", "{lines}"), lines=lines)
    return mrz.parse_mrz_lines(visas, "TD2", "raw1", "raw2").select("doc_id", *summary_columns())


# Oracle of the line finder: positions of runs by list search.
_shape = lambda e, n: f"(length({e}) >= {n} and contains({e}, '<'))"
FOUND_LINES = f"""(select doc_id, document_type, band1, band2, case when t is not null then 'TD1' when p is not null then 'TD3' when len(s) = 3 then 'TD1' when len(s) = 2 then 'TD3' end as fmt,
  case when t is not null then c[t] when p is not null then c[p] when len(s) >= 2 then s[1] end as line1,
  case when t is not null then c[t + 1] when p is not null then c[p + 1] when len(s) >= 2 then s[2] end as line2,
  case when t is not null then c[t + 2] when p is not null then null when len(s) >= 2 then s[3] end as line3
 from (select *, list_filter(range(1, len(c) - 1), lambda i: {_shape('c[i]', 25)} and {_shape('c[i + 1]', 25)} and {_shape('c[i + 2]', 25)})[1] as t,
  list_filter(range(1, len(c)), lambda i: {_shape('c[i]', 30)} and {_shape('c[i + 1]', 30)})[1] as p,
  list_filter(c, lambda x: length(x) >= 30 and length(x) - length(replace(x, '<', '')) >= 4)[1:3] as s
 from (select *, list_transform(list_filter(string_split(raw_text, chr(10)), lambda x: x <> ''), lambda x: {cleaned('x')}) as c from @fx_page_text t0) t1) t2)"""


def _pages(docs):
    return docs.withColumn("lines", lines_of(body_of(F.col("raw_text"))))


@add("c8_find_mrz_lines", ["fx_page_text"], f"select doc_id, fmt, line1, line2, line3 from {FOUND_LINES} f")
def _(docs):
    return mrz.find_mrz_lines(_pages(docs)).select("doc_id", "fmt", "line1", "line2", "line3")


_CHOSEN = f"""(select doc_id, case when document_type in ('AADHAAR', 'VISA') then null when band1 <> '' and band2 <> '' then 'TD3' else fmt end as fmt,
 case when band1 <> '' and band2 <> '' then band1 else line1 end as raw1, case when band1 <> '' and band2 <> '' then band2 else line2 end as raw2,
 case when band1 <> '' and band2 <> '' then '' else coalesce(line3, '') end as raw3 from {FOUND_LINES} f)"""


@add("c9_parse_mrz", ["fx_page_text"],
     f"""select doc_id, 'TD3' as format, {', '.join(SUMMARY)} from ({parsed_sql(f"select * from {_CHOSEN} c where fmt = 'TD3'", 'TD3', 'doc_id')}) p
 union all select doc_id, 'TD1', {', '.join(SUMMARY)} from ({parsed_sql(f"select * from {_CHOSEN} c where fmt = 'TD1'", 'TD1', 'doc_id')}) p
 union all select doc_id, null, {', '.join('null' for _ in SUMMARY)} from {_CHOSEN} c where fmt is null""")
def _(docs):
    staged = mrz.find_mrz_lines(spread(_pages(docs)).withColumn("band", F.array("band1", "band2")))
    return mrz.parse_mrz(staged).select("doc_id", F.col("mrz.format").alias("format"), *summary_columns())


CHECKSUMS = f"""select doc_id, checksum_no, ['Document Number Checksum', 'Date of Birth Checksum', 'Expiry Date Checksum', 'Composite Checksum'][checksum_no] as field,
 [number, birth_date, expiry_date, 'Composite Checksum Payload'][checksum_no] as value, [number_cd, birth_cd, expiry_cd, comp_cd][checksum_no] as check_digit,
 [calc1, calc2, calc3, calc4][checksum_no] as calculated_check_digit, [number_ok, birth_ok, expiry_ok, composite_ok][checksum_no] as valid
 from (select *, unnest([1, 2, 3, 4]) as checksum_no from ({parsed_sql("select doc_id, line1 as raw1, line2 as raw2, '' as raw3 from @fx_mrz_lines m", 'TD3', 'doc_id')}) p) q"""


@add("c10_mrz_checksums_long", ["fx_mrz_lines"], CHECKSUMS)
def _(lines):
    return mrz.checksums_long(mrz.parse_mrz_lines(lines, "TD3"))
