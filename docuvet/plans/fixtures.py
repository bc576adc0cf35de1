"""Domain tables derived from the TPC-H-like test tables.

The given tables hold no identity documents, so each domain table is a SQL
derivation whose size grows with them. One text serves Spark and the SQL
oracle; the few places where the dialects differ carry two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_PAD7 = "lpad(cast({} as string), 7, '0')"

TEXTS: dict[str, str | tuple[str, str]] = {}

TEXTS["fx_cases"] = """
select o_orderkey as case_id, 'CS-' || lpad(cast(o_orderkey as string), 8, '0') as case_number,
 o_orderdate as created_at,
 case o_orderkey % 7 when 0 then 'PASSPORT' when 1 then 'AADHAAR' when 2 then 'PAN'
  when 3 then 'DRIVING_LICENSE' when 4 then 'VOTER_ID' when 5 then 'VISA' else null end as document_type,
 n_name as country, cast(o_orderkey * 37 % 1001 as double) / 10 as risk_score,
 case when o_orderkey * 37 % 1001 <= 240 then 'LOW' when o_orderkey * 37 % 1001 <= 490 then 'MEDIUM'
  when o_orderkey * 37 % 1001 <= 740 then 'HIGH' else 'CRITICAL' end as risk_level,
 case o_orderstatus when 'F' then 'CLEARED' when 'O' then 'PENDING' else 'ESCALATED' end as officer_decision,
 case when o_orderstatus = 'F' then 'CLEARED' when o_orderkey * 37 % 1001 <= 240 then 'LOW_RISK'
  when o_orderkey * 37 % 1001 <= 490 then 'MEDIUM_RISK' when o_orderkey * 37 % 1001 <= 740 then 'REQUIRES_REVIEW'
  else 'CRITICAL' end as status,
 'review ' || lower(o_orderpriority) as recommendation,
 'X' || lpad(cast(o_custkey as string), 7, '0') as document_number,
 o_totalprice / 100 as processing_time_ms, o_orderkey % 11 = 0 as biometrics_purged
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

TEXTS["fx_checks"] = """
select l_orderkey as case_id, l_linenumber as check_seq,
 case l_linenumber % 6 when 0 then 'MRZ_VALIDATION' when 1 then 'TAMPER' when 2 then 'FACE'
  when 3 then 'CONSISTENCY' when 4 then 'WATCHLIST' else 'IDENTITY' end as factor,
 case when l_returnflag = 'A' then 'FAIL' when l_returnflag = 'N' then 'PASS'
  when l_partkey % 2 = 0 then 'INFO' else 'NOT_APPLICABLE' end as status,
 case when l_returnflag = 'A' then case l_suppkey % 4 when 0 then 'CRITICAL' when 1 then 'HIGH'
  when 2 then 'MEDIUM' else 'LOW' end end as severity,
 case when l_returnflag = 'A' then l_quantity else 0.0 end as score_impact,
 'Check ' || p_brand as label, l_partkey as part_ref, l_extendedprice as tie_ref
from {lineitem} join {part} on l_partkey = p_partkey
"""

TEXTS["fx_audit"] = """
select event_id as seq, ts as event_ts, cast(floor(event_id / 6) as bigint) as case_id, user_id as chain_id,
 case event_id % 6 when 0 then 'DOCUMENT_UPLOADED' when 1 then 'OCR_COMPLETED' when 2 then 'MRZ_VALIDATED'
  when 3 then 'TAMPER_ANALYSIS_COMPLETED' when 4 then 'FACE_VERIFIED' else 'RISK_CALCULATED' end as action,
 case when event_id % 6 = 0 then 'OFFICER-' || lpad(cast(user_id % 20 as string), 2, '0')
  else 'AI-ENGINE' end as actor, props as metadata
from {events}
"""

TEXTS["fx_watchlist"] = """
select s_suppkey as entry_order, 'WL-' || lpad(cast(s_suppkey as string), 6, '0') as watchlist_id,
 upper(p_name) as name, 'X' || lpad(cast(s_suppkey * 13 % 1500 as string), 7, '0') as document_number,
 case s_suppkey % 3 when 0 then 'CRITICAL' when 1 then 'HIGH'
  else case when s_suppkey % 2 = 0 then 'MEDIUM' end end as severity,
 'Category ' || cast(s_nationkey as string) as category, s_suppkey % 10 <> 0 as active
from {supplier} join {part} on p_partkey = s_suppkey * 7
"""

TEXTS["fx_subjects"] = """
select c_custkey as case_id,
 case c_custkey % 4 when 0 then upper(p_name) when 1 then replace(upper(p_name), 'I', '1')
  when 2 then replace(upper(p_name), 'C', 'K') else 'MIDDLE ' || upper(p_name) end
  || ' ' || translate(cast(c_custkey as string), '0123456789', 'ABCDEFGHIJ') as full_name,
 case when c_custkey % 3 = 0 then 'X' || substring(lpad(cast(c_custkey as string), 7, '0'), 1, 3) || 'B'
   || substring(lpad(cast(c_custkey as string), 7, '0'), 5, 3)
  else 'X' || lpad(cast(c_custkey as string), 7, '0') end as document_number
from {customer} cross join (select max(p_partkey) as parts from {part}) n join {part} on p_partkey = c_custkey % parts + 1
"""

TEXTS["fx_submissions"] = tuple(
    f"""
select c_custkey as identity_key, v as version, 'X' || lpad(cast(c_custkey as string), 7, '0') as document_number,
 upper(c_mktsegment) as surname, case when c_custkey % 13 = 0 then '' else 'ANN' end as given_names,
 case when v = 3 and c_custkey % 5 = 0 then '950512' else '880610' end as birth_date,
 case when v = 3 and c_custkey % 3 = 0 then '281115' when c_custkey % 17 = 0 then '30O101' else '300101' end as expiry_date,
 case when v = 3 and c_custkey % 7 = 0 then 'F' else 'M' end as sex,
 case when v = 3 and c_custkey % 11 = 0 then null when c_custkey % 19 = 0 then '' else 'UTO' end as nationality,
 'UTO' as country, not (v = 3 and c_custkey % 23 = 0) as mrz_parsed,
 case when c_custkey % 29 = 0 then 'PORTRAIT_CHANGED' else 'SAME_PORTRAIT' end as portrait_status
from (select *, {explode} as v from {{customer}}) c
"""
    for explode in ("explode(array(1, 3, 7))", "unnest([1, 3, 7])")
)

# Scores of all documents, and of those whose truth is known.
TEXTS["fx_scores"] = """
select doc_id as id, source as domain, lang as grp, cast(n_chars * 31 % 1000 as double) / 1000 as prob from {documents}
"""

TEXTS["fx_predictions"] = """
select d.doc_id as id, d.source as domain, d.lang as grp, l.quality as y, l.toxic as toxic,
 cast(d.n_chars * 31 % 1000 as double) / 1000 as prob
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""

# Every vector against the next 20: the pair is addressed by position, so the
# Spark text is an equi-join on an exploded offset rather than a range join.
TEXTS["fx_pairs"] = (
    """
select a.vec_id as id_a, b.vec_id as id_b, case when a.label = b.label then 1 else 0 end as same,
 a.embedding as emb_a, b.embedding as emb_b
from (select *, explode(sequence(1, 20)) as step from {embeddings}) a
join {embeddings} b on b.vec_id = a.vec_id + a.step
""",
    """
select a.vec_id as id_a, b.vec_id as id_b, case when a.label = b.label then 1 else 0 end as same,
 a.embedding as emb_a, b.embedding as emb_b
from {embeddings} a join {embeddings} b on b.vec_id > a.vec_id and b.vec_id <= a.vec_id + 20
""",
)

# A second capture of every face: the first one blended with a neighbour's.
TEXTS["fx_captures"] = (
    """
select a.vec_id as case_id, a.embedding as doc_embedding, a.label as label,
 zip_with(a.embedding, b.embedding, (x, y) -> case a.vec_id % 3 when 0 then cast(x as double)
  when 1 then 0.8D * cast(x as double) + 0.6D * cast(y as double)
  else 0.3D * cast(x as double) + 0.9D * cast(y as double) end) as live_embedding
from {embeddings} a join {embeddings} b
 on b.vec_id = case when a.vec_id % 2 = 0 then a.vec_id + 1 else a.vec_id - 1 end
""",
    """
select a.vec_id as case_id, a.embedding as doc_embedding, a.label as label,
 list_transform(list_zip(a.embedding, b.embedding), lambda p: case a.vec_id % 3 when 0 then p[1]::double
  when 1 then 0.8::double * p[1]::double + 0.6::double * p[2]::double
  else 0.3::double * p[1]::double + 0.9::double * p[2]::double end) as live_embedding
from {embeddings} a join {embeddings} b
 on b.vec_id = case when a.vec_id % 2 = 0 then a.vec_id + 1 else a.vec_id - 1 end
""",
)

TEXTS["fx_boxes"] = """
select l_orderkey as image_id,
 l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 as box_no, cast(l_partkey % 600 as int) as x,
 cast(l_suppkey * 5 % 500 as int) as y, cast(20 + l_partkey % 300 as int) as w,
 cast(10 + l_suppkey % 90 * 3 as int) as h, l_extendedprice / 20 as variance, l_returnflag = 'N' as is_qr
from {lineitem}
"""

TEXTS["fx_signals"] = """
select l_orderkey as case_id,
 case l_linenumber % 5 when 0 then 'compression_anomaly' when 1 then 'edge_discontinuity'
  when 2 then 'photo_boundary_anomaly' when 3 then 'text_compression_anomaly'
  else 'exif_metadata_missing' end as type,
 0.35 + l_discount * 5 as confidence, l_tax as mean_ela, cast(l_partkey % 1000 as double) / 1000 as cnn_prob
from {lineitem}
"""

# One image per case with its scalar measurements.
TEXTS["fx_measures"] = """
select o_orderkey as case_id,
 case o_orderkey % 7 when 0 then 'PASSPORT' when 1 then 'AADHAAR' when 2 then 'PAN'
  when 3 then 'DRIVING_LICENSE' when 4 then 'VOTER_ID' when 5 then 'VISA' else 'PASSPORT' end as document_type,
 cast(o_orderkey * 17 % 400 as double) / 1000 as mean_ela,
 cast(o_orderkey * 29 % 300 as double) / 1000 as edge_density,
 cast(o_orderkey * 41 % 12000 as double) as border_var,
 cast(o_orderkey * 53 % 120 as double) as mrz_mean, cast(o_orderkey * 31 % 90 as double) as upper_mean
from {orders}
"""

TEXTS["fx_regions"] = tuple(
    f"""
select o_orderkey as case_id, case v when 1 then 'portrait' when 2 then 'center' else 'mrz' end as region_name,
 cast((o_orderkey * 7 + v * 331) % 1000 as double) / 1000 as probability
from (select *, {explode} as v from {{orders}}) o where v < 3 or o_orderkey % 7 in (0, 6)
"""
    for explode in ("explode(array(1, 2, 3))", "unnest([1, 2, 3])")
)

TEXTS["fx_exif"] = """
select o_orderkey as case_id,
 case o_orderkey % 5 when 0 then 'Adobe Photoshop 24.1' when 1 then 'Canon EOS R5' when 2 then 'gimp 2.10'
  else null end as software,
 case when o_orderkey % 4 = 0 then null when o_orderkey % 9 = 0 then '2024:13:40 00:00:00'
  else '2024:03:' || lpad(cast(1 + o_orderkey % 28 as string), 2, '0') || ' 10:30:00' end as modified,
 case when o_orderkey % 6 = 0 then null else '2024:03:0' || cast(1 + o_orderkey % 9 as string) || ' 08:00:00' end as original,
 case when o_orderkey % 3 = 0 then '2024:02:20 09:15:30' else null end as digitized
from {orders}
"""

TEXTS["fx_faces"] = """
select o_orderkey as case_id, case when o_orderkey % 23 = 0 then 0 when o_orderkey % 29 = 0 then 2 else 1 end as doc_faces,
 case when o_orderkey % 31 = 0 then 0 when o_orderkey % 37 = 0 then 3 else 1 end as live_faces,
 cast(o_orderkey * 59 % 1001 as double) / 1000 as similarity,
 cast(o_orderkey * 13 % 2560 as double) / 10 as mean_brightness,
 cast(o_orderkey * 19 % 2000 as double) / 10 as sharpness,
 cast(o_orderkey * 7 % 500 as double) / 1000 as concentration
from {orders}
"""

TEXTS["fx_bins"] = """
select l_suppkey as image_id, l_orderkey * 10 + l_linenumber as bin_no,
 cast(l_partkey % 1000 as double) / 1000 as radius, l_quantity as magnitude
from {lineitem}
"""

_DOCSUM = " + ".join(
    f"{w} * (cast(floor(c_custkey / {10 ** (6 - i)}) as bigint) % 10)"
    for i, w in enumerate([3, 1, 7, 3, 1, 7, 3])
)
TEXTS["fx_mrz_lines"] = f"""
select doc_id, rpad('P<UTO' || surname || '<<ANN', 44, '<') as line1,
 doc_raw || cast((docsum + case when bad then 1 else 0 end) % 10 as string) || 'UTO' ||
 case k2 when 0 then '8806105' else '9505128' end || 'M' ||
 case k3 when 0 then '3001019' when 1 then '2811154' else '2201018' end || repeat('<', 15) ||
 cast((docsum + docsum % 10 * 7 + case k2 when 0 then 66 else 86 end
  + case k3 when 0 then 16 when 1 then 88 else 28 end) % 10 as string) as line2, not bad as expected_valid
from (select c_custkey as doc_id, 'X' || lpad(cast(c_custkey as string), 7, '0') || '<' as doc_raw,
 231 + {_DOCSUM} as docsum, c_custkey % 2 as k2, c_custkey % 3 as k3, c_custkey % 10 = 0 as bad,
 upper(c_mktsegment) as surname from {{customer}}) b
"""

# What a reader made of the same lines: confusions, swallowed filler, lost lines.
TEXTS["fx_mrz_ocr"] = f"""
select doc_id, case doc_id % 3 when 0 then 'grc_passport' when 1 then 'aze_passport' else 'lva_passport' end as doc_type,
 case when doc_id % 12 = 0 then replace(line1, 'UTO', 'UT0') else line1 end as ocr1,
 case when doc_id % 17 = 0 then null when doc_id % 5 = 0 then replace(line2, '<<<<<<', '<')
  when doc_id % 7 = 0 then replace(line2, '8806', 'BB06') when doc_id % 11 = 0 then replace(line2, 'M', '1')
  else line2 end as ocr2, line1, line2
from ({TEXTS["fx_mrz_lines"]}) m
"""

TEXTS["fx_ocr_text"] = """
select c_custkey as doc_id, case c_custkey % 7
 when 0 then 'Government of India' || chr(10) || p.nm || chr(10) || '  DOB: 15/08/1990  ' || chr(10) || chr(10) || 'MALE' || chr(10) || 'Aadhaar No: ' || lpad(cast(c_custkey as string), 4, '1') || ' 5678 9012'
 when 1 then 'INCOME TAX DEPARTMENT' || chr(10) || 'FATHER NAME' || chr(10) || 'OLD ' || p.nm || chr(10) || 'Name' || chr(10) || p.nm || chr(10) || 'Date of Birth' || chr(10) || '0101/1990' || chr(10) || 'ABCPK' || lpad(cast(c_custkey % 10000 as string), 4, '0') || 'F'
 when 2 then 'DRIVING LICENCE' || chr(10) || 'KA-03 2011 ' || lpad(cast(c_custkey as string), 7, '0') || chr(10) || 'NAME' || chr(10) || p.nm || chr(10) || 'VALID FROM' || chr(10) || '20/03/2011' || chr(10) || 'VAUD TILL' || chr(10) || '20/03/2031'
 when 3 then 'ELECTION COMMISSION OF INDIA' || chr(10) || 'MLD' || lpad(cast(c_custkey as string), 7, '0') || chr(10) || 'Name' || chr(10) || p.nm || chr(10) || 'FEMALE'
 when 4 then 'ENTRY VISA' || chr(10) || 'VISA NUMBEF' || chr(10) || 'UV' || lpad(cast(c_custkey as string), 7, '0') || chr(10) || 'FULL NAME' || chr(10) || p.nm || chr(10) || 'NATIONALITY' || chr(10) || 'UTO' || chr(10) || 'ENTRY VALIDATION' || chr(10) || case when c_custkey % 2 = 0 then 'SINGLE ENTRY' else 'FOREVER' end || chr(10) || 'STAY DURATION' || chr(10) || '30/06/2026'
 when 5 then 'WORK PERMIT' || chr(10) || 'PERMIT NUMBER' || chr(10) || 'RP' || lpad(cast(c_custkey as string), 7, '0') || chr(10) || 'PERMIT TYPE' || chr(10) || 'WORK' || chr(10) || 'DATE OF EXPIRY' || chr(10) || '01/01/2025'
 else 'REPUBLIC' || chr(10) || case when c_custkey % 2 = 0 then 'JRNAME / NOM' else 'JRNAME' end || chr(10) || p.nm || chr(10) || 'PAYS' || chr(10) || 'REPUBLIC OF UTOPIA' || chr(10) || 'SEXE' || chr(10) || 'F' || chr(10) || 'DEXPIRATION' || chr(10) || '1/2/2031' || chr(10) || 'P' || lpad(cast(c_custkey as string), 7, '0') end as raw_text
from {customer} cross join (select max(p_partkey) as parts from {part}) n
 join (select p_partkey, upper(p_name) as nm from {part}) p on p_partkey = c_custkey % parts + 1
"""

# Whole-page reads of passports and cards: printed text with MRZ lines somewhere in it.
TEXTS["fx_page_text"] = f"""
select doc_id, case when doc_id % 13 = 0 then 'AADHAAR' when doc_id % 14 = 0 then 'VISA' else 'PASSPORT' end as document_type,
 'REPUBLIC OF UTOPIA' || chr(10) || 'NOM' || chr(10)
 || case when doc_id % 4 = 0 then replace(line1, '<', '«') else line1 end || chr(10)
 || case when doc_id % 9 = 0 then 'SMUDGE' when doc_id % 6 = 0 then substring(line2, 1, 33) || substring(line2, 44, 1)
   else line2 end || chr(10)
 || case when doc_id % 9 = 0 then line2 when doc_id % 8 = 0 then replace(line1, 'P<', 'I<') else 'END' end || chr(10)
 || case when doc_id % 10 = 0 then 'ID<<' || line2 else 'OFFICE 12' end as raw_text,
 case when doc_id % 5 = 0 then line1 when doc_id % 5 = 1 then '' else null end as band1,
 case when doc_id % 5 = 0 then line2 when doc_id % 5 = 1 then line2 else null end as band2
from ({TEXTS["fx_mrz_lines"]}) m
"""

# Documents with every rule's branches: printed fields beside machine-read ones.
TEXTS["fx_rule_docs"] = """
select c_custkey as doc_id,
 case c_custkey % 7 when 0 then 'AADHAAR' when 1 then 'PAN' when 2 then 'DRIVING_LICENSE' when 3 then 'VOTER_ID'
  when 4 then 'VISA' when 5 then 'PERMIT' else 'PASSPORT' end as document_type,
 case when c_custkey % 10 = 0 then null when c_custkey % 33 = 0 then 'R= {{(1, 1), 22), (8,3)}}'
  else 'ANN ' || upper(c_mktsegment) end as full_name,
 case when c_custkey % 15 = 0 then null when c_custkey % 34 = 0 then 'DIFFERENT'
  when c_custkey % 7 = 1 then 'ABC' || case when c_custkey % 2 = 0 then 'P' else 'Z' end || 'K' || lpad(cast(c_custkey % 10000 as string), 4, '0') || case when c_custkey % 5 = 0 then '' else 'F' end
  when c_custkey % 7 = 3 then 'MLD' || lpad(cast(c_custkey as string), case when c_custkey % 4 = 0 then 6 else 7 end, '0')
  when c_custkey % 4 = 0 then 'X' || lpad(cast(c_custkey as string), 7, '0')
  when c_custkey % 4 = 1 then 'x-' || lpad(cast(c_custkey as string), 7, '0') || 'B'
  else 'Y' || lpad(cast(c_custkey * 7 as string), 7, '9') end as document_number,
 case c_custkey % 3 when 0 then 'Republic of Utopia' when 1 then 'INDIA' else null end as country,
 case c_custkey % 4 when 0 then '20/03/2031' when 1 then '01/01/2025' when 2 then '31/02/2030' else null end as date_of_expiry,
 case c_custkey % 5 when 0 then 'Single Entry' when 1 then 'FOREVER' when 2 then ' TRANSIT ' else null end as entry_validation,
 case c_custkey % 6 when 0 then '30/06/2026' when 1 then '30/06/2020' else null end as stay_duration_until,
 c_custkey % 7 = 6 or c_custkey % 11 = 0 as has_mrz, 'ANN' as given_names,
 case when c_custkey % 8 = 0 then '' else upper(c_mktsegment) end as surname,
 'X' || lpad(cast(c_custkey as string), 7, '0') as mrz_number,
 case c_custkey % 9 when 0 then 'UT0' when 1 then '' when 2 then 'UT' else 'UTO' end as nationality,
 case c_custkey % 5 when 0 then 'M' when 1 then 'f' when 2 then '1' when 3 then 'X' else '' end as sex,
 case c_custkey % 6 when 0 then '880610' when 1 then '400101' when 2 then '900230' when 3 then '' else '120229' end as birth_date,
 case c_custkey % 5 when 0 then '300101' when 1 then '220101' when 2 then '30O101' when 3 then '' else '281115' end as expiry_date,
 case c_custkey % 2 when 0 then 'UTO' else 'IND' end as mrz_country,
 case c_custkey % 6 when 0 then 'Republic of Utopia' when 1 then 'india' when 2 then 'Unknown' when 3 then ''
  when 4 then 'UNITED KINGDOM' else null end as declared_country
from {customer}
"""

TEXTS["fx_words"] = """
select l_orderkey as doc_id, 'w' || cast(l_partkey as string) as word,
 case when l_partkey % 9 = 0 then -1.0 else l_quantity * 2 end as conf
from {lineitem}
"""

TEXTS["fx_annotations"] = tuple(
    f"""
select doctype, '{{{{"_via_img_metadata": {{{{' || {agg} || '}}}}}}}}' as annotation_json
from (select 'type' || cast(c_nationkey as string) as doctype, cast(c_custkey as string) as idx,
  '"' || cast(c_custkey as string) || '.jpg12345": {{{{"filename": "' || cast(c_custkey as string) || '.jpg", "regions": ['
  || '{{{{"shape_attributes": {{{{"x": ' || cast(c_custkey % 50 as string) || ', "y": 10, "width": 80, "height": 20}}}}, "region_attributes": {{{{"field_name": "surname", "value": "' || upper(c_mktsegment) || '"}}}}}}}}, '
  || '{{{{"shape_attributes": {{{{"x": 5, "y": 200, "width": 400, "height": 18}}}}, "region_attributes": {{{{"field_name": "number", "value": "X' || lpad(cast(c_custkey as string), 7, '0') || '"}}}}}}}}]}}}}' as entry
 from {{customer}}) c
group by doctype, cast(floor(cast(idx as bigint) / 40) as bigint)
"""
    for agg in ("array_join(collect_list(entry), ', ')", "string_agg(entry, ', ')")
)

TEXTS["fx_forgeries"] = """
select 'fake_' || cast(o_orderkey as string) as image, 600 + o_orderkey % 300 as img_w, 400 + o_orderkey % 200 as img_h,
 case when o_orderkey % 9 = 0 then 'None' when o_orderkey % 10 = 0 then null
  else 'type' || cast(c_nationkey as string) || '_' || cast(c_custkey as string) || '.jpg' end as src,
 case o_orderkey % 4 when 0 then 'surname' when 1 then 'number' when 2 then 'portrait' else 'None' end as field
from {orders} join {customer} on o_custkey = c_custkey
"""

TEXTS["fx_paths"] = """
select case c_custkey % 4
 when 0 then '/data/fgnet/' || lpad(cast(c_nationkey as string), 3, '0') || case when c_custkey % 8 = 0 then 'A' else 'a' end || lpad(cast(c_custkey % 100 as string), 2, '0') || '.JPG'
 when 1 then '/data/ylfw/Train-Balanced/' || c_mktsegment || '_' || cast(c_nationkey as string) || '/' || cast(c_custkey as string) || '.png'
 when 2 then '/data/ylfw/Train-Balanced/' || c_mktsegment || '/' || cast(c_custkey as string) || '.txt'
 else '/data/fgnet/readme' || cast(c_custkey as string) || '.JPG' end as path
from {customer}
"""

TEXTS["fx_face_csv"] = """
select 'images/' || lpad(cast(c_custkey % 10 as string), 3, '0') || '/' || cast(c_custkey as string) || '.jpg' as file_name,
 replace(c_mktsegment, ' ', '_') || cast(c_nationkey as string) as identity
from {customer}
"""

TEXTS["fx_uploads"] = """
select 'scan ' || cast(c_custkey as string) || case c_custkey % 6 when 0 then '.JPG' when 1 then '.jpeg' when 2 then '.png'
  when 3 then '.webp' when 4 then '.svg' else '' end as filename,
 case when c_custkey % 13 = 0 then 0 when c_custkey % 17 = 0 then 10485761 else c_custkey + 1000 end as file_size,
 case c_custkey % 5 when 0 then 'FFD8FFE000104A4649460001' when 1 then '89504E470D0A1A0A0000000D'
  when 2 then '52494646AA00000057454250' when 3 then '474946383961000000000000' else '3C73766720786D6C6E733D22' end as head_hex
from {customer}
"""

TEXTS["fx_labelled_images"] = """
select '/idnet/' || case when c_custkey % 3 = 0 then 'Fraud5' when c_custkey % 3 = 1 then 'forged_set' else 'real' end || '/img' || cast(c_custkey as string) || case when c_custkey % 2 = 0 then '.jpg' else '.png' end as path,
 case c_custkey % 7 when 0 then '{{"fraud_type": "splice"}}' when 1 then '{{"is_fraud": true}}' when 2 then '{{"fraud": false}}'
  when 3 then '{{broken' when 4 then '{{"fraud_type": "", "fraud": 1}}' else null end as meta
from {customer}
"""

TEXTS["fx_anchors"] = """
select s_suppkey as anchor_id, s_suppkey % 60 as chain_id, cast(5 + s_suppkey * 7 % 70 as bigint) as total_records,
 'tx' || lpad(cast(s_suppkey as string), 6, '0') as tx_hash, 'testnet' as network,
 cast(s_suppkey * 3600 as bigint) as created_epoch
from {supplier}
"""

TEXTS["fx_policies"] = """
select cast(n_nationkey + 1 as bigint) as policy_id, cast(25 + 2 * (n_nationkey % 5) as double) / 100 as weight_mrz,
 cast(30 as double) / 100 as weight_tamper, cast(30 - 2 * (n_nationkey % 5) as double) / 100 as weight_face,
 cast(10 as double) / 100 as weight_consistency, cast(5 as double) / 100 as weight_watchlist,
 cast(20 + n_nationkey as double) as threshold_low, cast(46 + n_nationkey as double) as threshold_medium,
 cast(72 + n_nationkey as double) as threshold_high
from {nation}
"""

TEXTS["fx_policy_edits"] = """
select n_nationkey as policy_id, cast(25 + n_nationkey % 3 as double) / 100 as weight_mrz, cast(30 as double) / 100 as weight_tamper,
 cast(30 as double) / 100 as weight_face, cast(10 as double) / 100 as weight_consistency,
 cast(5 + n_nationkey % 2 * 3 as double) / 100 as weight_watchlist, cast(n_nationkey % 4 * 20 - 5 as double) as threshold_low,
 cast(49 as double) as threshold_medium, cast(90 + n_nationkey as double) as threshold_high
from {nation}
"""

TEXTS["fx_analyses"] = """
select o_orderkey as case_id, 'doc/' || cast(o_orderkey as string) || '.jpg' as document_image_path,
 case when o_orderkey % 4 = 0 then null when o_orderkey % 9 = 0 then '[PURGED_PRIVACY_COMPLIANCE]' else 'face/' || cast(o_orderkey as string) || '.jpg' end as face_image_path,
 o_orderkey % 11 = 0 as biometrics_purged
from {orders}
"""

TEXTS["fx_decisions"] = """
select o_orderkey as case_id, event_id as decision_seq, ts as decided_at,
 case event_type when 'click' then 'CLEARED' when 'view' then 'ESCALATED' when 'purchase' then 'REQUIRES_INSPECTION' else 'MAYBE' end as decision,
 'note ' || cast(event_id as string) as notes, 'OFFICER-' || cast(user_id % 20 as string) as officer
from {events} join {orders} on o_orderkey = cast(floor(event_id / 2) as bigint)
"""


def tables_of(name: str) -> list[str]:
    text = TEXTS[name]
    text = text if isinstance(text, str) else text[0]
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    text = text if isinstance(text, str) else text[0]
    sources = {t: load(spark, sf_dir, t) for t in tables_of(name)}
    return spark.sql(text, **sources)


def oracle(name: str) -> str:
    """The same table as a parenthesised SQL text for the oracle."""
    if name in BASE:
        return name
    text = TEXTS[name]
    text = text if isinstance(text, str) else text[1]
    return "(" + text.format(**{t: t for t in tables_of(name)}).strip() + ")"
