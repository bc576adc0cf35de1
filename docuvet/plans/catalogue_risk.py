"""Matching, galleries and risk scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_identifier
from ..functions.numbers import round_exact
from ..functions.vectors import face_similarity
from ..operators import gallery, gallery_index, matching, risk, signals
from .catalogue_rules import AS_OF, FACES, SCORES, day6, with_zone
from .harness import Catalogue, py_round

CATALOGUE = Catalogue()
add = CATALOGUE.add


# --- oracle: phonetics -----------------------------------------------------------------


def soundex_sql(w: str) -> str:
    digits = f"translate({w}[1] || replace(replace({w}[2:], 'H', ''), 'W', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"({w}[1] || rpad(replace({digits}[2:], '0', ''), 3, '0')[1:3])"


def metaphone_sql(tokens: str) -> str:
    """Oracle: (t, s, m) of a query giving distinct tokens t."""
    p, n, n2, n3 = ("case when i > 1 then w[i - 1] else '' end", "w[i + 1]", "w[i + 2]", "w[i + 3]")
    vow = lambda c: f"({c} <> '' and contains('AEIOU', {c}))"
    fro = lambda c: f"({c} <> '' and contains('EIY', {c}))"
    rule = f"""case when c = n and c <> 'C' then '' when {vow('c')} then case when i = 1 then c else '' end
 when c = 'B' then case when i = length(w) and p = 'M' then '' else 'B' end
 when c = 'C' then case when (n = 'I' and n2 = 'A') or n = 'H' then 'X' when {fro('n')} then case when p = 'S' then '' else 'S' end else 'K' end
 when c = 'D' then case when n = 'G' and {fro('n2')} then 'J' else 'T' end
 when c = 'G' then case when (n = 'H' and not {vow('n2')}) or (n = 'N' and (n2 = '' or (n2 = 'E' and n3 = 'D'))) or (p = 'D' and {fro('n')}) then '' when {fro('n')} and p <> 'G' then 'J' else 'K' end
 when c = 'H' then case when (p <> '' and contains('CSPTG', p)) or not {vow('n')} then '' else 'H' end
 when c = 'K' then case when p = 'C' then '' else 'K' end when c = 'P' then case when n = 'H' then 'F' else 'P' end when c = 'Q' then 'K'
 when c = 'S' then case when n = 'H' or (n = 'I' and n2 in ('O', 'A')) then 'X' else 'S' end
 when c = 'T' then case when n = 'I' and n2 in ('O', 'A') then 'X' when n = 'H' then '0' when n = 'C' and n2 = 'H' then '' else 'T' end
 when c = 'V' then 'F' when c in ('W', 'Y') then case when {vow('n')} then c else '' end when c = 'X' then 'KS' when c = 'Z' then 'S'
 when c in ('F', 'J', 'L', 'M', 'N', 'R') then c else '' end"""
    return f"""(select t, any_value(s) as s, coalesce(string_agg({rule}, '' order by i), '') as m from (
 select t, s, w, i, w[i] as c, {p} as p, {n} as n, {n2} as n2, {n3} as n3 from (select t, s, w, unnest(range(1, length(w) + 1)) as i from (
 select t, {soundex_sql('t')} as s, case when regexp_matches(t, '^(AE|GN|KN|PN|WR)') then t[2:] when t[1] = 'X' then 'S' || t[2:] when t[1:2] = 'WH' then 'W' || t[3:] else t end as w
 from ({tokens}) t0) t1) t2) t3 group by t)"""


def method_sql(a: str, b: str) -> str:
    near = f"length({a}.t) >= 4 and length({b}.t) >= 4 and abs(length({a}.t) - length({b}.t)) <= 1 and levenshtein({a}.t, {b}.t) <= 1"
    sound = f"length({a}.t) >= 3 and length({b}.t) >= 3 and abs(length({a}.t) - length({b}.t)) <= 3"
    return f"case when {a}.t = {b}.t then 'EXACT' when {near} then 'EDIT_DISTANCE' when {sound} and {a}.s = {b}.s then 'SOUNDEX' when {sound} and {a}.m = {b}.m then 'METAPHONE' end"


_Q_CLEAN = r"trim(upper(regexp_replace(full_name, '[^A-Za-z\s]', '', 'g')))"
_Q_NAMES = f"(select distinct {_Q_CLEAN} as name from @fx_subjects s)"
_E_NAMES = "(select distinct upper(name) as name from @fx_watchlist w {where})"
_split = lambda names: f"(select name, i as pos, string_split(name, ' ')[i] as t from (select name, unnest(range(1, len(string_split(name, ' ')) + 1)) as i from {names} n0) n1)"


def _token_pairs(e_names: str) -> str:
    codes = lambda names: metaphone_sql(f"select distinct t from {_split(names)} x where t <> ''")
    return f"(select * from (select a.t as a, b.t as b, {method_sql('a', 'b')} as method from {codes(e_names)} a cross join {codes(_Q_NAMES)} b) p where method is not null)"


_DIST = "case method when 'EXACT' then 0 when 'EDIT_DISTANCE' then 1 end"


def name_pairs(e_names: str) -> str:
    """Oracle: matched pairs of names with their evidence as text."""
    return f"""(select entry_name, query_name, string_agg(method || ':' || b || '>' || a, '; ' order by pos) as evidence from (
 select e.name as entry_name, q.name as query_name, e.pos, p.method, p.a, p.b, row_number() over (partition by e.name, q.name, e.pos order by case when p.method = 'EXACT' then 0 else 1 end, q.pos) as rn
 from {_split(e_names)} e join {_token_pairs(e_names)} p on p.a = e.t join {_split(_Q_NAMES)} q on q.t = p.b) m where rn = 1
 group by entry_name, query_name having count(*) = len(string_split(entry_name, ' ')))"""


def evidence_text(column: str = "match_evidence"):
    return F.array_join(
        F.transform(column, lambda m: F.concat(m["method"], F.lit(":"), m["query_token"], F.lit(">"), m["matched_token"])), "; "
    )


# --- F: matching ---------------------------------------------------------------------------


@add("f1_edit_distance", ["part"], "select p_partkey, levenshtein(p_name, lower(p_type)) as distance from part")
def _(part):
    return part.select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@add("f2_fuzzy_equal", ["customer"],
     """select c_custkey, length(a) >= 6 and length(b) >= 6 and abs(length(a) - length(b)) <= 1 and levenshtein(a, b) <= 1 as fuzzy_equal
 from (select c_custkey, substring(c_name, 1, 3 + cast(c_custkey % 20 as int)) as a, replace(substring(c_name, 1, 3 + cast((c_custkey + c_custkey % 3) % 20 as int)), '5', 'S') as b from customer) x""")
def _(customer):
    from ..functions.text import fuzzy_equal

    cut = lambda n: F.substring(F.col("c_name"), F.lit(1), (F.lit(3) + n % 20).cast("int"))
    k = F.col("c_custkey")
    return customer.select("c_custkey", fuzzy_equal(cut(k), F.regexp_replace(cut(k + k % 3), "5", "S")).alias("fuzzy_equal"))


@add("f3_token_match", ["fx_watchlist", "fx_subjects"],
     f"select a as token_a, b as token_b, method, {_DIST} as edit_distance from {_token_pairs(_E_NAMES.format(where=''))} p")
def _(watchlist, subjects):
    tokens = lambda df, name: df.select(F.explode(matching.name_tokens(name)).alias("token"))
    return matching.token_match(tokens(watchlist, F.col("name")), tokens(subjects, matching.clean_query_name(F.col("full_name"))))


@add("f4_name_match", ["fx_watchlist", "fx_subjects"], f"select * from {name_pairs(_E_NAMES.format(where=''))} p")
def _(watchlist, subjects):
    pairs = matching.name_match(watchlist.select(F.upper("name").alias("name")), subjects.select(F.col("full_name").alias("name")))
    return pairs.select("entry_name", "query_name", evidence_text().alias("evidence"))


@add("f5_hash_identifier", ["customer"],
     """select c_custkey, case when v = '' then '' else sha256(upper(regexp_replace(v, '[^A-Za-z0-9]', '', 'g'))) end as digest
 from (select c_custkey, case when c_custkey % 9 = 0 then '' else lower(c_name) end as v from customer) x""")
def _(customer):
    value = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.lower("c_name"))
    return customer.select("c_custkey", hash_identifier(value).alias("digest"))


_ACTIVE = "(select *, upper(regexp_replace(document_number, '[^A-Za-z0-9]', '', 'g')) as num from @fx_watchlist w where active)"
_Q = f"(select case_id, upper(regexp_replace(document_number, '[^A-Za-z0-9]', '', 'g')) as num, {_Q_CLEAN} as name from @fx_subjects s)"
HITS = f"""(select h.case_id, h.ord as entry_order, case when fld = 0 then 'Document Number' else 'Full Name' end as match_field, ev as evidence, e.watchlist_id, e.severity, e.category
 from (select *, row_number() over (partition by case_id order by ord, fld) as rn from (
  select q.case_id, e.entry_order as ord, 0 as fld, null as ev from {_Q} q join {_ACTIVE} e on q.num <> '' and (q.num = e.num or (length(q.num) >= 6 and length(e.num) >= 6 and abs(length(q.num) - length(e.num)) <= 1 and levenshtein(q.num, e.num) <= 1))
  union all select q.case_id, e.entry_order, 1, p.evidence from {_Q} q join {name_pairs(_E_NAMES.format(where='where active'))} p on p.query_name = q.name join {_ACTIVE} e on upper(e.name) = p.entry_name) u) h
 join {_ACTIVE} e on e.entry_order = h.ord where h.rn = 1)"""


@add("f6_watchlist_screen", ["fx_subjects", "fx_watchlist"], f"select * from {HITS} h")
def _(subjects, watchlist):
    hits = matching.watchlist_screen(subjects, watchlist)
    return hits.select("case_id", "entry_order", "match_field", evidence_text().alias("evidence"), "watchlist_id", "severity", "category")


@add("f7_screening_identity", ["fx_rule_docs"],
     """select doc_id as case_id, coalesce(case when has_mrz and surname <> '' then trim(surname || ' ' || given_names) end, full_name) as full_name,
 coalesce(case when has_mrz then mrz_number end, document_number) as document_number from @fx_rule_docs r""")
def _(docs):
    return matching.screening_identity(with_zone(docs).withColumnRenamed("doc_id", "case_id"))


_SIM = lambda a, b: f"greatest(0.0::double, least(1.0::double, (list_cosine_similarity({a}::double[], {b}::double[]) + 1.0::double) / 2.0::double))"


@add("f8_face_similarity", ["fx_pairs"], f"select id_a, id_b, same, {py_round(_SIM('emb_a', 'emb_b'), 6)} as similarity from @fx_pairs p")
def _(pairs):
    return pairs.select("id_a", "id_b", "same", round_exact(face_similarity(F.col("emb_a"), F.col("emb_b")), 6).alias("similarity"))


def probes_of(captures):
    return captures.select("case_id", F.col("live_embedding").alias("embedding"), "label")


def gallery_of(embeddings):
    return embeddings.select(F.col("vec_id").alias("case_id"), "embedding", "label")


_BEST = f"""(select case_id, match_case_id, s from (select c.case_id, e.vec_id as match_case_id, round({_SIM('c.live_embedding', 'e.embedding')}, 12) as s,
 row_number() over (partition by c.case_id order by round({_SIM('c.live_embedding', 'e.embedding')}, 12) desc, e.vec_id) as rn from @fx_captures c join embeddings e on e.vec_id <> c.case_id) z where rn = 1)"""


@add("f9_gallery_best_match", ["fx_captures", "embeddings"],
     f"select case_id, match_case_id, {py_round('s', 3)} as similarity from {_BEST} b where s >= 0.80::double")
def _(captures, embeddings):
    return gallery.gallery_hits(probes_of(captures), gallery_of(embeddings))


@add("f9_indexed_match", ["fx_captures", "embeddings"],
     f"select case_id, match_case_id, {py_round('s', 3)} as similarity from {_BEST} b where s >= 0.80::double")
def _(captures, embeddings):
    found = gallery_index.indexed_best_match(probes_of(captures), gallery_of(embeddings), exact=True)
    return found.where("match_case_id is not null").select("case_id", "match_case_id", round_exact(F.col("similarity"), 3).alias("similarity"))


@add("f9_index_recall", ["fx_captures", "embeddings"],
     f"select count(*) as probes, count(*) filter (where s >= 0.80::double) as exact_matches, true as recall_reached, true as under_half from {_BEST} b")
def _(captures, embeddings):
    probes, faces = probes_of(captures), gallery_of(embeddings)
    found = gallery_index.indexed_best_match(probes, faces)
    told = gallery_index.index_recall(found, gallery.gallery_best_match(probes, faces), faces)
    return told.select("probes", "exact_matches", F.coalesce(F.col("recall") >= 0.99, F.lit(True)).alias("recall_reached"),
                       (F.col("compared_share") < 0.5).alias("under_half"))


@add("f10_gallery_upsert", ["embeddings", "fx_captures"],
     f"""select vec_id as case_id, 0 as created_at, {py_round('embedding[1]', 6)} as first_value from embeddings where vec_id not in (select case_id from @fx_captures c where case_id % 3 > 0)
 union all select case_id, 2, {py_round('live_embedding[2]', 6)} from @fx_captures c where case_id % 3 > 0""")
def _(embeddings, captures):
    held = embeddings.select(F.col("vec_id").alias("case_id"), F.lit(0).alias("created_at"), F.col("embedding").cast("array<double>"))
    seen = captures.where("case_id % 3 > 0").select(
        "case_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("created_at"), "live_embedding"
    ).select("case_id", "created_at", F.when(F.col("created_at") == 2, F.slice("live_embedding", 2, 64)).otherwise(F.col("live_embedding")).alias("embedding"))
    merged = gallery.gallery_upsert(held, seen)
    return merged.select("case_id", "created_at", round_exact(F.get("embedding", F.lit(0)), 6).alias("first_value"))


_CHANGED = lambda f: f"(nullif(a.{f}, '') is distinct from nullif(b.{f}, ''))"
_D = {"document_number": ("Document Number", "CRITICAL"), "surname": ("Surname", "CRITICAL"), "given_names": ("Given Names", "CRITICAL"),
      "birth_date": ("Date of Birth", "HIGH"), "expiry_date": ("Date of Expiry", "HIGH"), "sex": ("Sex", "MEDIUM"),
      "nationality": ("Nationality", "MEDIUM"), "country": ("Issuing Country", "MEDIUM")}
_SHOWN = lambda t, f: f"coalesce(strftime({day6(t + '.' + f)}, '%d/%m/%Y'), {t}.{f})" if f.endswith("_date") else f"{t}.{f}"
_PAIRS = "from (select *, lag(version) over (partition by identity_key order by version) as earlier from @fx_submissions s0) b join @fx_submissions a on a.identity_key = b.identity_key and a.version = b.earlier"
DIFFS = "(" + " union all ".join(
    [f"select b.identity_key, b.version, '{f}' as field, {i} as fno, '{l}' as label, {_SHOWN('a', f)} as v1_value, {_SHOWN('b', f)} as v2_value, {_CHANGED(f)} as changed, case when {_CHANGED(f)} then '{s}' else 'LOW' end as severity {_PAIRS} where a.mrz_parsed and b.mrz_parsed"
     for i, (f, (l, s)) in enumerate(_D.items())]
    + [f"select b.identity_key, b.version, 'portrait', 8, 'Portrait Photo', 'See image', 'See image', b.portrait_status = 'PORTRAIT_CHANGED', case when b.portrait_status = 'PORTRAIT_CHANGED' then 'HIGH' else 'LOW' end {_PAIRS} where a.mrz_parsed and b.mrz_parsed"]
) + ")"


@add("f11_change_detection", ["fx_submissions"],
     f"select identity_key, version, field, label, v1_value, v2_value, changed, severity from {DIFFS} d where field <> 'portrait'")
def _(submissions):
    return matching.change_detection(submissions.drop("portrait_status"))


@add("f12_change_summary", ["fx_submissions"],
     f"""select p.identity_key, p.version, case when d.n is null then 'UNVERIFIABLE' when d.n > 0 then 'CHANGED' else 'UNCHANGED' end as status, d.n as changed_field_count, d.labels as changed_fields
 from (select b.identity_key, b.version {_PAIRS}) p left join (select identity_key, version, count(*) filter (where changed) as n, coalesce(string_agg(label, ', ' order by fno) filter (where changed), '') as labels from {DIFFS} x group by identity_key, version) d
 on d.identity_key = p.identity_key and d.version = p.version""")
def _(submissions):
    return matching.change_summary(submissions).withColumn("changed_fields", F.array_join("changed_fields", ", "))


# --- G: scoring --------------------------------------------------------------------------------

_SUMS = lambda factor: f"least(100.0::double, coalesce(cast(sum(case when factor = '{factor}' then cast(score_impact as decimal(18,6)) end) as double), 0.0::double))"


@add("g1_factor_sums", ["fx_checks"],
     f"select case_id, {_SUMS('MRZ_VALIDATION')} as mrz_raw, {_SUMS('CONSISTENCY')} as consistency_raw from @fx_checks c group by case_id")
def _(checks):
    return risk.factor_sums(checks)


@add("g2_tamper_factor", ["fx_cases", "fx_signals"],
     f"select c.case_id, least(100.0::double, coalesce(s.tamper_risk, 0.1::double) * 100.0::double) as tamper_raw from @fx_cases c left join {SCORES} s on s.case_id = c.case_id")
def _(cases, sig):
    scores = signals.tamper_score(sig, sig)
    return cases.select("case_id").join(scores, "case_id", "left").select("case_id", risk.tamper_factor(F.col("tamper_risk")).alias("tamper_raw"))


_FSIM = f"(case when fs in ('MATCH', 'REVIEW_REQUIRED') then {py_round('similarity', 3)} else 0.0::double end)"
_FRAW = lambda st, sim: f"(case when {st} is null then 15.0::double when {st} = 'MATCH' then greatest(0.0::double, (1.0::double - {sim}) * 40.0::double) when {st} = 'REVIEW_REQUIRED' then greatest(60.0::double, (1.0::double - {sim}) * 100.0::double) else 85.0::double end)"


@add("g3_face_factor", ["fx_faces"], f"select case_id, {_FRAW('fs', _FSIM)} as face_raw from {FACES} f")
def _(faces):
    return signals.face_status(faces).select("case_id", risk.face_factor(F.col("face_status"), F.col("face_similarity")).alias("face_raw"))


# Age gap of the zones of fx_rule_docs.
_GAP = f"""(select case_id, case when b is not null and e is not null then {py_round('photo', 1)} end as photo_age_years, case when b is not null and e is not null then {py_round('photo * case when minor then 1.6::double else 1.0::double end', 1)} end as effective_gap_years,
 case when b is not null and e is not null then minor end as was_minor_at_issue, case when b is not null and e is not null then issued end as issued from (
 select *, greatest(0.0::double, datediff('day', issued, date '{AS_OF}') / 365.25::double) as photo, datediff('day', b, issued) / 365.25::double < 18 as minor from (
 select *, cast(e - case when datediff('day', b, e) / 365.25::double < 18 then interval 5 year else interval 10 year end as date) as issued from (
 select doc_id as case_id, {day6('zb')} as b, {day6('ze')} as e from (select doc_id, case when has_mrz then birth_date end as zb, case when has_mrz then expiry_date end as ze from @fx_rule_docs r) r0) r1) r2) r3)"""
_TIER = "(case when fs = 'MATCH' then case when effective_gap_years >= 8 then 'HIGH' when effective_gap_years >= 4 then 'MODERATE' end end)"
_WEIGHT = lambda w: f"(case {_TIER} when 'HIGH' then {py_round(w + ' * 0.50::double', 4)} when 'MODERATE' then {py_round(w + ' * 0.75::double', 4)} else {w} end)"


def zone_dates(docs):
    return with_zone(docs).select(F.col("doc_id").alias("case_id"), "mrz.birth_date", "mrz.expiry_date")


@add("g4_face_age_gap", ["fx_rule_docs", "fx_faces"],
     f"""select g.case_id, photo_age_years, effective_gap_years, was_minor_at_issue, strftime(issued, '%Y-%m-%d') as estimated_issue_date, {_TIER} as gap_tier, {_WEIGHT('0.30::double')} as face_weight
 from {_GAP} g join {FACES} f on f.case_id = g.case_id""")
def _(docs, faces):
    status = signals.face_status(faces).select("case_id", "face_status")
    cases = zone_dates(docs).join(status, "case_id").withColumn("weight_face", F.lit(0.30))
    return risk.face_age_gap(cases, AS_OF).select(
        "case_id", "photo_age_years", "effective_gap_years", "was_minor_at_issue",
        F.date_format("estimated_issue_date", "yyyy-MM-dd").alias("estimated_issue_date"), "gap_tier", "face_weight",
    )


@add("g5_watchlist_factor", ["fx_subjects", "fx_watchlist"],
     f"""select s.case_id, case when h.case_id is null then 'PASS' else 'FAIL' end as status, h.severity, case when h.case_id is null then 'Watchlist Screening' else 'Demo Watchlist Hit: ' || h.category end as label,
 case when h.case_id is null then 0.0::double else 25.0::double end as score_impact from @fx_subjects s left join {HITS} h on h.case_id = s.case_id""")
def _(subjects, watchlist):
    checks = risk.watchlist_checks(subjects, matching.watchlist_screen(subjects, watchlist))
    return checks.select("case_id", "status", "severity", "label", "score_impact")


@add("g6_duplicate_factor", ["fx_captures", "embeddings"],
     f"""select c.case_id, case when s >= 0.80::double then 'FAIL' else 'PASS' end as status, case when s >= 0.80::double then 'HIGH' end as severity,
 case when s >= 0.80::double then {py_round(py_round('s', 3), 2)} else 0.9::double end as confidence, case when s >= 0.80::double then 30.0::double else 0.0::double end as score_impact
 from @fx_captures c left join {_BEST} b on b.case_id = c.case_id""")
def _(captures, embeddings):
    hits = gallery.gallery_hits(probes_of(captures), gallery_of(embeddings))
    return risk.duplicate_checks(probes_of(captures), hits).select("case_id", "status", "severity", "confidence", "score_impact")


def facts(cases, checks, sig, faces, docs, subjects, watchlist, captures, embeddings):
    """Everything known about the cases of the derived tables."""
    return risk.gather(
        cases, checks, signals.tamper_score(sig, sig), signals.face_status(faces), zone_dates(docs),
        matching.watchlist_screen(subjects, watchlist),
        gallery.gallery_hits(probes_of(captures), gallery_of(embeddings)),
    )


_INPUTS = ["fx_cases", "fx_checks", "fx_signals", "fx_faces", "fx_rule_docs", "fx_subjects", "fx_watchlist", "fx_captures", "embeddings"]
_P0 = "(select 0.25::double as w1, 0.30::double as w2, 0.30::double as w3, 0.10::double as w4, 0.05::double as w5, 24.0::double as t1, 49.0::double as t2, 74.0::double as t3, 0 as policy_id)"
_P5 = "(select weight_mrz as w1, weight_tamper as w2, weight_face as w3, weight_consistency as w4, weight_watchlist as w5, threshold_low as t1, threshold_medium as t2, threshold_high as t3, policy_id from @fx_policies p)"


def scored_sql(policy: str) -> str:
    """Oracle: every case scored under every policy of the given table."""
    return f"""(select *, case when risk_score <= t1 then 'LOW' when risk_score <= t2 then 'MEDIUM' when risk_score <= t3 then 'HIGH' else 'CRITICAL' end as risk_level from (
 select *, crit and pre <= t2 as floored, case when crit and pre <= t2 then t2 + 0.1::double else pre end as risk_score from (
 select *, greatest(0.0::double, least(100.0::double, {py_round('c1 + c2 + c3 + c4 + c5 + dup', 1)})) as pre from (
 select *, {py_round('mrz_raw * w1', 1)} as c1, {py_round('tamper_raw * w2', 1)} as c2, {py_round('face_raw * fw', 1)} as c3, {py_round('cons_raw * w4', 1)} as c4, {py_round('watch_raw * w5', 1)} as c5 from (
 select c.case_id, p.*, coalesce(k.mrz_raw, 0.0::double) as mrz_raw, coalesce(k.cons_raw, 0.0::double) as cons_raw, least(100.0::double, coalesce(s.tamper_risk, 0.1::double) * 100.0::double) as tamper_raw,
  least(100.0::double, {_FRAW('fs', 'coalesce(fsim, 1.0::double)')}) as face_raw, {_WEIGHT('p.w3')} as fw, case when h.case_id is not null then 100.0::double else 0.0::double end as watch_raw,
  case when b.case_id is not null then 30.0::double else 0.0::double end as dup, coalesce(k.crit, false) or coalesce(h.severity = 'CRITICAL', false) as crit
 from @fx_cases c cross join {policy} p
 left join (select case_id, {_SUMS('MRZ_VALIDATION')} as mrz_raw, {_SUMS('CONSISTENCY')} as cons_raw, bool_or(coalesce(severity = 'CRITICAL', false)) as crit from @fx_checks x group by case_id) k on k.case_id = c.case_id
 left join {SCORES} s on s.case_id = c.case_id left join (select case_id, fs, {_FSIM} as fsim from {FACES} f0) f on f.case_id = c.case_id
 left join {_GAP} g on g.case_id = c.case_id left join {HITS} h on h.case_id = c.case_id left join (select case_id from {_BEST} b0 where s >= 0.80::double) b on b.case_id = c.case_id) q1) q2) q3) q4)"""


_REC = " ".join(f"when '{k}' then '{v}'" for k, v in {
    "LOW": "CLEAR FOR ENTRY — Routine processing permitted", "MEDIUM": "ROUTINE VERIFICATION — Officer visual confirmation recommended",
    "HIGH": "SECONDARY INSPECTION — Multiple document risk indicators detected",
    "CRITICAL": "SUPERVISOR ESCALATION — Significant anomalies requiring physical document review"}.items())


@add("g7_total_and_floor", _INPUTS,
     f"select case_id, pre as pre_floor, risk_score, floored as critical_floor_applied from {scored_sql(_P0)} s")
def _(*tables):
    return risk.score_cases(facts(*tables), as_of=AS_OF).select("case_id", "pre_floor", "risk_score", "critical_floor_applied")


@add("g8_tier_and_recommendation", _INPUTS,
     f"""select case_id, risk_score, risk_level, case risk_level {_REC} end as recommendation,
 case risk_level when 'LOW' then 'LOW_RISK' when 'MEDIUM' then 'MEDIUM_RISK' when 'HIGH' then 'REQUIRES_REVIEW' else 'CRITICAL' end as status from {scored_sql(_P0)} s""")
def _(*tables):
    return risk.score_cases(facts(*tables), as_of=AS_OF).select("case_id", "risk_score", "risk_level", "recommendation", "status")


_ROWS = [("MRZ & Document Validation", "w1", "mrz_raw", "c1", "true"), ("Forensic Tamper AI", "w2", "tamper_raw", "c2", "true"),
         ("Biometric Face Verification", "fw", "face_raw", "c3", "true"), ("Data Consistency Crosscheck", "w4", "cons_raw", "c4", "true"),
         ("Simulated Watchlist Adapter", "w5", "watch_raw", "c5", "true"), ("Cross-Case Duplicate Identity", None, None, "dup", "dup > 0"),
         ("Critical Signal Floor", None, None, py_round("risk_score - pre", 1), "floored")]


@add("g9_breakdown_rows", _INPUTS,
     f"with s as materialized (select * from {scored_sql(_P0)} s0) " + " union all ".join(
         f"select case_id, '{n}' as factor, {w or 'null::double'} as weight, {py_round(r, 1) if r else 'null::double'} as raw_risk, {c} as weighted_contribution from s where {cond}"
         for n, w, r, c, cond in _ROWS))
def _(*tables):
    return risk.breakdown_rows(risk.score_cases(facts(*tables), as_of=AS_OF)).drop("line_no")


@add("g10_policy_apply", [*_INPUTS, "fx_policies"],
     f"select case_id, policy_id, risk_score, risk_level from {scored_sql(_P5)} s")
def _(*tables):
    *inputs, policies = tables
    every = risk.under_every_policy(facts(*inputs), policies)
    return risk.score_cases(every, policies, AS_OF).select("case_id", "policy_id", "risk_score", "risk_level")


_TOTAL = "(weight_mrz + weight_tamper + weight_face + weight_consistency + weight_watchlist)"


@add("g11_policy_validate", ["fx_policy_edits"],
     f"""select policy_id, 'WEIGHTS_NOT_100_PERCENT' as violation, {py_round(_TOTAL + ' * 100', 1)} as weight_percent from @fx_policy_edits p where abs({_TOTAL} - 1.0) > 0.01::double
 union all select policy_id, 'THRESHOLDS_NOT_ASCENDING', {py_round(_TOTAL + ' * 100', 1)} from @fx_policy_edits p where not (threshold_low >= 0 and threshold_low < threshold_medium and threshold_medium < threshold_high and threshold_high <= 100)""")
def _(policies):
    return risk.policy_violations(policies)
