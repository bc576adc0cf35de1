"""Ledger, analytics and case lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.hashing import block_hash, canonical_json, canonical_json_text, iso_timestamp, payload_tail
from ..operators import analytics, ledger, lifecycle
from ..session import materialize
from .harness import Catalogue, py_round

CATALOGUE = Catalogue()
add = CATALOGUE.add

# --- oracle: the ledger --------------------------------------------------------------------

_ISO = lambda t: f"(strftime({t}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({t}) % 1000000 = 0 then '' else '.' || lpad(cast(epoch_us({t}) % 1000000 as string), 6, '0') end)"
_TAIL = f"concat_ws('|', coalesce(cast(case_id as string), 'SYSTEM'), action, actor, {_ISO('event_ts')}, metadata)"
_ZERO = "repeat('0', 64)"
SEALED = f"""sealed as (
 select seq, event_ts, case_id, chain_id, action, actor, metadata, pos, tail, {_ZERO} as previous_hash, sha256({_ZERO} || '|' || tail) as entry_hash from ev where pos = 1
 union all select e.seq, e.event_ts, e.case_id, e.chain_id, e.action, e.actor, e.metadata, e.pos, e.tail, s.entry_hash, sha256(s.entry_hash || '|' || e.tail)
 from sealed s join ev e on e.chain_id = s.chain_id and e.pos = s.pos + 1)"""
WITH = f"with recursive ev as (select *, {_TAIL} as tail, row_number() over (partition by chain_id order by event_ts, seq) as pos from @fx_audit a), {SEALED}"
# One chain in five edited, one relinked, one edited and signed again.
FORGED = f"""{WITH}, forged as (select seq, event_ts, case_id, chain_id, action, metadata, pos,
  case when pos = 10 and chain_id % 5 = 1 or pos = 12 and chain_id % 5 = 3 then 'INTRUDER' else actor end as actor,
  case when pos = 7 and chain_id % 5 = 2 then sha256('x') else previous_hash end as previous_hash,
  case when pos = 12 and chain_id % 5 = 3 then sha256(previous_hash || '|' || replace(tail, '|' || actor || '|', '|INTRUDER|')) else entry_hash end as entry_hash from sealed),
 judged as (select *, case when previous_hash <> coalesce(lag(entry_hash) over (partition by chain_id order by event_ts, seq), {_ZERO}) then 'LINKAGE'
  when entry_hash <> sha256(previous_hash || '|' || {_TAIL}) then 'SIGNATURE' end as reason from forged)"""


def sealed_of(audit):
    """The sealed ledger, written once: verification reads it several times."""
    return materialize(ledger.seal_events(audit), "sealed-ledger")


def forge(sealed):
    """The same edits on a sealed ledger."""
    placed = ledger.positions(sealed)
    at = lambda pos, rest: (F.col("position") == pos) & (F.col("chain_id") % 5 == rest)
    resigned = block_hash(
        F.col("previous_hash"), payload_tail(F.col("case_id"), F.col("action"), F.lit("INTRUDER"), F.col("event_ts"), F.col("metadata"))
    )
    return placed.select(
        "seq", "event_ts", "case_id", "chain_id", "action", "metadata",
        F.when(at(10, 1) | at(12, 3), "INTRUDER").otherwise(F.col("actor")).alias("actor"),
        F.when(at(7, 2), F.sha2(F.lit("x"), 256)).otherwise(F.col("previous_hash")).alias("previous_hash"),
        F.when(at(12, 3), resigned).otherwise(F.col("entry_hash")).alias("entry_hash"),
    )


@add("h1_canonical_json", ["fx_cases"],
     """select case_id, case when case_id % 50 = 0 then '{}' else '{"country":"' || country || '","number":"' || document_number || '","zone":"caf\\u00e9"}' end as canonical from @fx_cases c""")
def _(cases):
    entries = F.create_map(F.lit("zone"), F.lit("café"), F.lit("number"), F.col("document_number"), F.lit("country"), F.col("country"))
    return cases.select("case_id", canonical_json(F.when(F.col("case_id") % 50 != 0, entries)).alias("canonical"))


_NESTED = """'{"applicant":{"born":null,"country":"' || country || '","names":["caf\\u00e9",{"a":1,"b":[]}]},"number":' || case when document_number is null then 'null' else '"' || document_number || '"' end || ',"share":' || case when case_id % 2 = 0 then '0.25' else '12500000000.0' end || ',"valid":' || case when case_id % 3 = 0 then 'true' else 'false' end || '}'"""


@add("h1_nested_json", ["fx_cases"], f"select case_id, {_NESTED} as of_struct, {_NESTED} as of_text from @fx_cases c")
def _(cases):
    value = F.struct(
        (F.col("case_id") % 3 == 0).alias("valid"), F.when(F.col("case_id") % 2 == 0, 0.25).otherwise(1.25e10).alias("share"),
        F.col("document_number").alias("number"), F.struct(F.col("country"), F.lit(None).cast("string").alias("born")).alias("applicant"))
    names = F.lit('["café",{"b":[ ],"a":1}]')
    text = F.concat(F.lit('{"valid" : '), (F.col("case_id") % 3 == 0).cast("string"), F.lit(', "share": '),
                    F.when(F.col("case_id") % 2 == 0, "0.250").otherwise("1.25e10"), F.lit(', "number":'),
                    F.coalesce(F.concat(F.lit('"'), F.col("document_number"), F.lit('"')), F.lit("null")),
                    F.lit(',"applicant":{"names":'), names, F.lit(',"country":"'), F.col("country"), F.lit('","born":null}}'))
    nested = F.to_json(value, {"ignoreNullFields": "false"})
    with_names = F.concat(F.expr("substring(nested, 1, length(nested) - 2)"), F.lit(',"names":'), names, F.lit("}}"))
    return cases.withColumn("nested", nested).select(
        "case_id", canonical_json_text(with_names).alias("of_struct"), canonical_json_text(text).alias("of_text"))


@add("h2_block_hash", ["fx_audit"],
     f"select seq, sha256({_ZERO} || '|' || {_TAIL}) as block from @fx_audit a")
def _(audit):
    tail = payload_tail(F.col("case_id"), F.col("action"), F.col("actor"), F.col("event_ts"), F.col("metadata"))
    return audit.select("seq", block_hash(F.lit(None).cast("string"), tail).alias("block"))


SEALED = f"{WITH} select seq, chain_id, previous_hash, entry_hash from sealed"


@add("h3_seal_events", ["fx_audit"], SEALED)
def _(audit):
    return ledger.seal_events(audit).select("seq", "chain_id", "previous_hash", "entry_hash")


@add("h4_verify_chain", ["fx_audit"],
     f"""{FORGED} select chain_id, count(*) filter (where reason is not null) = 0 as valid, count(*) as total_records, max_by(entry_hash, pos) as head_hash,
 min_by(seq, pos) filter (where reason is not null) as compromised_seq, min(pos) filter (where reason is not null) as compromised_position,
 min_by(reason, pos) filter (where reason is not null) as break_reason from judged group by chain_id""")
def _(audit):
    return ledger.verify_chain(forge(sealed_of(audit)))


@add("h4_verify_one_global_chain", ["fx_audit"],
     "select 0 as chain_id, true as valid, count(*) as total_records, max_by(seq, event_ts) as last_seq from @fx_audit a")
def _(audit):
    # chains are sealed and verified side by side; the whole ledger holds when each of them does
    verdicts = ledger.verify_chain(sealed_of(audit)).agg(F.bool_and("valid").alias("valid"), F.sum("total_records").alias("total_records"))
    last = audit.agg(F.lit(0).alias("chain_id"), F.max_by("seq", "event_ts").alias("last_seq"))
    return last.join(F.broadcast(verdicts.withColumn("chain_id", F.lit(0))), "chain_id").select("chain_id", "valid", "total_records", "last_seq")


_CASES = f"""select j.chain_id, j.case_id, v.valid, count(*) as total_records, max_by(entry_hash, pos) as head_hash, max(pos) as last_position
 from judged j join (select chain_id, count(*) filter (where reason is not null) = 0 as valid from judged group by chain_id) v on v.chain_id = j.chain_id group by j.chain_id, j.case_id, v.valid"""


@add("h5_verify_case", ["fx_audit", "events"],
     f"""{FORGED} select e.chain_id, e.case_id, coalesce(valid, true) as valid, coalesce(total_records, 0) as total_records, coalesce(head_hash, {_ZERO}) as head_hash, last_position
 from (select distinct user_id as chain_id, cast(floor(event_id / 6) as bigint) as case_id from events) e left join ({_CASES}) c on c.chain_id = e.chain_id and c.case_id = e.case_id""")
def _(audit, events):
    cases = events.select(F.col("user_id").alias("chain_id"), F.floor(F.col("event_id") / 6).alias("case_id"))
    return ledger.verify_cases(forge(sealed_of(audit)), cases)


@add("h6_anchor_proof", ["fx_audit", "fx_anchors"],
     f"""{FORGED}, vc as ({_CASES}) select vc.chain_id, vc.case_id, vc.valid as chain_valid, case when not vc.valid then 'CHAIN_INVALID' when a.anchor_id is not null then 'ANCHORED' else 'NOT_ANCHORED' end as proof_status,
 case when vc.valid then a.anchor_id end as anchor_id, case when vc.valid then a.tx_hash end as tx_hash
 from vc left join (select v2.chain_id, v2.case_id, min_by(n.anchor_id, n.created_epoch) as anchor_id, min_by(n.tx_hash, n.created_epoch) as tx_hash from vc v2 join @fx_anchors n
  on n.chain_id = v2.chain_id and n.total_records >= v2.last_position group by v2.chain_id, v2.case_id) a on a.chain_id = vc.chain_id and a.case_id = vc.case_id""")
def _(audit, anchors):
    verified = ledger.verify_cases(forge(sealed_of(audit)))
    return ledger.anchor_proof(verified, anchors, block=16)


@add("h6_proof_for_numbers", ["fx_audit", "fx_anchors", "fx_cases"],
     f"""{FORGED}, vc as ({_CASES}), proofs as (select vc.chain_id, vc.case_id, case when not vc.valid then 'CHAIN_INVALID' when exists (select 1 from @fx_anchors n where n.chain_id = vc.chain_id and n.total_records >= vc.last_position) then 'ANCHORED' else 'NOT_ANCHORED' end as proof_status from vc)
 select n.case_number, p.chain_id, case when n.case_id is null then 'CASE_NOT_FOUND' else coalesce(p.proof_status, 'NO_AUDIT_TRAIL') end as proof_status
 from (select case_number, case_id from @fx_cases c union all select 'NO-' || case_number, null from @fx_cases c where case_id % 10 = 0) n left join proofs p on p.case_id = n.case_id""")
def _(audit, anchors, cases):
    proofs = ledger.anchor_proof(ledger.verify_cases(forge(sealed_of(audit))), anchors, block=16)
    unknown = cases.where("case_id % 10 = 0").select(F.concat(F.lit("NO-"), "case_number").alias("case_number"))
    asked = cases.select("case_number").unionByName(unknown)
    return ledger.proof_for_numbers(asked, cases, proofs).select("case_number", "chain_id", "proof_status")


@add("h7_ledger_stats", ["fx_audit"],
     f"{WITH} select chain_id, count(*) as total_records, max_by(entry_hash, pos) as head_hash, {_ZERO} as genesis_hash, {_ISO('max(event_ts)')} as last_timestamp from sealed group by chain_id")
def _(audit):
    stats = ledger.ledger_stats(ledger.seal_events(audit))
    return stats.withColumn("last_timestamp", iso_timestamp(F.col("last_timestamp")))


@add("h8_anchor_snapshot", ["fx_audit"],
     f"{WITH} select chain_id, max_by(entry_hash, pos) as head_hash, count(*) as total_records, '2026-01-01' as anchored_at from sealed group by chain_id")
def _(audit):
    return ledger.anchor_snapshot(ledger.seal_events(audit), F.lit("2026-01-01"))


@add("h8_recent_anchors", ["fx_anchors"],
     "select anchor_id, chain_id, total_records, tx_hash from @fx_anchors a order by created_epoch desc, anchor_id desc limit 20")
def _(anchors):
    return ledger.recent_anchors(anchors).select("anchor_id", "chain_id", "total_records", "tx_hash")


# --- I: analytics ------------------------------------------------------------------------------


@add("i1_dashboard_kpis", ["fx_cases"],
     """select count(*) as documents_screened, count(*) filter (where risk_level = 'HIGH') as high_risk_cases, count(*) filter (where risk_level = 'CRITICAL') as critical_cases,
 count(*) filter (where officer_decision = 'CLEARED') as cleared_cases, count(*) filter (where officer_decision = 'PENDING' and risk_score >= 24) as cases_requiring_review from @fx_cases c""")
def _(cases):
    return analytics.dashboard_kpis(cases)


@add("i2_risk_distribution", ["fx_cases"],
     "select t.risk_level, count(c.case_id) as n from (select unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) as risk_level) t left join @fx_cases c on c.risk_level = t.risk_level group by t.risk_level")
def _(cases):
    return analytics.risk_distribution(cases)


@add("i3_document_type_counts", ["fx_cases"],
     "select coalesce(document_type, 'Passport') as document_type, count(*) as n from @fx_cases c group by 1")
def _(cases):
    return analytics.document_type_counts(cases)


@add("i4_avg_processing_ms", ["fx_cases"],
     f"select {py_round('coalesce(cast(sum(cast(processing_time_ms as decimal(18,6))) as double) / count(processing_time_ms), 0.0::double)', 1)} as avg_processing_time_ms from @fx_cases c")
def _(cases):
    return analytics.avg_processing_ms(cases)


@add("i5_step_latency", ["fx_audit"],
     "with s as (select case_id, " + ", ".join(f"max(case when action = '{a}' then epoch_us(event_ts) end) as a{i}" for i, a in enumerate(
         ["DOCUMENT_UPLOADED", "OCR_COMPLETED", "MRZ_VALIDATED", "TAMPER_ANALYSIS_COMPLETED", "FACE_VERIFIED", "RISK_CALCULATED"]))
     + " from @fx_audit a group by case_id) " + " union all ".join(
         f"select '{label}' as module, {py_round(f'coalesce(cast(sum(a{i + 1} - a{i}) as double) / count(*) / 1000.0::double, 0.0::double)', 1)} as time_ms, count(*) as sample_count from s where a4 is not null and a{i + 1} - a{i} >= 0"
         for i, (_, _, label) in enumerate(fixed.LATENCY_STEPS)))
def _(audit):
    return analytics.step_latency(audit)


@add("i6_top_risk_reasons", ["fx_checks"],
     "select label as reason, count(*) as n from @fx_checks c where status = 'FAIL' group by label order by n desc, label limit 6")
def _(checks):
    return analytics.top_risk_reasons(checks)


@add("i7_recent_cases", ["fx_cases"], "select case_id, case_number from @fx_cases c order by created_at desc, case_id desc limit 10")
def _(cases):
    return analytics.recent_cases(cases).select("case_id", "case_number")


_RANK = "case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end"


@add("i8_list_cases", ["fx_cases", "fx_checks"],
     f"""with page as (select case_id, case_number, created_at from @fx_cases c where risk_level = 'HIGH' and contains(lower(country), 'nation_1') order by created_at desc, case_id desc limit 500 offset 20),
 f as (select k.case_id, label, row_number() over (partition by k.case_id order by {_RANK}, score_impact desc, label, check_seq, part_ref, tie_ref) as rn from @fx_checks k join page p on p.case_id = k.case_id where status = 'FAIL')
 select p.case_id, p.case_number, count(f.label) as flagged_check_count, coalesce(string_agg(label, ', ' order by rn) filter (where rn <= 2), '') as top_flagged_checks from page p left join f on f.case_id = p.case_id group by p.case_id, p.case_number""")
def _(cases, checks):
    page = analytics.list_cases(cases, checks, risk_level="HIGH", country="Nation_1", limit=500, offset=20)
    return page.select("case_id", "case_number", "flagged_check_count", F.array_join("top_flagged_checks", ", ").alias("top_flagged_checks"))


@add("i9_case_detail", ["fx_cases", "fx_analyses", "fx_checks", "fx_audit"],
     """select c.case_id, c.case_number, (select count(*) from @fx_analyses a where a.case_id = c.case_id) as n_analyses,
 (select coalesce(string_agg(label, ', ' order by check_seq, factor, status, severity nulls first, score_impact, label), '') from @fx_checks k where k.case_id = c.case_id) as checks,
 (select coalesce(string_agg(action, ' > ' order by event_ts, seq), '') from @fx_audit t where t.case_id = c.case_id) as trail from @fx_cases c where c.case_id = 77""")
def _(cases, analyses, checks, audit):
    one = analytics.case_detail(cases, analyses, checks, audit, 77)
    join = lambda c, f, sep: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), sep), F.lit(""))
    return one.select("case_id", "case_number", F.size("analyses").cast("long").alias("n_analyses"),
                      join("checks", "label", ", ").alias("checks"), join("audit_trail", "action", " > ").alias("trail"))


@add("i10_review_queue", ["fx_cases"],
     """select case_id, 'ALL' as tab from @fx_cases c where officer_decision = 'PENDING' and (contains(lower(case_number), 'urgent') or contains(lower(country), 'urgent') or contains(lower(recommendation), 'urgent'))
 union all select case_id, 'CLEARED' from @fx_cases c where officer_decision = 'CLEARED'
 union all select case_id, 'HIGH' from @fx_cases c where officer_decision = 'PENDING' and risk_level = 'HIGH'""")
def _(cases):
    tab = lambda t, q: analytics.review_queue(cases, t, q).select("case_id", F.lit(t).alias("tab"))
    return tab("ALL", "URGENT").unionByName(tab("CLEARED", "")).unionByName(tab("HIGH", ""))


@add("i11_case_archive", ["fx_cases"],
     """select case_id, 'CRITICAL' as tag from @fx_cases c where status = 'CRITICAL' or risk_level = 'CRITICAL' or officer_decision = 'CRITICAL'
 union all select case_id, 'ALL' from @fx_cases c where contains(lower(country), 'nation_2')""")
def _(cases):
    tag = lambda t, q: analytics.case_archive(cases, t, q).select("case_id", F.lit(t).alias("tag"))
    return tag("CRITICAL", "").unionByName(tag("ALL", "Nation_2"))


@add("i12_audit_search", ["fx_audit"],
     """select seq, action, actor from @fx_audit a where contains(lower(action), 'upload') and contains(lower(actor), 'officer-1') order by event_ts desc, seq desc limit 500 offset 10""")
def _(audit):
    return analytics.audit_search(audit, action="upload", actor="Officer-1", limit=500, offset=10).select("seq", "action", "actor")


@add("i13_audit_actor_class", ["fx_audit"],
     f"""{WITH} select seq, 'OFFICER' as kind from sealed where contains(actor, 'OFFICER') union all select seq, 'PURGED' from sealed where contains(action, 'PURGE')
 union all select seq, 'AI' from sealed where actor like 'AI%' and (contains(entry_hash, 'abc') or contains(cast(case_id as string), 'abc') or contains(lower(action), 'abc') or contains(lower(actor), 'abc'))""")
def _(audit):
    sealed = ledger.seal_events(audit)
    part = lambda k, q: analytics.audit_actor_class(sealed, k, q).select("seq", F.lit(k).alias("kind"))
    return part("OFFICER", "").unionByName(part("PURGED", "")).unionByName(part("AI", "ABC"))


@add("i14_check_ordering", ["fx_checks"],
     f"""select case_id, label, score_impact, case factor when 'MRZ_VALIDATION' then 0 when 'TAMPER' then 1 when 'FACE' then 2 when 'CONSISTENCY' then 3 when 'WATCHLIST' then 4 when 'IDENTITY' then 5 else 6 end as factor_rank,
 case status when 'FAIL' then 0 when 'INFO' then 1 when 'PASS' then 2 when 'NOT_APPLICABLE' then 3 end as status_rank, {_RANK.replace('else 4', 'else 9')} as severity_rank from @fx_checks c""")
def _(checks):
    return analytics.check_ordering(checks).select("case_id", "label", "score_impact", "factor_rank", "status_rank", "severity_rank")


_PCT = lambda cond: f"cast(floor(count(*) filter (where {cond}) * 100.0::double / count(*) + 0.5) as bigint)"


@add("i15_kpi_ratios", ["fx_cases"],
     "select " + ", ".join([f"{_PCT("officer_decision = 'CLEARED'")} as mitigation_percent", f"{_PCT("risk_level in ('HIGH', 'CRITICAL')")} as yield_percent"]
                           + [f"{_PCT('risk_level = ' + repr(t))} as {t.lower()}_percent" for t in fixed.TIERS]) + " from @fx_cases c")
def _(cases):
    return analytics.kpi_ratios(cases)


@add("i16_compliance_status", ["fx_cases", "fx_audit"],
     """select (select count(*) from @fx_cases c) as total_cases, (select count(*) from @fx_cases c where case_id % 3 <> 0) as cases_with_hashed_identifier,
 (select count(*) from @fx_cases c where biometrics_purged) as cases_purged, (select count(*) from @fx_audit a where action = 'BIOMETRICS_PURGED') as purge_events, true as ledger_valid, (select count(*) from @fx_audit a) as ledger_records""")
def _(cases, audit):
    hashed = cases.withColumn("document_number_hash", F.when(F.col("case_id") % 3 != 0, F.sha2("document_number", 256)))
    return analytics.compliance_status(hashed, audit, ledger.verify_chain(sealed_of(audit)))


# --- P: lifecycle --------------------------------------------------------------------------------

_PURGE = "(select case_id from @fx_cases c where risk_level = 'LOW')"


def _purged(cases, analyses, embeddings):
    faces = embeddings.select(F.col("vec_id").alias("case_id"), "embedding")
    return lifecycle.purge_biometrics(
        cases.where("risk_level = 'LOW'"), cases, analyses, faces, F.to_timestamp(F.lit("2026-01-01 00:00:00")), "OFFICER-01"
    )


@add("p1_purge_biometrics", ["fx_cases", "fx_analyses", "embeddings"],
     f"""select case_id, case when case_id in {_PURGE} then '[PURGED_PRIVACY_COMPLIANCE]' else document_image_path end as document_image_path,
 case when case_id in {_PURGE} then '[PURGED_PRIVACY_COMPLIANCE]' else face_image_path end as face_image_path, biometrics_purged or case_id in {_PURGE} as biometrics_purged from @fx_analyses a""")
def _(cases, analyses, embeddings):
    return _purged(cases, analyses, embeddings)["analyses"]


@add("p1_purge_gallery", ["fx_cases", "fx_analyses", "embeddings"],
     f"select vec_id as case_id from embeddings where vec_id not in {_PURGE}")
def _(cases, analyses, embeddings):
    return _purged(cases, analyses, embeddings)["gallery"].select("case_id")


@add("p1_purge_events", ["fx_cases", "fx_analyses", "embeddings"],
     """select c.case_id, 'BIOMETRICS_PURGED' as action, 'PRIVACY-SCRUBBER-ENGINE' as actor, '{"case_number":"' || case_number || '","protocol":"GDPR-Art17-Privacy-by-Design","purged_files_count":"' ||
 cast(3 + case when document_image_path not like '[PURGED%' then 1 else 0 end + case when face_image_path is not null and face_image_path not like '[PURGED%' then 1 else 0 end as string)
 || '","retained_metadata":"Anonymized hash and risk score only","triggered_by":"OFFICER-01"}' as metadata from @fx_cases c join @fx_analyses a on a.case_id = c.case_id where risk_level = 'LOW'""")
def _(cases, analyses, embeddings):
    return _purged(cases, analyses, embeddings)["events"].drop("event_ts")


@add("p2_delete_cases", ["fx_cases", "fx_checks", "fx_analyses", "fx_audit"],
     " union all ".join(f"select '{n}' as tbl, case_id, count(*) as n from @{t} t where case_id not in {_PURGE} group by case_id"
                        for n, t in {"checks": "fx_checks", "analyses": "fx_analyses", "audit": "fx_audit"}.items()))
def _(cases, checks, analyses, audit):
    kept = lifecycle.delete_cases(cases.where("risk_level = 'LOW'"), {"checks": checks, "analyses": analyses, "audit": audit})
    rows = [df.groupBy("case_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "case_id", "n") for n, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@add("p3_deletion_impact", ["fx_audit", "fx_cases"],
     f"""{WITH}, rest as (select * from sealed where case_id not in {_PURGE}) select chain_id, seq, case_id, p as position, 'LINKAGE' as break_reason from (
 select *, row_number() over (partition by chain_id order by event_ts, seq) as p, coalesce(lag(entry_hash) over (partition by chain_id order by event_ts, seq), {_ZERO}) as before from rest) x where previous_hash <> before""")
def _(audit, cases):
    return lifecycle.deletion_impact(sealed_of(audit), cases.where("risk_level = 'LOW'"))


_VALID = "decision in ('CLEARED', 'REQUIRES_INSPECTION', 'ESCALATED')"


@add("p4_apply_decisions", ["fx_cases", "fx_decisions"],
     f"""select c.case_id, coalesce(d.decision, c.officer_decision) as officer_decision, coalesce(d.decision, c.status) as status, d.notes as officer_notes from @fx_cases c
 left join (select case_id, decision, notes, row_number() over (partition by case_id order by decided_at desc, decision_seq desc) as rn from @fx_decisions x where {_VALID}) d on d.case_id = c.case_id and d.rn = 1""")
def _(cases, decisions):
    updated, _, _ = lifecycle.apply_decisions(cases, decisions)
    return updated.select("case_id", "officer_decision", "status", "officer_notes")


@add("p4_rejected_decisions", ["fx_cases", "fx_decisions"], f"select decision_seq, decision from @fx_decisions d where not ({_VALID})")
def _(cases, decisions):
    return lifecycle.apply_decisions(cases, decisions)[1].select("decision_seq", "decision")


@add("p5_backfill_case_fields", ["fx_cases", "fx_rule_docs"],
     """select c.case_id, case when c.case_id % 4 = 0 and r.zc <> '' then r.zc when c.case_id % 4 = 0 then 'Unknown' else c.country end as country,
 case when coalesce(r.zn, r.document_number) is not null then sha256(upper(regexp_replace(coalesce(r.zn, r.document_number), '[^A-Za-z0-9]', '', 'g'))) end as document_number_hash
 from @fx_cases c left join (select doc_id, case when has_mrz then mrz_country end as zc, case when has_mrz then mrz_number end as zn, document_number from @fx_rule_docs d) r on r.doc_id = c.case_id""")
def _(cases, docs):
    declared = cases.select("case_id", F.when(F.col("case_id") % 4 == 0, "Unknown").otherwise(F.col("country")).alias("country"))
    read = docs.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("has_mrz"), F.col("mrz_country")).alias("mrz_country"),
        F.when(F.col("has_mrz"), F.col("mrz_number")).alias("mrz_number"), F.col("document_number").alias("ocr_number"),
    )
    return lifecycle.backfill_case_fields(declared, read)


@add("p6_assign_case_numbers", ["orders", "customer"],
     """select o_orderkey as case_id, 'CS-2026-' || case when length(cast(n as string)) < 5 then lpad(cast(n as string), 5, '0') else cast(n as string) end as case_number from (
 select o_orderkey, row_number() over (order by md5(cast(o_orderkey as string)), o_orderkey) + (select max(c_custkey) from customer) as n from orders) x""")
def _(orders, customer):
    existing = customer.select(lifecycle.case_number(F.col("c_custkey")).alias("case_number"))
    return lifecycle.assign_case_numbers(orders.select(F.col("o_orderkey").alias("case_id")), existing)


@add("p6_duplicate_case_numbers", ["customer"], "select c_mktsegment as case_number, count(*) as n from customer group by 1 having count(*) > 1")
def _(customer):
    return lifecycle.duplicate_case_numbers(customer.select(F.col("c_mktsegment").alias("case_number")))


_STUCK = "(select case_id from @fx_cases c where officer_decision = 'PENDING' and case_id not in (select case_id from @fx_audit a where action = 'RISK_CALCULATED'))"


@add("p7_drop_stuck_cases", ["fx_cases", "fx_audit", "fx_checks"],
     f"""select 'cases' as tbl, count(*) as n from @fx_cases c where case_id not in {_STUCK} union all select 'audit', count(*) from @fx_audit a where case_id not in {_STUCK}
 union all select 'checks', count(*) from @fx_checks k where case_id not in {_STUCK}""")
def _(cases, audit, checks):
    running = cases.withColumn("status", F.when(F.col("officer_decision") == "PENDING", "PROCESSING").otherwise(F.col("status")))
    kept = lifecycle.drop_stuck_cases(running, audit, {"checks": checks})
    rows = [df.agg(F.lit(n).alias("tbl"), F.count("*").alias("n")) for n, df in kept.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@add("p8_encrypt_embeddings", ["embeddings"],
     f"select vec_id, len(embedding) as dims, {py_round('embedding[1]', 6)} as first_value, true as hidden, true as wrong_key_is_null from embeddings")
def _(embeddings):
    key, other = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    hidden = lifecycle.encrypt_embeddings(embeddings, key).withColumnRenamed("embedding", "blob")
    both = hidden.withColumns({"embedding": F.col("blob"), "wrong": F.col("blob")})
    clear = lifecycle.decrypt_embeddings(lifecycle.decrypt_embeddings(both, key), other, "wrong")
    from ..functions.numbers import round_exact

    return clear.select(
        "vec_id", F.size("embedding").cast("long").alias("dims"), round_exact(F.get("embedding", F.lit(0)), 6).alias("first_value"),
        (F.length("blob") > 64).alias("hidden"), F.col("wrong").isNull().alias("wrong_key_is_null"),
    )
