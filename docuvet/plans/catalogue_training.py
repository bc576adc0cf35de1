"""Model evaluation, training-set preparation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import round_exact
from ..functions.vectors import face_similarity
from ..operators import evaluate, ledger, matching, trainset
from ..session import scratch_dir, spread
from ..sources import annotations
from ..streaming import captures as capture_stream, keyed, latency, watchlist as watch_stream
from . import fixtures
from .catalogue_extract import _RESOLVED, parsed_sql
from .catalogue_operations import SEALED
from .catalogue_risk import _SIM, HITS, gallery_of, probes_of
from .catalogue_rules import _MEAS_SCORE, EXIF, tags
from .harness import Catalogue, expand, py_round

CATALOGUE = Catalogue()
add = CATALOGUE.add


def rounded(df, digits: int = 9, keep: tuple[str, ...] = ()):
    """Doubles to a fixed number of places, so that both engines print the same value."""
    fix = lambda f: round_exact(F.col(f.name), digits).alias(f.name)
    return df.select(*[fix(f) if f.dataType.typeName() == "double" and f.name not in keep else F.col(f.name) for f in df.schema])


R = lambda e, d=9: py_round(e, d)
_share = lambda a, b: f"(case when {b} <> 0 then cast({a} as double) / cast({b} as double) else 'nan'::double end)"
_mean = lambda v: f"(cast(sum(cast({v} as decimal(18,6))) as double) / count({v}))"

# --- K: evaluation --------------------------------------------------------------------------

_CONF = lambda pred, y: f"count(*) filter (where {pred} and {y} = 1) as tp, count(*) filter (where {pred} and {y} = 0) as fp, count(*) filter (where not {pred} and {y} = 0) as tn, count(*) filter (where not {pred} and {y} = 1) as fn"
_RATES = f"{R(_share('tp + tn', '(tp + fp + tn + fn)'))} as accuracy, {R(_share('fp', '(fp + tn)'))} as far, {R(_share('fn', '(fn + tp)'))} as frr"


@add("k1_confusion_metrics", ["fx_predictions"],
     f"""select n, tp, fp, tn, fn, {R('m0')} as mean_prob_negative, {R('m1')} as mean_prob_positive, {_RATES}, {R('p')} as precision, {R('r')} as recall, {R('2 * p * r / (p + r)')} as f1 from (
 select *, {_share('tp', '(tp + fp)')} as p, {_share('tp', '(tp + fn)')} as r from (select count(*) as n, {_CONF('prob > 0.5', 'y')}, {_mean('case when y = 0 then prob end')} as m0, {_mean('case when y = 1 then prob end')} as m1 from @fx_predictions f) a) b""")
def _(predictions):
    return rounded(evaluate.confusion_metrics(predictions))


_SCORED = f"(select same, {_SIM('emb_a', 'emb_b')} as score from @fx_pairs p)"
_SWEEP = f"""(select step, threshold, tp, fp, tn, fn, {_RATES} from (select i as step, 0.05::double + i * 0.01::double as threshold, {_CONF('score >= 0.05::double + i * 0.01::double', 'same')}
 from {_SCORED} s cross join (select unnest(range(0, 90)) as i) t group by i) x)"""


def scored_pairs(pairs):
    return pairs.select("same", face_similarity(F.col("emb_a"), F.col("emb_b")).alias("score"))


@add("k2_threshold_sweep", ["fx_pairs"], f"select step, tp, fp, tn, fn, accuracy, far, frr from {_SWEEP} s")
def _(pairs):
    return rounded(evaluate.threshold_sweep(scored_pairs(pairs)).drop("threshold")).withColumn("step", F.col("step").cast("long"))


@add("k2_best_threshold", ["fx_pairs"],
     f"select step, {R('threshold', 2)} as threshold, accuracy from {_SWEEP} s order by (tp + tn) desc, step limit 1")
def _(pairs):
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored_pairs(pairs)))
    return best.select(F.col("step").cast("long").alias("step"), round_exact(F.col("threshold"), 2).alias("threshold"), round_exact(F.col("accuracy"), 9).alias("accuracy"))


_AT = [0.5, 0.6, 0.72, 0.8]


@add("k3_rates_at_threshold", ["fx_pairs"],
     " union all ".join(f"select {t}::double as threshold, tp, fp, tn, fn, {_RATES} from (select {_CONF(f'score >= {t}::double', 'same')} from {_SCORED} s) x" for t in _AT))
def _(pairs):
    return rounded(evaluate.rates_at_thresholds(scored_pairs(pairs), _AT), keep=("threshold",))


@add("k4_score_distribution", ["fx_scores"],
     f"""select domain, count(prob) as n, {R('avg(prob)')} as mean, {R('stddev_pop(prob)')} as std, min(prob) as min, max(prob) as max, {R('quantile_cont(prob, 0.5)')} as p50,
 {R('quantile_cont(prob, 0.9)')} as p90, {R('quantile_cont(prob, 0.99)')} as p99 from @fx_scores f group by domain""")
def _(predictions):
    return rounded(evaluate.score_distribution(predictions, "domain", "prob"))


_IMPOSTOR = f"""(select c.case_id, max({_SIM('c.live_embedding', 'e.embedding')}) as score from @fx_captures c join embeddings e on e.label <> c.label group by c.case_id)"""
_FAR_AT = [0.70, 0.75, 0.80, 0.85, 0.90]


@add("k5_one_to_many_far", ["fx_captures", "embeddings"],
     " union all ".join(f"select {t}::double as threshold, {R(f'count(*) filter (where score >= {t}::double) / count(*)::double')} as far, count(*) as n, {R('avg(score)')} as mean, {R('stddev_pop(score)')} as std, {R('min(score)')} as min, {R('max(score)')} as max, {R('quantile_cont(score, 0.99)')} as p99 from {_IMPOSTOR} s" for t in _FAR_AT))
def _(captures, embeddings):
    scores = evaluate.impostor_scores(probes_of(captures), gallery_of(embeddings), "label")
    return rounded(evaluate.one_to_many_far(scores, _FAR_AT), keep=("threshold",))


_DUP = f"""(select case_id, owner, s from (select c.case_id, e.vec_id as owner, round({_SIM('c.live_embedding', 'e.embedding')}, 12) as s,
 row_number() over (partition by c.case_id order by round({_SIM('c.live_embedding', 'e.embedding')}, 12) desc, e.vec_id) as rn from @fx_captures c cross join embeddings e) z where rn = 1)"""


@add("k6_duplicate_recall", ["fx_captures", "embeddings"],
     f"""select count(*) as probes, count(*) filter (where s >= 0.80::double) as flagged, {R('count(*) filter (where s >= 0.80::double) / count(*)::double')} as recall, count(*) filter (where owner = case_id) as correct_identity,
 {R('avg(s)')} as mean_similarity, {R('min(s)')} as min_similarity from {_DUP} d""")
def _(captures, embeddings):
    # Second captures of enrolled people: the gallery rows get case ids of their own.
    offset = 1_000_000_000_000
    held = embeddings.select((F.col("vec_id") + offset).alias("case_id"), "embedding", F.col("vec_id").alias("person"))
    probes = captures.select("case_id", F.col("live_embedding").alias("embedding"), F.col("case_id").alias("person"))
    return rounded(evaluate.duplicate_recall(probes, held, "person"))


def reads(lines):
    """Truth lines with the lines a reader returned."""
    return lines.withColumn("ocr_lines", F.filter(F.array("ocr1", "ocr2"), lambda x: x.isNotNull()))


_ACC = lambda t: f"(1.0::double - least(levenshtein(ocr1, {t}), levenshtein(ocr2, {t})) / greatest(length({t}), case when levenshtein(ocr1, {t}) <= levenshtein(ocr2, {t}) then length(ocr1) else length(ocr2) end)::double)"


@add("k7_mrz_line_accuracy", ["fx_mrz_ocr"],
     f"""select doc_type, count(*) as n, count(*) filter (where ocr2 is null) as not_found, {R('count(*) filter (where ocr2 is null) / count(*)::double')} as not_found_share,
 {R(f"(sum(case when ocr2 is not null then {_ACC('line1')} + {_ACC('line2')} end) / (2 * count(ocr2)))")} as mean_line_accuracy from @fx_mrz_ocr m group by doc_type""")
def _(lines):
    return rounded(evaluate.mrz_line_accuracy(reads(spread(lines))))


_TRUTH = parsed_sql("select doc_id, line1 as raw1, line2 as raw2, '' as raw3 from @fx_mrz_lines m", "TD3", "doc_id")
_READ = parsed_sql("select doc_id, ocr1 as raw1, ocr2 as raw2, '' as raw3 from @fx_mrz_ocr m where ocr2 is not null", "TD3", "doc_id")


@add("k8_mrz_field_accuracy", ["fx_mrz_ocr"],
     f"with t as materialized ({_TRUTH}), r as materialized ({_READ}) " + " union all ".join(
         f"select '{f}' as field, count(*) as n, count(*) filter (where trim(t.{f}) = trim(r.{f})) as matched, {R(f'count(*) filter (where trim(t.{f}) = trim(r.{f})) / count(*)::double')} as rate from t join r on r.doc_id = t.doc_id where t.is_valid"
         for f in evaluate.MRZ_FIELDS))
def _(lines):
    return rounded(evaluate.mrz_field_accuracy(reads(lines)))


@add("k8_mrz_checksum_rates", ["fx_mrz_ocr"],
     f"""select coalesce(doc_type, 'ALL') as doc_type, count(*) as n, count(*) filter (where coalesce(r.is_valid, false)) as passed, {R('count(*) filter (where coalesce(r.is_valid, false)) / count(*)::double')} as pass_rate
 from ({_TRUTH}) t join @fx_mrz_ocr m on m.doc_id = t.doc_id left join ({_READ}) r on r.doc_id = t.doc_id where t.is_valid group by rollup(doc_type)""")
def _(lines):
    return rounded(evaluate.mrz_checksum_rates(reads(lines)))


@add("k9_mrz_failure_report", ["fx_mrz_ocr"],
     f"""select doc_type, doc_id, line1, line2, ocr1 || coalesce(' / ' || ocr2, '') as ocr, verdict as checksums from (
 select m.*, 'Document Number Checksum=' || r.number_ok || ', Date of Birth Checksum=' || r.birth_ok || ', Expiry Date Checksum=' || r.expiry_ok || ', Composite Checksum=' || r.composite_ok as verdict,
 row_number() over (partition by doc_type order by m.doc_id) as rn from ({_TRUTH}) t join @fx_mrz_ocr m on m.doc_id = t.doc_id left join ({_READ}) r on r.doc_id = t.doc_id where t.is_valid and not coalesce(r.is_valid, false)) x where rn <= 8""")
def _(lines):
    return evaluate.mrz_failure_report(reads(lines))


_GROUPED = f"(select x.case_id, case when x.case_id % 3 = 0 then 'Tp' else 'Au' end as grp from @fx_exif x)"
_HIT = lambda g: f"count(distinct e.case_id || '/' || e.type) filter (where grp = '{g}')"


@add("k10_signal_hit_rates", ["fx_exif"],
     f"""with g as (select * from {_GROUPED} y), e as (select * from {EXIF} z), n as (select count(*) filter (where grp = 'Au') as na, count(*) filter (where grp = 'Tp') as nt from g),
 h as (select e.type, count(*) filter (where grp = 'Au') as a, count(*) filter (where grp = 'Tp') as b from e join g on g.case_id = e.case_id group by e.type
  union all select 'ANY', count(distinct e.case_id) filter (where grp = 'Au'), count(distinct e.case_id) filter (where grp = 'Tp') from e join g on g.case_id = e.case_id
  union all select 'TOTAL', count(*) filter (where grp = 'Au'), count(*) filter (where grp = 'Tp') from e join g on g.case_id = e.case_id)
 select type, a as hits_a, b as hits_b, {R('a / na::double')} as rate_a, {R('b / nt::double')} as rate_b, {R('b / nt::double - a / na::double')} as delta from h cross join n""")
def _(images):
    from ..operators import signals

    grouped = images.select("case_id", F.when(F.col("case_id") % 3 == 0, "Tp").otherwise("Au").alias("grp"))
    return rounded(evaluate.signal_hit_rates(grouped, signals.exif_signals(tags(images)), "grp", ["Au", "Tp"]))


_EXIF_SCORE = lambda extra: f"least(0.96::double, greatest(0.04::double, {py_round(f'cast(cast(m.mean_ela * 2.0::double + {extra} as decimal(18,6)) as double)', 2)}))"
_TIERS = lambda s: f"case when {s} >= 0.85 then 'CRITICAL' when {s} >= 0.70 then 'HIGH' when {s} >= 0.40 then 'MEDIUM' else 'LOW' end"


@add("k11_score_impact", ["fx_measures", "fx_exif"],
     f"""select count(*) as checked, count(*) filter (where {_TIERS('sw')} <> {_TIERS('so')}) as tier_changed, {R('avg(cast(sw - so as decimal(18,6)))')} as mean_delta, {R('max(sw - so)')} as max_delta from (
 select {_EXIF_SCORE('coalesce(added, 0.0::double)')} as sw, {_EXIF_SCORE('0.0::double')} as so from @fx_measures m left join (select case_id, cast(sum(cast(confidence * 0.25::double as decimal(18,6))) as double) as added from {EXIF} e group by case_id) a on a.case_id = m.case_id) x""")
def _(measures, images):
    from ..operators import signals

    family = ["exif_metadata_missing", "exif_editing_software", "exif_date_inconsistency"]
    return rounded(evaluate.score_impact(measures, signals.exif_signals(tags(images)), family))


_SENS = [0.15, 0.18, 0.20, 0.22, 0.25, 0.28, 0.30, 0.35]


@add("k12_threshold_sensitivity", ["fx_scores"],
     " union all ".join(f"select grp, {t}::double as threshold, {R(f'count(*) filter (where prob >= {t}::double) / count(*)::double')} as rate from @fx_scores f group by grp" for t in _SENS))
def _(predictions):
    return rounded(evaluate.threshold_sensitivity(predictions, _SENS, "grp", "prob"), keep=("threshold",))


# --- L: training sets -----------------------------------------------------------------------------

_SHARES = {"src0": 0.5, "src1": 0.25, "src2": 0.25}
_NUM = lambda digest: f"cast('0x' || substring({digest}, 1, 15) as bigint)"
_DRAW = _NUM("md5('42|domain|' || draw)") + " / 1152921504606846976.0::double"


@add("l1_domain_weights", ["fx_scores"],
     f"select id, domain, {R('case domain when ' + repr('src0') + ' then 0.5 when ' + repr('src1') + ' then 0.25 when ' + repr('src2') + ' then 0.25 else 0.0 end / count(*) over (partition by domain)::double')} as weight from @fx_scores f")
def _(predictions):
    return rounded(trainset.domain_weights(predictions, _SHARES).select("id", "domain", "weight"))


@add("l1_domain_balanced_sample", ["fx_scores"],
     f"""with f as materialized (select id, domain, row_number() over (partition by domain order by md5('42|' || id), id) as pos, count(*) over (partition by domain) as n from @fx_scores f0),
 d as (select draw, case when {_DRAW} < 0.5::double then 'src0' when {_DRAW} < 0.75::double then 'src1' else 'src2' end as domain from (select unnest(range(0, (select count(*) from f))) as draw) r)
 select d.draw, f.id, f.domain from d join f on f.domain = d.domain and f.pos = {_NUM("md5('42|row|' || draw)")} % f.n + 1""")
def _(predictions):
    # a domain without rows takes no draws: the others share them as before
    shares = {name: share / 2 for name, share in _SHARES.items()} | {"absent": 0.5}
    return trainset.domain_balanced_sample(predictions, shares, predictions.count()).select("draw", "id", "domain")


@add("l2_train_val_split", ["fx_scores"],
     """select id, case when row_number() over (order by md5('42|' || id), id) <= cast(floor(0.2::double * (select count(*) from @fx_scores g)) as bigint) then 'val' else 'train' end as split from @fx_scores f""")
def _(predictions):
    return trainset.train_val_split(predictions).select("id", "split")


_IDS = "(select case c_custkey % 2 when 0 then 'FGNET:' else 'YLFW:' end || lower(c_mktsegment) || cast(c_custkey % 97 as string) as identity, 'img' || cast(c_custkey as string) as path from customer)"


def identities(customer):
    source = F.when(F.col("c_custkey") % 2 == 0, "FGNET:").otherwise("YLFW:")
    return customer.select(
        F.concat(source, F.lower("c_mktsegment"), (F.col("c_custkey") % 97).cast("string")).alias("identity"),
        F.concat(F.lit("img"), F.col("c_custkey")).alias("path"),
    )


@add("l3_identity_filter_labels", ["customer"],
     f"select identity, n as n_images, row_number() over (order by identity) - 1 as label from (select identity, count(*) as n from {_IDS} i group by identity having count(*) >= 2) x")
def _(customer):
    return trainset.identity_labels(identities(customer))


@add("l3_identity_report", ["customer"],
     f"""select split_part(identity, ':', 1) as source, count(*) filter (where n >= 3) as identities, cast(coalesce(sum(n) filter (where n >= 3), 0) as bigint) as images, count(*) filter (where n < 3) as dropped_identities,
 cast(coalesce(sum(n) filter (where n < 3), 0) as bigint) as dropped_images from (select identity, count(*) as n from {_IDS} i group by identity) x group by 1""")
def _(customer):
    return trainset.identity_report(identities(customer), min_images=3)


@add("l4_per_identity_holdout", ["customer"],
     f"""select identity, path, case when rn <= case when n > 3 then greatest(1, cast(floor(n * 0.15::double) as bigint)) else 0 end then 'val' else 'train' end as split
 from (select *, row_number() over (partition by identity order by md5('42|' || path), path) as rn, count(*) over (partition by identity) as n from {_IDS} i) x""")
def _(customer):
    return trainset.per_identity_holdout(identities(customer))


@add("l5_group_accuracy", ["fx_predictions", "documents"],
     f"""with s as (select domain, case when (prob > 0.5) = (y = 1) then 1 else 0 end as ok from @fx_predictions f)
 select d.domain, count(s.ok) as n, {R('case when count(s.ok) > 0 then sum(s.ok) / count(s.ok)::double end')} as accuracy from (select distinct source as domain from documents union all select 'never') d left join s on s.domain = d.domain group by d.domain
 union all select 'OVERALL', count(*), {R('sum(ok) / count(*)::double')} from s""")
def _(predictions, documents):
    val = predictions.withColumn("predicted", F.when(F.col("prob") > 0.5, 1).otherwise(0))
    domains = documents.select(F.col("source").alias("domain")).distinct()
    never = documents.agg(F.lit("never").alias("domain"))
    return rounded(trainset.group_accuracy(val, domains.unionByName(never)))


# One digest per draw: its first 15 digits place x, the next 15 y.
_DIGITS = lambda axis, draw, i: f"cast('0x' || substring(md5('42|' || image || '|{draw}|' || {i}), {1 if axis == 'x' else 16}, 15) as bigint)"
_AXIS = lambda axis, draw, i, span: f"{_DIGITS(axis, draw, i)} % (greatest(1, {span} - 1) + 1)"
_TRY = lambda axis, draw, i, size: f"{_DIGITS(axis, draw, i)} % {size}"
_CORNER = lambda at, size: f"greatest(0, least({size} - 64, {at} - 32))"


@add("l6_patch_manifest", ["fx_forgeries", "fx_annotations"],
     f"""with b as materialized (select r.*, f.img_w, f.img_h from ({_RESOLVED}) r join @fx_forgeries f on f.image = r.image),
 t as (select image, img_w, img_h, k, {_TRY('x', 'out', 'k', 'img_w')} as cx, {_TRY('y', 'out', 'k', 'img_h')} as cy, x, y, w, h from (select *, unnest(range(1, 11)) as k from b where resolved) q)
 select image, 1 as label, 'INSIDE' as origin, cast({_CORNER('x + ' + _AXIS('x', 'in', 'k', 'w'), 'img_w')} as bigint) as patch_x, cast({_CORNER('y + ' + _AXIS('y', 'in', 'k', 'h'), 'img_h')} as bigint) as patch_y from (select *, unnest(range(1, 5)) as k from b where resolved) i
 union all select image, 1, 'WEAK', cast({_CORNER(_AXIS('x', 'in', 'k', 'img_w'), 'img_w')} as bigint), cast({_CORNER(_AXIS('y', 'in', 'k', 'img_h'), 'img_h')} as bigint) from (select *, unnest(range(1, 5)) as k from b where not resolved) i
 union all select image, 0, 'OUTSIDE', cast({_CORNER('cx', 'img_w')} as bigint), cast({_CORNER('cy', 'img_h')} as bigint) from (select *, row_number() over (partition by image order by k) as rn from t where not (cx between x and x + w and cy between y and y + h)) o where rn <= 2""")
def _(forgeries, files):
    images = annotations.resolve_tamper_regions(forgeries, annotations.via_regions(files))
    return trainset.patch_manifest(images).select("image", "label", "origin", "patch_x", "patch_y")


# --- S: streaming -----------------------------------------------------------------------------------


def _arrivals(spark, sf_dir, table: str):
    """A given table, one file or a folder of files, as a stream: its files in the order they appear."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a stream takes a plain path for a folder; a pattern may stand for either
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _stream_watchlist(spark, sf_dir):
    out = scratch_dir(spark, "stream-watchlist")
    part = fixtures.load(spark, sf_dir, "part")
    subjects = spark.sql(fixtures.TEXTS["fx_subjects"], customer=_arrivals(spark, sf_dir, "customer"), part=part)
    query = watch_stream.stream_watchlist(subjects, fixtures.load(spark, sf_dir, "fx_watchlist"), f"{out}/hits", f"{out}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/hits").select("case_id", "entry_order", "match_field", "watchlist_id", "severity")


CATALOGUE.queries["s1_stream_watchlist"] = _stream_watchlist
CATALOGUE.oracles["s1_stream_watchlist"] = expand(f"select case_id, entry_order, match_field, watchlist_id, severity from {HITS} h")


def _audit_stream(spark, sf_dir):
    return spark.sql(fixtures.TEXTS["fx_audit"], events=_arrivals(spark, sf_dir, "events"))


def _stream_latency(spark, sf_dir):
    out = scratch_dir(spark, "stream-latency")
    # the source is bounded: a last event of no case closes the sessions of the last day
    latency.closing_event(fixtures.load(spark, sf_dir, "fx_audit")).write.parquet(f"{out}/closing")
    events = _audit_stream(spark, sf_dir)
    closing = spark.readStream.schema(events.schema).parquet(f"{out}/closing")
    steps = latency.stream_case_steps(events.unionByName(closing))
    query = (
        steps.writeStream.outputMode("append").format("parquet").option("path", f"{out}/steps")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    result = latency.latency_by_window(spark.read.schema(steps.schema).parquet(f"{out}/steps"))
    return result.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "module", "sample_count", round_exact(F.col("time_ms"), 6).alias("time_ms")
    )


CATALOGUE.queries["s2_stream_step_latency"] = _stream_latency
_STEP_ACTIONS = ["DOCUMENT_UPLOADED", "OCR_COMPLETED", "MRZ_VALIDATED", "TAMPER_ANALYSIS_COMPLETED", "FACE_VERIFIED", "RISK_CALCULATED"]
# Every step of every case, on the day on which it ended.
CATALOGUE.oracles["s2_stream_step_latency"] = expand(
    "with s as (select case_id, "
    + ", ".join(f"max(case when action = '{a}' then epoch_us(event_ts) end) as a{i}" for i, a in enumerate(_STEP_ACTIONS))
    + " from @fx_audit a group by 1) "
    + " union all ".join(
        f"select strftime(make_timestamp(a{i + 1}), '%Y-%m-%d') as day, '{label}' as module, count(*) as sample_count, {R(f'cast(sum(a{i + 1} - a{i}) as double) / count(*) / 1000.0::double', 6)} as time_ms from s where a4 is not null and a{i + 1} - a{i} >= 0 group by 1"
        for i, (_, _, label) in enumerate(fixed.LATENCY_STEPS)
    )
)


def _append(stream, out):
    """Run a bounded stream into a table and read that back."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream_completed(spark, sf_dir):
    with keyed.keyed_state(spark):
        steps = _append(keyed.stream_completed_steps(_audit_stream(spark, sf_dir)), scratch_dir(spark, "stream-steps"))
    result = latency.latency_by_window(steps)
    return result.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "module", "sample_count", round_exact(F.col("time_ms"), 6).alias("time_ms"))


CATALOGUE.queries["s2_stream_completed_steps"] = _stream_completed
CATALOGUE.oracles["s2_stream_completed_steps"] = CATALOGUE.oracles["s2_stream_step_latency"]


def _stream_sealed(spark, sf_dir):
    with keyed.keyed_state(spark):
        sealed = _append(keyed.stream_sealed_events(_audit_stream(spark, sf_dir)), scratch_dir(spark, "stream-sealed"))
    return sealed.select("seq", "chain_id", "previous_hash", "entry_hash")


CATALOGUE.queries["s3_stream_sealed_chains"] = _stream_sealed
CATALOGUE.oracles["s3_stream_sealed_chains"] = expand(SEALED)


def _stream_captures(spark, sf_dir):
    out = scratch_dir(spark, "stream-captures")
    arrivals = _arrivals(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq"), F.timestamp_seconds(F.col("vec_id") * 60).alias("event_ts"), F.col("vec_id").alias("case_id"),
        F.col("label").cast("long").alias("chain_id"), "embedding", F.lit("{}").alias("metadata"),
    )
    query = capture_stream.stream_captures(arrivals, out, f"{out}/checkpoint", threshold=0.70)
    query.awaitTermination()
    sealed = spark.read.parquet(f"{out}/ledger").drop("batch_id")
    hits = spark.read.parquet(f"{out}/hits").select("case_id", "match_case_id", "similarity")
    verdict = ledger.verify_chain(sealed).select("chain_id", "valid")
    return sealed.select("case_id", "chain_id").join(verdict, "chain_id").join(hits, "case_id", "left")


CATALOGUE.queries["s3_stream_ledger_and_gallery"] = _stream_captures
CATALOGUE.oracles["s3_stream_ledger_and_gallery"] = f"""select e.vec_id as case_id, cast(e.label as bigint) as chain_id, true as valid, b.match_case_id, b.similarity from embeddings e left join (
 select case_id, match_case_id, {py_round('s', 3)} as similarity from (select a.vec_id as case_id, g.vec_id as match_case_id, round({_SIM('a.embedding', 'g.embedding')}, 12) as s,
 row_number() over (partition by a.vec_id order by round({_SIM('a.embedding', 'g.embedding')}, 12) desc, g.vec_id) as rn from embeddings a join embeddings g on g.vec_id <> a.vec_id) z where rn = 1 and s >= 0.70::double) b on b.case_id = e.vec_id"""
