"""The numbered queries: each maps the given tables to an operator and its results back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, collocations, language, lookalikes, nearest, packing, passages, pieces, repeats, repetition, scoring, sharding, simhash
from .support import remainder

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("raw_text"), F.col("lang").alias("language"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "case_id")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_cases(_documents(spark, sf_dir), [1.0] * 8).withColumnRenamed("case_id", "doc_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(_documents(spark, sf_dir))
    return cut.select(F.col("case_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _embeddings(spark, sf_dir)
    found = nearest.nearest_faces(faces.where(F.col("case_id") % 50 == 0), faces)
    return found.select(F.col("case_id").alias("query_id"), "rank", F.col("match_case_id").alias("vec_id"), F.col("similarity").alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    rest = remainder(F.col("case_id"), 4)
    found = language.identify_language(documents, documents.where(rest != 2))
    return found.select(
        F.col("case_id").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"), "score", "nats_per_byte")


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_cases(_documents(spark, sf_dir)).withColumnRenamed("case_id", "doc_id")


def op6_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_cases(_documents(spark, sf_dir), path).withColumnRenamed("case_id", "doc_id")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_duplicate_passages(_documents(spark, sf_dir))
    return found.select(
        F.col("case_id").alias("doc_id"), "start", "end", "n_words", F.col("match_case_id").alias("match_doc_id"),
        "match_start", "match_end", "similarity")


def op8_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.near_duplicate_faces(_embeddings(spark, sf_dir), "label").withColumnRenamed("case_id", "vec_id")


def op9_partial_matching_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder(F.col("case_id"), 7)
    scored = scoring.score_cases(_documents(spark, sf_dir).withColumn("trains", rest != 2))
    return scored.select(
        F.col("case_id").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_cases(_documents(spark, sf_dir), path)
    decoded = pieces.decode_cases(encoded, path)
    return decoded.select(
        F.col("case_id").alias("doc_id"), (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("piece_ids").alias("ids_crc32"), F.crc32(F.col("raw_text").cast("binary")).alias("text_crc32"))


def op11_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_quality(_documents(spark, sf_dir))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        F.col("case_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


#: Coverage by n-grams told apart as strings, position by position.
OP11_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
positions as (
  select doc_id, len(w) as n_words, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from docs where len(w) > 0),
words as (select doc_id, i, length(word) as chars from positions),
ahead as (
  select doc_id, i, word, """ + ", ".join(f"lead(word, {k}) over follow as w{k}" for k in range(1, 10)) + r"""
  from positions window follow as (partition by doc_id order by i)),
grams as (
  """ + " union all ".join(
    f"select doc_id, {n} as n, i, concat_ws(' ', word, {', '.join(f'w{k}' for k in range(1, n))}) as gram from ahead where w{n - 1} is not null"
    for n in range(2, 11)) + r"""),
marked as (
  select doc_id, n, i, length(gram) - n + 1 as chars, count(*) over (partition by doc_id, n, gram) as copies,
         row_number() over (partition by doc_id, n, gram order by i) > 1 as later
  from grams),
spread as (
  select p.doc_id, l.n, p.i, w.chars, coalesce(m.copies, 0) > 1 as repeated, coalesce(m.later, false) as later
  from positions p cross join range(3, 11) l(n) join words w using (doc_id, i)
  left join marked m on m.doc_id = p.doc_id and m.n = l.n and m.i = p.i
  where l.n <> 4),
covered as (
  select doc_id, n, chars, """ + " ".join(
    f"{'case' if n == 3 else ''} when n = {n} then bool_or({'repeated' if n == 3 else 'later'}) over "
    f"(partition by doc_id, n order by i rows between {n - 1} preceding and current row)" for n in (3, 5, 6, 7, 8, 9, 10)
) + r""" end as inside
  from spread),
shares as (
  select doc_id, n, count(*) filter (where inside) as words_inside, coalesce(sum(chars) filter (where inside), 0) as chars_inside
  from covered group by all),
tops as (select doc_id, max(copies * chars) as most from marked where n <= 4 and copies > 1 group by doc_id),
lines as (
  select doc_id, line, row_number() over (partition by doc_id, line) > 1 as later,
         len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars
  from (select doc_id, unnest(string_split(t, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_sums as (
  select doc_id, count(*) filter (where later) as n_dup_lines, coalesce(sum(chars) filter (where later), 0) as chars
  from lines group by doc_id),
sums as (select doc_id, sum(chars) as word_chars from words group by doc_id),
judged as (
  select d.doc_id, len(d.w) as n_words, coalesce(s.word_chars, 0) as word_chars,
         len(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n_dup_lines, 0) as n_dup_lines,
         coalesce((select max(words_inside) from shares x where x.doc_id = d.doc_id and n = 3), 0) as n_repeat_words,
         coalesce((select max(chars_inside) from shares x where x.doc_id = d.doc_id and n >= 5), 0) as most_inside,
         coalesce(t.most, 0) as top, coalesce(l.chars, 0) as line_chars
  from docs d left join sums s using (doc_id) left join line_sums l using (doc_id) left join tops t using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 4 * most_inside <= word_chars
         and 10 * top <= 3 * word_chars and 4 * line_chars <= word_chars as kept
from judged
"""


def op12_dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_documents(spark, sf_dir))
    return found.select(
        F.col("language").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", F.col("occurrences").alias("a"),
        F.col("first_occurrences").alias("l"), F.col("rest_occurrences").alias("r"), F.col("n_words").alias("n"), "score")


#: Every phrase is counted, level by level in one list; products are 128-bit integers.
OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
numbered as (select lang, row_number() over () as piece_id, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
words as (select lang, piece_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from numbered where len(w) > 0),
ahead as (
  select lang, word, """ + ", ".join(f"lead(word, {k}) over follow as w{k}" for k in range(1, 5)) + r"""
  from words window follow as (partition by piece_id order by i)),
counted as (
  """ + " union all ".join(
    f"select lang, {n} as k, concat_ws(' ', word{''.join(f', w{k}' for k in range(1, n))}) as phrase, count(*)::hugeint as f "
    f"from ahead {f'where w{n - 1} is not null' if n > 1 else ''} group by all" for n in range(1, 6)) + r"""),
totals as (select lang, sum(f) as n from counted where k = 1 group by lang),
candidates as (select * from counted where k > 1 and f >= 100),
cuts as (
  select lang, phrase, k, f, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from candidates),
scored as (
  select c.lang, c.phrase, c.f, c.cut, l.f as l, r.f as r, t.n, (1000 * c.f * t.n) // (l.f * r.f) as score
  from cuts c join totals t using (lang)
  join counted l on l.lang = c.lang and l.k = c.cut and l.phrase = array_to_string(c.w[1:c.cut], ' ')
  join counted r on r.lang = c.lang and r.k = c.k - c.cut and r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
free as (
  select * from lowest a where not exists (
    select 1 from candidates b where b.lang = a.lang and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')
    and b.phrase <> a.phrase and 100 * b.f >= 100 * a.f)),
ranked as (select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from free)
select lang, rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000
"""


def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_cases(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("case_id", "doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_rendezvous_shards, op2_suffix_array_dedup, op3_adaptive_scan, op4_language_id, op5_covering_simhash,
        op6_configuration_packing, op7_compact_windows, op8_projection_collisions, op9_partial_matching_score,
        op10_suffix_array_pieces, op11_repetition_coverage, op12_dynamic_collocations, op13_fragment_alignment,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op11_repetition_coverage": OP11_SQL, "op12_dynamic_collocations": OP12_SQL}
