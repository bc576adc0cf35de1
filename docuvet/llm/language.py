"""Language of case texts by code length under per-language byte context trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ppm
from .support import forget, text_rows, tidy

UNDETERMINED = "und"
#: Expected number of training texts taken of each language, chosen by a hash of their key.
SAMPLE_TEXTS = 2_000
#: Contexts of each length that a language keeps, the most frequent first.
MAX_CONTEXTS = 8_192


def learn(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, order: int = ppm.ORDER, max_contexts: int = MAX_CONTEXTS):
    """Frozen models of each language in ``labelled`` (case_id, raw_text, language): names and one joint table.

    About ``sample_texts`` texts of each language are counted, in parallel; only the
    counts of context bytes, whose number that bound and the byte alphabet limit, reach
    the driver. Languages come in name order. Null texts and languages teach nothing.
    """
    usable = labelled.where("language is not null and raw_text is not null")
    # one row per language comes to the driver
    sizes = {r["language"]: r["n"] for r in usable.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.pmod(F.xxhash64("case_id", "raw_text"), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, sample_texts / n)]) if sizes else None
    chosen = usable.where(part < shares[F.col("language")] if sizes else F.lit(False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, list] = {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("raw_text").to_pylist()):
                by_language.setdefault(language, []).append(text.encode())
        for language, texts in by_language.items():
            codes, counts = ppm.gram_counts((texts[i:i + 256] for i in range(0, len(texts), 256)), order)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
                ["language", "code", "n"])

    grams = (
        chosen.select("language", "raw_text").mapInArrow(tidy(count), "language string, code long, n long")
        .groupBy("language", "code").agg(F.sum("n").alias("n")).toPandas()
    )
    names = sorted(grams["language"].unique())
    seen = np.unique(np.append(grams["code"].to_numpy(np.int64) & 255, ppm.END)) if names else np.array([ppm.END])
    models = []
    for name in names:
        own = grams[grams["language"] == name].sort_values("code")
        levels = ppm.levels_of(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.float64), order, max_contexts)
        models.append(ppm.freeze(levels, seen, order))
    return names, ppm.combined(models) if models else None


def identify_language(cases: DataFrame, labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, keep: Sequence[str] = ()) -> DataFrame:
    """The language of each document analysis, from the whole of its OCR text.

    ``cases``: case_id, raw_text; of its other columns those named in ``keep`` are
    carried along under their names with ``kept_`` before them, the rest is ignored.
    ``labelled``: case_id, raw_text, language. Output, one row per input row: case_id,
    language, score (the language's posterior under equal priors, 0 to 1) and
    nats_per_byte (its code length by byte, end included). A null text, a text without a
    letter, or an empty training table gives ``und`` with score 0 and null
    nats_per_byte. Equal code lengths go to the first language by name. Repeated rows
    stay; an empty table gives an empty result.
    """
    names, model = learn(labelled, sample_texts)
    shared = cases.sparkSession.sparkContext.broadcast((names, model))
    rows = cases.select(
        F.col("case_id").cast("long").alias("case_id"), *[F.col(c).alias(f"kept_{c}") for c in keep if c != "raw_text"],
        F.coalesce(F.col("raw_text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.col("raw_text").cast("string").alias("raw_text"),
    )
    # the text itself crosses to the tasks once, kept or not
    carried = {c: c for c in rows.columns[:-2]} | ({"kept_raw_text": "raw_text"} if "raw_text" in keep else {})
    shape = ", ".join(f"`{name}` {rows.schema[source].dataType.simpleString()}" for name, source in carried.items())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            names, model = shared.value
            for batch in batches:
                lettered = np.asarray(batch.column("lettered"))
                known = lettered & (model is not None)
                best, score, rate = np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known))
                at = 0
                for keys, texts in text_rows(iter([batch]), "case_id", "raw_text") if model is not None else ():
                    nats = ppm.code_lengths(model, texts)
                    some = slice(at, at + len(keys))
                    best[some], least = nats.argmin(axis=1), nats.min(axis=1)
                    score[some] = 1.0 / np.exp(least[:, None] - nats).sum(axis=1)
                    rate[some] = least / np.array([len(t) + 1 for t in texts])
                    at += len(keys)
                columns = {name: batch.column(source) for name, source in carried.items()}
                columns["language"] = pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string())
                columns["score"] = pa.array(np.where(known, score, 0.0))
                columns["nats_per_byte"] = pa.array(rate, mask=~known)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        finally:  # idle workers must not hold the model while other stages run
            names = model = None
            forget(shared)

    return rows.mapInArrow(tidy(predict), f"{shape}, language string, score double, nats_per_byte double")
