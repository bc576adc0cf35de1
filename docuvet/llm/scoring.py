"""Language-model scores of case texts: byte-level partial matching beside a word unigram base."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import ppm
from .support import mix, ragged, shuffle_partitions, text_rows, tidy

#: Text bytes whose tokens share one dictionary.
BATCH_BYTES = 8 << 20
#: Bytes of context.
ORDER = 5
#: Lengths of context whose counts every task holds; the byte alphabet bounds them.
LOW = 2

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _plain(text: bytes) -> bytes:
    """The words in lower case (A-Z), one space between them: what both models are about."""
    return b" ".join(_WORDS.findall(text.lower()))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _grams(texts: list[bytes], order: int) -> np.ndarray:
    """The code of each coded symbol behind its ``order`` bytes of context, text after text."""
    data, starts, sizes = ppm.stream(texts, order)
    code = np.zeros(len(data) - order, np.int64)
    for back in range(order, -1, -1):
        code = (code << 8) | data[order - back:len(data) - back]
    return code[ragged(starts - order, sizes)]


def _gram_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three bytes of context: what shares the longer contexts' suffixes meets there."""
    return (mix(((codes >> 8) & 0xFFFFFF).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _found(names: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(asked))
    spot = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[spot] == asked, values[spot], 0.0)


def _levels(codes: np.ndarray, counts: np.ndarray, lengths: range, below: list) -> list[tuple]:
    """Of each length: codes and counts; contexts, their counts, symbols, and what these count in the next shorter context."""
    levels = list(below)
    for length in lengths:
        low, at = np.unique(codes % (1 << 8 * (length + 1)), return_inverse=True)
        n = np.bincount(at, counts, len(low))
        contexts, of = np.unique(low >> 8, return_inverse=True)
        shorter = _found(*levels[length - 1][:2], low % (1 << 8 * length)) if length else np.zeros(len(low))
        size = len(contexts)
        levels.append((low, n, contexts, np.bincount(of, n, size), np.bincount(of, minlength=size).astype(float), np.bincount(of, shorter, size)))
    return levels


def _gram_costs(asked: np.ndarray, levels: list[tuple]) -> np.ndarray:
    """Nats of each (context, symbol): escape method C, excluding what longer contexts have judged."""
    n, d = levels[0][1].sum(), len(levels[0][0])
    left = 256 - d
    out = d if left else 0
    held = _found(*levels[0][:2], asked & 255)
    escape = np.full(len(asked), 1.0 / max(1, left))
    chance = np.where(held > 0, held / max(1, n + out), out / (n + out) * escape if n else escape)
    n_before, d_before = np.full(len(asked), float(n)), np.full(len(asked), float(d))
    for length, (codes, counts, contexts, total, kinds, excluded) in enumerate(levels[1:], 1):
        context = (asked >> 8) % (1 << 8 * length)
        here = _found(codes, counts, asked % (1 << 8 * (length + 1)))
        n, d = _found(contexts, total, context), _found(contexts, kinds, context)
        n2, d2 = n_before - _found(contexts, excluded, context), d_before - d
        share = np.divide(d2, n2 + d2, out=np.ones_like(n2), where=n2 > 0)
        shorter = np.where(held > 0, held / np.maximum(n2 + d2, 1), escape * share)
        seen = n > 0
        whole = np.maximum(n + d, 1)
        chance = np.where(seen, np.where(here > 0, here / whole, d / whole * shorter), chance)
        held, escape, n_before, d_before = here, shorter, n, d
    return -np.log(np.maximum(chance, 1e-300))


def _bucket_costs(table: pa.Table, low: list, order: int) -> pa.Table:
    """The grams of one bucket, over all batches, to what each costs."""
    codes = [_unpack(x, np.int64) for x in table.column("codes").to_pylist()]
    counts = np.concatenate([_unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    names, at = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(at, counts, len(names))
    levels = _levels(names[n > 0], n[n > 0], range(len(low), order + 1), low)
    costs = _gram_costs(names, levels).astype(np.float32)[at]
    cuts = np.cumsum([len(c) for c in codes])[:-1]
    return pa.table({
        "batch": table.column("batch"), "bucket": table.column("bucket"),
        "counts": pa.array([_pack(c) for c in np.split(costs, cuts)], pa.binary())})


def _read(batches: Iterator[pa.RecordBatch], buckets: int, order_: int) -> Iterator[pa.RecordBatch]:
    """Texts to batches: a dictionary sorted by bucket, each token as a place in it, and the grams' counts."""

    class Places(dict):
        def __missing__(self, word):
            place = self[word] = len(self)
            return place

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    serial = 0
    places, tokens, sizes, keys, trains, grams, held = Places(), [], [], [], [], [], 0

    def flush():
        nonlocal places, tokens, sizes, keys, trains, grams, held, serial
        words = list(places)
        ids = np.array(tokens, np.int64)
        sizes_ = np.array(sizes, np.int64)
        learns = np.repeat(np.array(trains, bool), sizes_)
        bucket = np.fromiter((_bucket(w, buckets) for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        ids = place[ids]
        word_counts = np.bincount(ids[learns], minlength=len(words))
        codes, counts = ppm.merged(grams)
        home = _gram_bucket(codes, buckets)
        by_home = np.argsort(home, kind="stable")
        row = {
            "grams": _pack(codes[by_home]), "gram_counts": _pack(counts[by_home]), "gram_buckets": _pack(home[by_home].astype(np.int32)),
            "batch": (part << 32) + serial, "case_ids": keys, "trains": trains, "sizes": sizes,
            "words": zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[i] for i in order)), "n_words": len(words),
            "counts": _pack(word_counts.astype(np.int64)), "tokens": _pack(ids.astype(np.int32)),
            "buckets": _pack(bucket[order].astype(np.int32)),
        }
        serial += 1
        places, tokens, sizes, keys, trains, grams, held = Places(), [], [], [], [], [], 0
        return pa.RecordBatch.from_pylist([row], schema=_BATCH)

    for rows, texts in text_rows(batches, "row", "raw_text"):
        texts = [_plain(t) for t in texts]
        for learns in (True, False):
            if own := [t for t, row in zip(texts, rows) if row["trains"] == learns]:
                codes, counts = np.unique(_grams(own, order_), return_counts=True)
                grams.append((codes, counts if learns else np.zeros_like(counts)))
        for row, text in zip(rows, texts):
            words = text.split(b" ") if text else []
            tokens += map(places.__getitem__, words)
            sizes.append(len(words))
            keys.append(row["case_id"])
            trains.append(row["trains"])
            held += len(text)
        if held >= BATCH_BYTES:
            yield flush()
    if keys:
        yield flush()


_BATCH = pa.schema([
    ("batch", pa.int64()), ("case_ids", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())),
    ("sizes", pa.list_(pa.int64())), ("grams", pa.binary()), ("gram_counts", pa.binary()), ("gram_buckets", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()),
    ("counts", pa.binary()), ("tokens", pa.binary()), ("buckets", pa.binary()),
])
_BATCH_SHAPE = (
    "batch long, case_ids array<long>, trains array<boolean>, sizes array<long>, grams binary, gram_counts binary, gram_buckets binary, words binary, "
    "n_words long, counts binary, tokens binary, buckets binary"
)


def _bucket(word: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(word) % buckets


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's dictionary as one row per bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            if not row["n_words"]:
                continue
            words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
            counts, bucket = _unpack(row["counts"], np.int64), _unpack(row["buckets"], np.int32)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[starts].astype(np.int64)), pa.array(np.full(len(starts), row["batch"])),
                pa.array([zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[a:b])) for a, b in zip(starts, ends)], pa.binary()),
                pa.array([_pack(counts[a:b]) for a, b in zip(starts, ends)], pa.binary()),
            ], ["bucket", "batch", "words", "counts"])


def _split_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's grams as one row per bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, counts, bucket = (_unpack(row[c], k) for c, k in (("grams", np.int64), ("gram_counts", np.int64), ("gram_buckets", np.int32)))
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            firsts = np.concatenate(([0], cuts))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[firsts].astype(np.int64)), pa.array(np.full(len(firsts), row["batch"])),
                pa.array([_pack(c) for c in np.split(codes, cuts)], pa.binary()),
                pa.array([_pack(c) for c in np.split(counts, cuts)], pa.binary()),
            ], ["bucket", "batch", "codes", "counts"])


def _low_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of the symbols behind their last ``LOW`` bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, at = np.unique(_unpack(row["grams"], np.int64) % (1 << 8 * (LOW + 1)), return_inverse=True)
            n = np.bincount(at, _unpack(row["gram_counts"], np.int64), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[n > 0]), pa.array(n[n > 0])], ["code", "n"])


def _total(table: pa.Table) -> pa.Table:
    """Rows of one bucket to the corpus counts of each row's words; row -1 has the bucket's N and V."""
    totals: dict[bytes, int] = {}
    read = []
    for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
        words = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
        read.append(words)
        for word, count in zip(words, _unpack(counts, np.int64).tolist()):
            totals[word] = totals.get(word, 0) + count
    blobs = [_pack(np.fromiter(map(totals.__getitem__, words), np.int64, len(words))) for words in read]
    bucket = table.column("bucket")[0].as_py()
    known = [sum(totals.values()), sum(1 for n in totals.values() if n)]
    return pa.table({
        "batch": pa.array([*table.column("batch").to_pylist(), -1], pa.int64()),
        "bucket": pa.array([bucket] * (len(blobs) + 1), pa.int64()),
        "counts": pa.array([*blobs, b""], pa.binary()),
        "n": pa.array([0] * len(blobs) + known[:1], pa.int64()), "v": pa.array([0] * len(blobs) + known[1:], pa.int64()),
    })


def score_cases(cases: DataFrame, order: int = ORDER) -> DataFrame:
    """Log probability of each text under a byte model of the training texts, and under a word unigram.

    ``cases``: case_id, raw_text, trains (whether the model may learn from the row; null:
    no); other columns are ignored. A null text is empty. Both models score the words,
    lower-cased (A-Z) and cut at ASCII white space, and the end; the byte model sees one
    space between words.
    The byte model is prediction by partial matching with escape method C and symbol
    exclusion, its counts frozen after all training texts. The base counts words cut at
    ASCII white space and one end per text, with one added to each count. Output, one
    row per input row: case_id, n_tokens (words and the end), n_known (tokens met in
    training), train_tokens, base_score and score (both log10, the end included).
    Repeated rows stay; an empty table gives an empty result, and without training
    texts every byte costs one of 256.

    Texts are read in batches with a dictionary each; only dictionaries are exchanged,
    one packed row per batch and bucket, so a frequent word is one entry per batch. So
    are the batch's grams of context and symbol: all counts stay in their buckets, where
    each gram gets its cost; only those of contexts of ``LOW`` bytes reach the driver.
    """
    spark = cases.sparkSession
    buckets = 2 * shuffle_partitions(cases)
    rows = cases.select(
        F.col("case_id").cast("long").alias("case_id"), F.col("raw_text").cast("string").alias("raw_text"),
        F.coalesce(F.col("trains"), F.lit(False)).alias("trains"))
    read = rows.select(F.struct("case_id", "trains").alias("row"), "raw_text").mapInArrow(
        tidy(lambda batches: _read(batches, buckets, order)), _BATCH_SHAPE)
    read = materialize(read, "text-batches")
    got = read.select("grams", "gram_counts").mapInArrow(tidy(_low_grams), "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast(_levels(
        got.column("code").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.float64), range(LOW + 1), []))
    priced = (
        read.select("batch", "grams", "gram_counts", "gram_buckets")
        .mapInArrow(tidy(_split_grams), "bucket long, batch long, codes binary, counts binary")
        .groupBy("bucket").applyInArrow(tidy(lambda t: _bucket_costs(t, low.value, order)), "batch long, bucket long, counts binary")
    )
    counted = (
        read.select("batch", "words", "n_words", "counts", "buckets")
        .mapInArrow(tidy(_split), "bucket long, batch long, words binary, counts binary")
        .groupBy("bucket").applyInArrow(tidy(_total), "batch long, bucket long, counts binary, n long, v long")
    )
    counted = materialize(counted, "word-counts")
    sums = counted.where("batch = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.where("trains").count()
    n, v = sums[0] + ends, sums[1] + (ends > 0)

    def score(batch: pa.Table, found: pa.Table) -> pa.Table:
        row = batch.to_pylist()[0]
        parts = list(zip(found.column("priced").to_pylist(), found.column("bucket").to_pylist(), found.column("counts").to_pylist()))
        blobs = sorted((b, blob) for priced, b, blob in parts if not priced)
        costs = np.concatenate([_unpack(x[2], np.float32) for x in sorted(p for p in parts if p[0])])
        codes = _unpack(row["grams"], np.int64)
        by_code = np.argsort(codes)
        codes, costs = codes[by_code], costs[by_code].astype(np.float64)
        counts = np.concatenate([_unpack(b, np.int64) for _, b in blobs] or [np.zeros(0, np.int64)])
        sizes = np.array(row["sizes"], np.int64)
        tokens = _unpack(row["tokens"], np.int32)
        each = counts[tokens]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        known = np.concatenate(([0], np.cumsum(each > 0)))
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
        scores = []
        for at in range(0, len(sizes), 256):
            texts = [b" ".join([words[t] for t in tokens[a:b].tolist()]) for a, b in zip(bounds[at:at + 256], bounds[at + 1:at + 257])]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            nats = costs[np.searchsorted(codes, _grams(texts, order))]
            scores.append(np.add.reduceat(nats, np.cumsum(lengths) - lengths) / -np.log(10.0))
        end_known = int(ends > 0)
        base = np.array([np.log10(each[a:b] + 1.0).sum() for a, b in zip(bounds[:-1], bounds[1:])])
        return pa.table({
            "case_id": pa.array(row["case_ids"], pa.int64()), "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(known[bounds[1:]] - known[bounds[:-1]] + end_known),
            "train_tokens": pa.array(np.full(len(sizes), n, np.int64)),
            "base_score": pa.array(base + np.log10(ends + 1.0) - (sizes + 1) * np.log10(n + v + 1.0)),
            "score": pa.array(np.concatenate(scores), pa.float64()),
        })

    per_batch = counted.where("batch >= 0").select(F.col("batch").alias("of"), F.lit(False).alias("priced"), "bucket", "counts").unionByName(
        priced.select(F.col("batch").alias("of"), F.lit(True).alias("priced"), "bucket", "counts"))
    return read.groupBy("batch").cogroup(per_batch.groupBy("of")).applyInArrow(
        score, "case_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
