"""Quality rules on repetition: characters of case texts inside repeated word sequences and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .support import groups, mix, text_rows, tidy

#: Largest share of a text's word characters inside later occurrences of its own n-grams, by n. A letterhead that
#: a short page prints twice stays below; boilerplate loops and copied paragraphs lie far above.
DUPLICATED_LIMITS = dict.fromkeys(range(5, 11), 0.25)
#: Largest share inside all occurrences of the repeated n-gram that takes most characters, by n.
TOP_LIMITS = dict.fromkeys(range(2, 5), 0.30)
#: Largest share inside lines that repeat an earlier line.
LINE_LIMIT = 0.25
#: The length whose repeated windows are counted in words, first occurrence included.
WINDOW = 3

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_SLICE = 1 << 20


def _word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words, slice by slice, so that a long text never is one list of words."""
    parts, start = [], 0
    while start < len(text):
        end = min(start + _SLICE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[start:end].split()], np.int64))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    if b"\n" not in text:
        return 0, 0
    seen: set[bytes] = set()
    lines = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
            chars += sum(len(w.decode()) for w in line.split())
        elif line.strip():
            seen.add(line)
    return lines, chars


def _equal_windows(ids: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start positions sorted so that equal windows of one text are neighbours, and the runs' first places and lengths.

    Windows are told apart by a rolling hash over word numbers; neighbours with equal
    hashes are compared word by word, and a collision hashes all anew with another seed.
    """
    seed = 0
    while True:
        spread = mix(ids.astype(np.uint64), seed)
        rolled = mix(doc[starts].astype(np.uint64), seed + 1)
        for j in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + spread[starts + j]
        order = np.argsort(rolled, kind="stable")
        placed, value = starts[order], rolled[order]
        p, q = placed[:-1], placed[1:]
        alike = value[:-1] == value[1:]
        p, q = p[alike], q[alike]
        if (doc[p] == doc[q]).all() and all((ids[p + j] == ids[q + j]).all() for j in range(n)):
            return (placed, *groups(value))
        seed += 2


def _inside(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[bytes], duplicated: list[int], top: list[int]) -> dict[str, np.ndarray]:
    """Counts of each text: words, word characters, symbols, repeated lines and characters inside repeated n-grams."""
    known: dict[bytes, int] = {}
    each = [_word_ids(t, known) for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    ids = np.concatenate(each) if each else np.zeros(0, np.int64)
    lengths = np.array([len(w.decode()) for w in known], np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    lines = [_repeated_lines(t) for t in texts]

    def total(weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(weights)])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return sums[edge[1:]] - sums[edge[:-1]]

    out = {
        "n_words": sizes,
        "word_chars": total(lengths),
        "n_symbols": np.array([int(_SYMBOLS[np.frombuffer(t, np.uint8)].sum()) for t in texts], np.int64),
        "n_dup_lines": np.array([x for x, _ in lines], np.int64),
        "dup_line_chars": np.array([x for _, x in lines], np.int64),
    }
    # a window repeats only if both shorter windows inside it do
    alive = np.ones(len(ids) + 1, bool)
    alive[-1] = False
    for n in range(1, max([WINDOW, *duplicated, *top]) + 1):
        where = np.arange(len(ids))
        starts = where[(where + n <= ends) & alive[:-1] & (alive[1:] if n > 1 else True)]
        placed, first, runs = _equal_windows(ids, doc, starts, n)
        often = np.repeat(runs > 1, runs)
        repeated = placed[often]
        later = np.ones(len(placed), bool)
        later[first] = False
        if n == WINDOW:
            out["n_repeat_words"] = total(_inside(repeated, n, len(ids)).astype(np.int64))
        if n in duplicated:
            out[f"dup_{n}_chars"] = total(lengths * _inside(placed[later], n, len(ids)))
        if n in top:
            most = np.zeros(len(texts), np.int64)
            lead, count = placed[first[runs > 1]], runs[runs > 1]
            np.maximum.at(most, doc[lead], count * (upto[lead + n] - upto[lead]))
            out[f"top_{n}_chars"] = most
        alive = np.zeros(len(ids) + 1, bool)
        alive[repeated] = True
    return out


def repetition_quality(
    cases: DataFrame, duplicated_limits: dict[int, float] | None = None, top_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """How much of each case's extracted text repeats itself, and whether it is good enough to learn from.

    ``cases``: case_id, raw_text; other columns are ignored, whatever their names. A
    word is a run of anything but ASCII white space; shares are of the characters (code
    points) in words. Output, one row per input row:

    * n_words, word_chars, n_symbols (characters of ``#*$%&|<>``)
    * n_dup_lines, dup_line_chars: lines with a word that equal an earlier line, and the word characters in them
    * n_repeat_words: words inside windows of three words that occur twice or more, the first included
    * dup_<n>_chars: characters inside n-grams that occurred before in the text, overlaps once
    * top_<n>_chars: occurrences times characters of the repeated n-gram for which that is largest
    * failed: names of the measures whose share exceeds its limit, in this order
    * kept: nothing failed

    A null or empty text, or one without a word, has zeros and is kept: rules on length
    are the caller's. Repeated rows are rows of their own; a null case_id stays null; an
    empty table gives an empty result. Nothing is shuffled. Memory follows the longest
    single text, about 100 bytes for each of its words.
    """
    duplicated_limits = DUPLICATED_LIMITS if duplicated_limits is None else duplicated_limits
    top_limits = TOP_LIMITS if top_limits is None else top_limits
    duplicated, top = sorted(duplicated_limits), sorted(top_limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words",
              *(f"dup_{n}_chars" for n in duplicated), *(f"top_{n}_chars" for n in top)]
    key_type = cases.schema["case_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("case_id").type
            for keys, texts in text_rows([batch], "case_id", "raw_text"):
                found = measure(texts, duplicated, top)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(found[c]) for c in counts)], ["case_id", *counts])

    measured = cases.select("case_id", F.col("raw_text").cast("string").alias("raw_text")).mapInArrow(
        tidy(work), f"case_id {key_type}, " + ", ".join(f"{c} long" for c in counts))
    limits = {"dup_line_chars": line_limit} | {f"dup_{n}_chars": duplicated_limits[n] for n in duplicated} | {
        f"top_{n}_chars": top_limits[n] for n in top}
    failed = F.filter(
        F.array(*[F.when(F.col(name) > limit * F.col("word_chars"), F.lit(name)) for name, limit in limits.items()]),
        lambda name: name.isNotNull())
    return measured.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
