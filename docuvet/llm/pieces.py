"""SentencePiece encoding of case texts by suffix-array matching of the vocabulary, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import suffix_order
from .support import ragged, text_rows, tidy

#: SentencePiece's mark for a space.
MARK = "▁"
#: Units of more characters are merged one at a time with a heap.
LONG = 48
CHUNK_BYTES = 2 << 20
#: Distinct units whose ids a worker remembers at once.
REMEMBERED = 350_000

_SEPARATOR = 0xFF


class Vocabulary:
    """The pieces of a BPE model with byte fallback: bytes, scores and the ids of single bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_ids = np.full(256, model.unk_id(), np.uint32)
        self.written = [b""] * len(names)
        matched = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.written[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                matched.append(i)
                self.written[i] = name.replace(MARK, " ").encode()
        self.ids = np.array(matched, np.int64)
        self.names = [names[i].encode() for i in matched]
        self.scores = np.array([model.get_score(i) for i in matched])
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        if self.lengths.max() > 63:
            raise ValueError("pieces of more than 63 bytes are not supported")
        # inner marks would join what spaces separate
        multi = [names[i] for i in matched if len(names[i]) > 1]
        if any(MARK in n.lstrip(MARK) for n in multi):
            raise ValueError("pieces with a space inside are not supported")
        self.unit = re.compile(" *[^ \n]+| +|\n" if not any("\n" in n for n in multi) else " *[^ ]+| +")
        width = -(-int(self.lengths.max()) // 8)
        padded = np.zeros((len(self.names), 8 * width), np.uint8)
        for row, name in enumerate(self.names):
            padded[row, :len(name)] = np.frombuffer(name, np.uint8)
        self.words = padded.view(">u8").astype(np.uint64)


def occurrences(data: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All places of all pieces in ``data``: positions and piece rows, sorted by position, then length.

    Each piece's suffixes are one range of the suffix array; both its ends are found by
    binary search, eight bytes at a time.
    """
    n = len(data)
    order, _ = suffix_order(data, int(vocabulary.lengths.max()))
    padded = np.concatenate([data, np.zeros(64, np.uint8)]).astype(np.uint64)
    eight = np.zeros(n + 56, np.uint64)
    for at in range(8):
        eight = (eight << np.uint64(8)) | padded[at:at + n + 56]
    first = eight[order]
    lengths, words = vocabulary.lengths, vocabulary.words
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)

    def rest(word: int) -> np.ndarray:
        """Ones where a piece leaves the bytes of this word open."""
        have = np.clip(lengths - 8 * word, 0, 8)
        return np.where(have < 8, ones >> (8 * np.minimum(have, 7)).astype(np.uint64), np.uint64(0))

    low = np.searchsorted(first, words[:, 0], side="left")
    high = np.searchsorted(first, words[:, 0] | rest(0), side="right")
    for word in range(1, words.shape[1]):
        longer = np.flatnonzero((lengths > 8 * word) & (low < high))
        if not len(longer):
            break
        for target, after, bound in ((words[longer, word], False, low), (words[longer, word] | rest(word)[longer], True, high)):
            a, b = low[longer].copy(), high[longer].copy()
            while (a < b).any():
                middle = (a + b) // 2
                value = eight[order[np.minimum(middle, n - 1)] + 8 * word]
                less = (value <= target) if after else (value < target)
                open_ = a < b
                a = np.where(open_ & less, middle + 1, a)
                b = np.where(open_ & ~less, middle, b)
            if after:
                high[longer] = a
            else:
                kept = a
        low[longer] = kept
    counts = np.maximum(high - low, 0)
    position = order[ragged(low, counts)]
    piece = np.repeat(np.arange(len(lengths)), counts)
    by = np.argsort(position * 64 + lengths[piece])
    return position[by], piece[by]


class Edges:
    """Occurrences by position and length."""

    def __init__(self, data: np.ndarray, vocabulary: Vocabulary):
        position, self.piece = occurrences(data, vocabulary)
        starts = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1]))) if len(position) else np.zeros(0, np.int64)
        self.lengths = np.zeros(len(data) + 1, np.uint64)
        self.base = np.zeros(len(data) + 1, np.int64)
        if len(position):
            bits = np.uint64(1) << vocabulary.lengths[self.piece].astype(np.uint64)
            self.lengths[position[starts]] = np.bitwise_or.reduceat(bits, starts)
            self.base[position[starts]] = starts
        self.scores = vocabulary.scores

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece row of each span, or -1."""
        mask = self.lengths[start]
        bit = np.uint64(1) << np.minimum(length, 63).astype(np.uint64)
        there = (mask & bit) != 0
        at = self.base[start] + np.bitwise_count(mask & (bit - np.uint64(1)))
        return np.where(there & (length < 64), self.piece[np.where(there, at, 0)] if len(self.piece) else -1, -1)

    def score(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        row = self.find(start, length)
        return np.where(row >= 0, self.scores[row], -np.inf)


def _relax(edges: Edges, bounds: np.ndarray) -> np.ndarray:
    """Merge until no edge spans two neighbours: best score first, then leftmost.

    ``bounds``: one row per unit, the character boundaries; rows keep their end in the
    unused columns on the right.
    """
    bounds = bounds.copy()
    if bounds.shape[1] < 3:
        return bounds
    scores = edges.score(bounds[:, :-2].ravel(), (bounds[:, 2:] - bounds[:, :-2]).ravel()).reshape(len(bounds), -1)
    rows = np.arange(len(bounds))
    column = np.arange(bounds.shape[1])
    while len(rows):
        best = scores[rows].argmax(axis=1)
        alive = scores[rows, best] > -np.inf
        rows, best = rows[alive], best[alive]
        if not len(rows):
            break
        take = np.minimum(column + (column[None, :] > best[:, None]), column[-1])
        own = np.take_along_axis(bounds[rows], take, axis=1)
        bounds[rows] = own
        shifted = np.take_along_axis(scores[rows], np.minimum(take[:, :-2], scores.shape[1] - 1), axis=1)
        shifted[:, -1] = np.where(take[:, scores.shape[1] - 1] > scores.shape[1] - 1, -np.inf, shifted[:, -1])
        for at in (best - 1, best):
            good = (at >= 0) & (at < scores.shape[1])
            left = own[np.flatnonzero(good), at[good]]
            middle, right = own[np.flatnonzero(good), at[good] + 1], own[np.flatnonzero(good), at[good] + 2]
            shifted[np.flatnonzero(good), at[good]] = np.where(
                right > middle, edges.score(left, right - left), -np.inf)
        scores[rows] = shifted
    return bounds


def _relax_long(edges: Edges, bounds: np.ndarray) -> np.ndarray:
    """The same for one unit of any length, with a heap."""
    n = len(bounds) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ends = bounds[1:].tolist()
    begin = bounds[:-1].tolist()
    first = edges.score(bounds[:-2], bounds[2:] - bounds[:-2]) if n > 1 else np.zeros(0)
    heap = [(-s, i, ends[i + 1]) for i, s in enumerate(first.tolist()) if s > -np.inf]
    heapq.heapify(heap)
    dead = [False] * n
    while heap:
        _, left, end = heapq.heappop(heap)
        right = after[left] if not dead[left] else n
        if right >= n or ends[right] != end:
            continue
        dead[right] = True
        ends[left], after[left] = end, after[right]
        if after[left] < n:
            before[after[left]] = left
        for a in (before[left], left):
            b = after[a] if a >= 0 else n
            if b < n:
                s = float(edges.score(np.array([begin[a]]), np.array([ends[b] - begin[a]]))[0])
                if s > -np.inf:
                    heapq.heappush(heap, (-s, a, ends[b]))
    kept = [i for i in range(n) if not dead[i]]
    return np.array([begin[i] for i in kept] + [int(bounds[-1])])


class Encoder:
    """Piece ids of whole texts through the ids of their distinct units (spaces and what follows them)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this process: tasks that a worker runs one after another share what was learnt."""
        import sentencepiece

        kept = sentencepiece.__dict__.setdefault("_encoders_by_path", {})
        if path not in kept:
            kept[path] = cls(Vocabulary(path))
        return kept[path]

    def learn(self, units: list[str]) -> None:
        """Index the new units as one text, match every piece, and relax the edges of each unit."""
        raw = [u.replace(" ", MARK).encode() for u in units]
        data = np.frombuffer(bytes([_SEPARATOR]).join(raw) + bytes([_SEPARATOR]), np.uint8)
        edges = Edges(data, self.vocabulary)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes + 1) - sizes - 1
        character = np.flatnonzero((data & 0xC0) != 0x80)  # where characters and separators begin
        at = np.searchsorted(character, starts)
        count = np.searchsorted(character, starts + sizes) - at
        for n in np.unique(count):
            members = np.flatnonzero(count == n)
            bounds = character[at[members][:, None] + np.arange(n + 1)]
            if n <= LONG:
                rows = _relax(edges, bounds)
                low, high = rows[:, :-1].ravel(), rows[:, 1:].ravel()
                owner = np.repeat(members, n)
            else:
                merged = [_relax_long(edges, b) for b in bounds]
                low = np.concatenate([m[:-1] for m in merged])
                high = np.concatenate([m[1:] for m in merged])
                owner = np.repeat(members, [len(m) - 1 for m in merged])
            real = high > low
            low, high, owner = low[real], high[real], owner[real]
            row = edges.find(low, high - low)
            width = np.where(row >= 0, 1, high - low)
            ids = np.repeat(np.where(row >= 0, self.vocabulary.ids[row], 0).astype(np.uint32), width)
            spelled = np.repeat(row < 0, width)
            ids[spelled] = self.vocabulary.byte_ids[data[ragged(low[row < 0], width[row < 0])]]
            packed = ids.tobytes()
            stops = 4 * np.cumsum(np.bincount(np.searchsorted(members, owner), width, len(members)).astype(np.int64))
            stops = stops.tolist()
            self.known.update(zip((units[m] for m in members.tolist()), map(packed.__getitem__, map(slice, [0, *stops[:-1]], stops))))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        find = self.vocabulary.unit.findall
        split = [find(" " + t.decode().replace(MARK, " ")) if t else [] for t in texts]
        new: set[str] = set()
        for units in split:
            new.update(units)
        new.difference_update(self.known)
        if new:
            self.learn(list(new))
        look = self.known.__getitem__
        return [b"".join(map(look, units)) for units in split]


def encode_cases(cases: DataFrame, model_path: str) -> DataFrame:
    """Piece ids of document analyses, as the SentencePiece BPE model at ``model_path`` gives them.

    ``cases``: case_id, raw_text (null: empty); other columns are ignored. The model's
    file must be readable on executors. Output, one row per input row: case_id and
    piece_ids (little-endian unsigned 32-bit; none for an empty text). Spaces are kept
    and one is put before the text; characters without a piece become their bytes.
    Repeated rows stay; an empty table gives an empty result.

    The new units of each batch are concatenated and indexed by a suffix array; each
    piece's occurrences are a range of it. The edges, sorted by position, are relaxed by
    merging neighbours, best score first. Work in a task is bounded by a batch.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_path)
        for keys, texts in text_rows(batches, "case_id", "raw_text", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(encoder.encode(texts), pa.binary())], ["case_id", "piece_ids"])

    rows = cases.select(F.col("case_id").cast("long").alias("case_id"), F.col("raw_text").cast("string").alias("raw_text"))
    return rows.mapInArrow(tidy(encode), "case_id long, piece_ids binary")


def decode_cases(encoded: DataFrame, model_path: str) -> DataFrame:
    """The texts of piece ids: case_id, piece_ids (null: none) and raw_text.

    The space put before a text is taken off again. Control and unknown pieces write
    nothing; bytes that form no character become U+FFFD.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = Vocabulary(model_path).written
        for batch in batches:
            texts = []
            for ids in batch.column("piece_ids").to_pylist():
                text = b"".join(map(written.__getitem__, np.frombuffer(ids or b"", np.uint32).tolist()))
                texts.append(text.removeprefix(b" ").decode(errors="replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("case_id"), batch.column("piece_ids"), pa.array(texts, pa.string())], ["case_id", "piece_ids", "raw_text"])

    rows = encoded.select(F.col("case_id").cast("long").alias("case_id"), F.col("piece_ids"))
    return rows.mapInArrow(tidy(decode), "case_id long, piece_ids binary, raw_text string")
