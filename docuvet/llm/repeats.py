"""Exact repeats of long byte strings across document texts, by suffix arrays of content-defined shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .support import mix, ragged, shuffle_partitions, text_rows, tidy

WINDOW = 100
GRAM = 24
#: Text bytes whose repeats are collapsed before anything is exchanged.
BATCH_BYTES = 1 << 20
#: Bytes of one suffix array; building it takes about 100 times that.
SHARD_BYTES = 1 << 20
#: Texts looked at to find anchors with very many surroundings. Steers only where work is done.
SAMPLE_TEXTS = 4_000
#: Share of the sampled texts, and least number of surroundings, that make an anchor frequent.
FREQUENT = 1 / 200
LEAST = 16
#: Positions handled at once; their numbers fit the low bits of a minimum's key.
POSITIONS = 1 << 17

_NO_ID = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a multiple of 8) from each position."""
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    values = data.astype(np.uint64) + np.uint64(1)
    for width, factor in zip((1, 2, 4), factors):
        values = values[:-width] * factor + values[width:]
    eight = mix(values)
    out = eight[: len(data) - size + 1].copy()
    for at in range(8, size, 8):
        out = out * np.uint64(0xD6E8FEB86659FD93) + eight[at:at + len(out)]
    return mix(out)


def anchored_runs(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows that share their smallest gram: starts, numbers of windows, hashes of that gram.

    ``bounds``: where each text begins, and the end. Windows never cross texts. The
    smallest gram depends on a window's bytes alone, so equal windows have equal hashes
    and lie equally far from it.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < window:
        return empty
    hashes = gram_hashes(data, gram)
    low = np.uint64(POSITIONS * 2 - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, have = window - gram + 1, 1
    least = keys
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(keys) - span + 1], least[span - have:])
    anchor = (least & low).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
    inside = np.arange(len(anchor)) + window <= bounds[text + 1]
    change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])))
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(anchor)))
    good = inside[starts]
    return starts[good], sizes[good], hashes[anchor[starts[good]]]


def suffix_order(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes or more, and their ranks, by Larsson-Sadakane refinement.

    The first sort is by eight bytes; each round doubles that by sorting on the rank of
    the suffix further on, and touches only suffixes whose group still has several.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for at in range(8):
        key = (key << np.uint64(8)) | padded[at:at + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    rank[n] = 0
    have = 8
    while have < depth:
        sorted_rank = rank[order]
        alone = np.concatenate((sorted_rank[1:] != sorted_rank[:-1], [True])) & np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = order[places]
        pair = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(some + have, n)].astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        order[places] = some[by]
        pair = pair[by]
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[order[places]] = np.maximum.accumulate(np.where(head, places, 0)) + 1
        have *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length of the prefix each suffix in ``order`` shares with the one before it, exact below ``cap``.

    Kasai's rule in text order: where a suffix and its predecessor both move on by one
    byte, their common prefix shrinks by one. Only the other suffixes compare bytes.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.concatenate(([False], (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)))
    index = np.arange(n)
    head = np.maximum.accumulate(np.where(follows, 0, index))
    step = index - head
    head = head + step // cap * cap  # compare again now and then: lengths are cut at twice the cap
    heads = np.flatnonzero((head == index) & (before >= 0))
    length = np.zeros(n, np.int64)
    active, at = heads, 0
    padded = np.concatenate([data, np.zeros(2 * cap + 1, np.uint8)])
    while len(active) and at < 2 * cap:
        same = (padded[active + at] == padded[before[active] + at]) & (active + at < n) & (before[active] + at < n)
        active = active[same]
        length[active] += 1
        at += 1
    along = np.maximum(length[head] - (index - head), 0)
    along[before < 0] = 0
    return along[order]


class Shard:
    """Distinct windows of some passages in order, each with its first place in the corpus."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, windows: np.ndarray, places: np.ndarray, window: int = WINDOW,
                 alone: bool = False):
        """``starts``/``windows``: each passage's place in ``data`` and number of windows; ``places``: (id, salt, start) of each passage.

        ``alone``: it will not be merged and keeps none of its windows.
        """
        self.window = window
        order, _ = suffix_order(data, window)
        joined = common_prefixes(data, order, window)
        of = np.full(len(data), -1, np.int64)
        at = ragged(starts, windows)
        of[at] = np.repeat(np.arange(len(starts)), windows)
        group = np.cumsum(joined < window)
        real = of[order] >= 0
        order, group = order[real], group[real]
        passage = of[order]
        place = places[passage].copy()
        place[:, 2] += order - starts[passage]
        rank = np.lexsort((place[:, 2], place[:, 1], place[:, 0], group))
        first = np.concatenate(([True], group[rank][1:] != group[rank][:-1])) if len(rank) else np.zeros(0, bool)
        kept = rank[first]
        # a place that came twice, with equal rows, is no repeat of itself
        lead = place[kept][np.cumsum(first) - 1]
        self.repeated = place[rank[(place[rank] != lead).any(axis=1)]]
        if alone:
            return
        self.places = place[kept]
        self.windows = data[order[kept][:, None] + np.arange(window)] if len(kept) else np.zeros((0, window), np.uint8)

    def merge(self, other: Shard) -> None:
        """Take in another shard: each of its windows is looked up here by binary search."""
        pad = -self.window % 8
        words = [np.pad(s.windows, ((0, 0), (0, pad))).view(">u8").astype(np.uint64) for s in (self, other)]
        mine, theirs = words
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine), np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            probe = mine[np.minimum(middle, max(0, len(mine) - 1))]
            differs = probe != theirs
            where = differs.argmax(axis=1)
            rows = np.arange(len(theirs))
            less = differs.any(axis=1) & (probe[rows, where] < theirs[rows, where])
            open_ = low < high
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        spot = np.minimum(low, max(0, len(mine) - 1))
        same = (low < len(mine)) & (mine[spot] == theirs).all(axis=1) if len(mine) else np.zeros(len(theirs), bool)
        a, b = self.places[spot[same]], other.places[same]
        later = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & ((a[:, 1] > b[:, 1]) | ((a[:, 1] == b[:, 1]) & (a[:, 2] > b[:, 2]))))
        self.places[spot[same]] = np.where(later[:, None], b, a)
        twice = np.where(later[:, None], a, b)[(a != b).any(axis=1)]
        self.repeated = np.concatenate([self.repeated, other.repeated, twice])
        self.windows = np.insert(self.windows, low[~same], other.windows[~same], axis=0)
        self.places = np.insert(self.places, low[~same], other.places[~same], axis=0)


def spans_of(places: np.ndarray, windows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (id, salt, start, end): the bytes under runs of windows, joined where they touch within a text."""
    if not len(places):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))
    places, ends = places[order], (places[:, 2] + windows + window - 1)[order]
    new = np.concatenate(([True], (places[1:, :2] != places[:-1, :2]).any(axis=1)))
    # ends only grow inside a text once earlier ones are carried along
    text = np.cumsum(new)
    reach = np.maximum.accumulate(ends + text * (1 << 42)) - text * (1 << 42)
    cut = new | np.concatenate(([True], places[1:, 2] > reach[:-1]))
    starts = np.flatnonzero(cut)
    last = np.append(starts[1:], len(places)) - 1
    return np.column_stack([places[starts], reach[last]])


_ROWS = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("windows", pa.binary()),
    ("places", pa.binary()), ("contents", pa.binary()),
])
_ROWS_SHAPE = "kind int, bucket long, hashes binary, windows binary, places binary, contents binary"
#: Spans to remove have no hash; a stretch with one still has to be compared byte by byte.
_SPANS_SHAPE = "id long, salt long, start long, end long, hash long"
RUNS, FREQUENT_WINDOWS, REPEATS = 0, 1, 2


def _zip(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(blob: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _pieces(rows: Iterator, window: int):
    """Lists of (id, salt, base, bytes) of about ``POSITIONS`` bytes; a longer text comes in overlapping parts."""
    held, size = [], 0
    for key, text in rows:
        name = (_NO_ID if key["case_id"] is None else key["case_id"], key["salt"])
        for base in range(0, max(1, len(text) - window + 1), POSITIONS - window + 1):
            part = text[base:base + POSITIONS]
            if size and size + len(part) > POSITIONS:
                yield held
                held, size = [], 0
            held.append((*name, base, part))
            size += len(part)
    if held:
        yield held


def _runs_of(held: list, window: int, gram: int):
    data = np.frombuffer(b"".join(p[3] for p in held), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(p[3]) for p in held])))
    starts, windows, hashes = anchored_runs(data, bounds, window, gram)
    names = np.array([p[:3] for p in held], np.int64).reshape(-1, 3)
    text = np.searchsorted(bounds, starts, side="right") - 1
    places = names[text]
    places[:, 2] += starts - bounds[text]
    return data, starts, windows, hashes, places


def _by_bucket(hashes: np.ndarray, windows: np.ndarray, places: np.ndarray, contents, buckets: int) -> list[tuple]:
    """Runs as one packed row per bucket of their anchor; ``contents`` are hashes or the bytes themselves."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(bucket) else []
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)) if len(bucket) else []):
        mine = order[a:b]
        held = contents[mine].tobytes() if isinstance(contents, np.ndarray) else _zip(b"".join([contents[i] for i in mine]))
        out.append((RUNS, int(bucket[order[a]]), hashes[mine].tobytes(), _zip(windows[mine].astype(np.int32)), _zip(places[mine].T), held))
    return out


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 64]), _ROWS)], schema=_ROWS)


def _gather(rows: Iterator, buckets: int, frequent: np.ndarray, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Texts to packed runs by bucket, with repeats inside the batch already told apart."""
    first: dict[bytes, int] = {}
    kept_places, kept_windows, kept_hashes, repeats, repeat_windows, size = [], [], [], [], [], 0

    def better(a, b):
        return tuple(a) < tuple(b)

    def flush():
        nonlocal first, kept_places, kept_windows, kept_hashes, repeats, repeat_windows, size
        passages = list(first)  # in the order of the kept lists
        places = np.array(kept_places, np.int64).reshape(-1, 3)
        windows, hashes = np.array(kept_windows, np.int64), np.array(kept_hashes, np.uint64)
        again = spans_of(np.array(repeats, np.int64).reshape(-1, 3), np.array(repeat_windows, np.int64), window)
        out = []
        if len(again):
            out.append((REPEATS, int(again[0, 0] % buckets), b"", b"", _zip(again), b""))
        often = np.isin(hashes, frequent)
        if often.any():
            # windows of frequent anchors go their own ways, by their own hashes
            chosen = np.flatnonzero(often)
            data = np.frombuffer(b"".join(passages[i] for i in chosen), np.uint8)
            begins = np.concatenate(([0], np.cumsum(windows[chosen] + window - 1)[:-1]))
            at = ragged(begins, windows[chosen])
            grams = gram_hashes(data, 8)
            prints = np.zeros((len(at), 2), np.uint64)
            for k in [*range(0, window - 7, 8), window - 8]:
                prints[:, 0] = mix(prints[:, 0] ^ grams[at + k], 1)
                prints[:, 1] = mix(prints[:, 1] + grams[at + k], 2)
            where = np.repeat(places[chosen], windows[chosen], axis=0)
            where[:, 2] += at - np.repeat(begins, windows[chosen])
            order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], prints[:, 1], prints[:, 0]))
            prints, where = prints[order], where[order]
            new = np.concatenate(([True], (prints[1:] != prints[:-1]).any(axis=1)))
            local = spans_of(where[~new], np.ones((~new).sum(), np.int64), window)
            if len(local):
                out.append((REPEATS, int(local[0, 0] % buckets), b"", b"", _zip(local), b""))
            prints, where = prints[new], where[new]
            bucket = (prints[:, 0] >> np.uint64(32)) % np.uint64(buckets)
            for b in np.unique(bucket):
                mine = bucket == b
                out.append((FREQUENT_WINDOWS, int(b), _zip(prints[mine]), b"", _zip(where[mine]), b""))
        rare = np.flatnonzero(~often)
        contents = np.fromiter(map(xxhash.xxh3_64_intdigest, passages), np.uint64, len(passages))
        out += _by_bucket(hashes[rare], windows[rare], places[rare], contents[rare], buckets)
        first, kept_places, kept_windows, kept_hashes, repeats, repeat_windows, size = {}, [], [], [], [], [], 0
        yield from _sent(out)

    for held in _pieces(rows, window):
        data, starts, windows, hashes, places = _runs_of(held, window, gram)
        raw = data.tobytes()
        place_rows = places.tolist()
        for i, (a, n, h) in enumerate(zip(starts.tolist(), windows.tolist(), hashes.tolist())):
            passage = raw[a:a + n + window - 1]
            at = first.setdefault(passage, len(kept_places))
            place = place_rows[i]
            if at == len(kept_places):
                kept_places.append(place)
                kept_windows.append(n)
                kept_hashes.append(h)
            elif place != kept_places[at]:
                if better(place, kept_places[at]):
                    place, kept_places[at] = kept_places[at], place
                repeats.append(place)
                repeat_windows.append(n)
        size += len(data)
        if size >= BATCH_BYTES:
            yield from flush()
    if size:
        yield from flush()


def resolve(hashes: np.ndarray, windows: np.ndarray, places: np.ndarray, data: np.ndarray, window: int = WINDOW,
            shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Spans of all windows that also start earlier, among distinct passages whose anchors' hashes meet here."""
    sizes = windows + window - 1
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(hashes, kind="stable")
    ends = np.cumsum(sizes[order])
    sorted_hashes = hashes[order]
    found, at = [np.zeros((0, 3), np.int64)], 0

    def shard(part: np.ndarray, alone: bool) -> Shard:
        starts = np.cumsum(sizes[part]) - sizes[part]
        return Shard(data[ragged(begins[part], sizes[part])], starts, windows[part], places[part], window, alone)

    def reach(at: int) -> int:
        return max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[order[at]] + shard_bytes, side="right")))

    while at < len(order):
        stop = reach(at)
        if stop < len(order):  # equal windows have equal hashes: a shard ends where a hash does
            stop = int(np.searchsorted(sorted_hashes, sorted_hashes[stop], side="left"))
        if stop > at:
            found.append(shard(order[at:stop], True).repeated)
            at = stop
            continue
        # one hash fills several shards: only these have to be merged
        stop, shards = int(np.searchsorted(sorted_hashes, sorted_hashes[at], side="right")), []
        while at < stop:
            to = min(stop, reach(at))
            shards.append(shard(order[at:to], False))
            at = to
        while len(shards) > 1:
            merged = []
            for left, right in zip(shards[::2], [*shards[1::2], None]):
                if right is not None:
                    left.merge(right)
                merged.append(left)
            shards = merged
        found.append(shards[0].repeated)
    repeated = np.concatenate(found)
    return spans_of(repeated, np.ones(len(repeated), np.int64), window)


def _spans_table(spans: np.ndarray, hashes: np.ndarray | None = None, stretches: np.ndarray | None = None) -> pa.Table:
    hashes = np.zeros(0, np.uint64) if hashes is None else hashes
    rows = spans if stretches is None else np.concatenate([spans, stretches])
    names = ("id", "salt", "start", "end")
    found = pa.array(np.concatenate([np.zeros(len(spans), np.int64), hashes.view(np.int64)]), mask=np.arange(len(rows)) < len(spans))
    return pa.table({**{name: pa.array(rows[:, i]) for i, name in enumerate(names)}, "hash": found})


def _settle(table: pa.Table, window: int) -> pa.Table:
    """All packed rows of one bucket to spans, and to the stretches whose equal parts only bytes can tell."""
    found = [np.zeros((0, 4), np.int64)]
    rows = table.select(["kind", "hashes", "windows", "places", "contents"]).to_pylist()
    for row in rows:
        if row["kind"] == REPEATS:
            found.append(_unzip(row["places"], np.int64).reshape(-1, 4))
    often = [r for r in rows if r["kind"] == FREQUENT_WINDOWS]
    if often:
        # sorted lists of the batches, merged
        prints = np.concatenate([_unzip(r["hashes"], np.uint64).reshape(-1, 2) for r in often])
        places = np.concatenate([_unzip(r["places"], np.int64).reshape(-1, 3) for r in often])
        order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], prints[:, 1], prints[:, 0]))
        prints, places = prints[order], places[order]
        again = np.concatenate(([False], (prints[1:] == prints[:-1]).all(axis=1) & (places[1:] != places[:-1]).any(axis=1)))
        found.append(spans_of(places[again], np.ones(again.sum(), np.int64), window))
    runs = [r for r in rows if r["kind"] == RUNS]
    if not runs:
        return _spans_table(np.concatenate(found))
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in runs])
    contents = np.concatenate([np.frombuffer(r["contents"], np.uint64) for r in runs])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    shared = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    windows = np.concatenate([_unzip(r["windows"], np.int32) for r in runs]).astype(np.int64)[shared]
    places = np.concatenate([_unzip(r["places"], np.int64).reshape(3, -1).T for r in runs])[shared]
    hashes, contents = hashes[shared], contents[shared]
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], contents, hashes))
    hashes, contents, windows, places = hashes[order], contents[order], windows[order], places[order]
    fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (contents[1:] != contents[:-1]))) if len(order) else np.zeros(0, bool)
    again = ~fresh
    again[1:] &= (places[1:] != places[:-1]).any(axis=1)
    found.append(spans_of(places[again], windows[again], window))
    hashes, windows, places = hashes[fresh], windows[fresh], places[fresh]
    same = hashes[1:] == hashes[:-1]
    mixed = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(hashes) else np.zeros(0, bool)
    stretches = np.column_stack([places[mixed], places[mixed][:, 2] + windows[mixed] + window - 1])
    return _spans_table(np.concatenate(found), hashes[mixed], stretches)


def _fetch(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Texts and their open stretches to packed passages by bucket."""
    for batch in batches:
        hashes, windows, places, passages, size = [], [], [], [], 0
        raw = batch.column("raw_text").cast(pa.large_binary())
        names = zip(batch.column("id").to_pylist(), batch.column("salt").to_pylist(), raw, batch.column("stretches"))
        for row, (case, salt, text, stretches) in enumerate(names):
            text = text.as_py()
            for x in stretches.as_py():
                hashes.append(x["hash"])
                windows.append(x["end"] - x["start"] - window + 1)
                places.append((case, salt, x["start"]))
                passages.append(text[x["start"]:x["end"]])
                size += x["end"] - x["start"]
            if size >= BATCH_BYTES or row == batch.num_rows - 1:
                yield from _sent(_by_bucket(np.array(hashes, np.int64).view(np.uint64), np.array(windows, np.int64),
                                            np.array(places, np.int64).reshape(-1, 3), passages, buckets))
                hashes, windows, places, passages, size = [], [], [], [], 0


def _index(table: pa.Table, window: int, shard_bytes: int) -> pa.Table:
    rows = table.select(["hashes", "windows", "places", "contents"]).to_pylist()
    return _spans_table(resolve(
        np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]),
        np.concatenate([_unzip(r["windows"], np.int32) for r in rows]).astype(np.int64),
        np.concatenate([_unzip(r["places"], np.int64).reshape(3, -1).T for r in rows]),
        np.concatenate([_unzip(r["contents"]) for r in rows]), window, shard_bytes))


def _frequent_anchors(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Hashes of anchors that lie in many different surroundings; at most a few per sampled text."""
    total = rows.count()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_rows(batches, "row", "raw_text"):
            for held in _pieces(zip(keys, texts), window):
                data, starts, windows, hashes, _ = _runs_of(held, window, gram)
                around = mix(gram_hashes(data, 8)[starts]) ^ gram_hashes(data, 8)[starts + windows + window - 9]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64))], ["h", "around"])

    share = min(1.0, SAMPLE_TEXTS / max(1, total))
    chosen = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    least = max(LEAST, int(FREQUENT * min(total, SAMPLE_TEXTS)))
    found = (
        chosen.mapInArrow(tidy(anchors), "h long, around long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least).select("h").toPandas()
    )
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64))


def remove_repeats(cases: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Cut every byte that lies in a ``window``-byte string which also starts earlier in the corpus.

    ``cases``: case_id (long), raw_text (null: empty); other columns are ignored. Texts
    are UTF-8 bytes; strings never cross texts and are judged on the input. Earlier
    means a smaller case_id, or the same text further left; different texts of one
    case_id come by a hash of the text, and texts without case_id last. Rows equal in
    both columns are one text and get the same answer each. Output, one row per input
    row: case_id, n_bytes, n_removed, n_spans (maximal removed runs), spans (array of
    start and end) and kept (binary: what remains; a cut may split a character). Texts
    shorter than ``window`` stay whole; an empty table gives an empty result.

    Windows are cut into runs that share their smallest gram, so equal strings meet in
    one bucket wherever they are. Only hashes are exchanged at first: a run without an
    equal anchor is dropped, and equal runs collapse, in each batch and in the bucket.
    The bytes of runs that share an anchor but differ are then fetched and indexed:
    suffix arrays of at most ``shard_bytes``, merged by binary search where they share an anchor. Anchors with very many surroundings, found in a bounded
    sample of texts, exchange their windows one by one instead, so that none of them
    fills a bucket. What is removed does not depend on that sample.
    """
    buckets = 2 * shuffle_partitions(cases)
    texts = cases.select(
        F.col("case_id").cast("long").alias("case_id"), F.coalesce(F.col("raw_text").cast("string"), F.lit("")).alias("raw_text"),
    ).withColumn("salt", F.xxhash64("raw_text"))
    rows = texts.select(F.struct("case_id", "salt").alias("row"), "raw_text")
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent_anchors(rows, window, gram))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for keys, texts in text_rows(batches, "row", "raw_text") for pair in zip(keys, texts))
        return _gather(pairs, buckets, frequent.value, window, gram)

    spread = rows.mapInArrow(tidy(gather), _ROWS_SHAPE).groupBy("bucket")
    told = materialize(spread.applyInArrow(tidy(lambda table: _settle(table, window)), _SPANS_SHAPE), "runs")
    named = texts.withColumn("id", F.coalesce("case_id", F.lit(int(_NO_ID))))
    open_ = told.where("hash is not null").groupBy("id", "salt").agg(
        F.collect_list(F.struct("start", "end", "hash")).alias("stretches"))
    passages = named.join(open_, ["id", "salt"]).select("id", "salt", "raw_text", "stretches").mapInArrow(
        tidy(lambda batches: _fetch(batches, buckets, window)), _ROWS_SHAPE)
    compared = passages.groupBy("bucket").applyInArrow(tidy(lambda table: _index(table, window, shard_bytes)), _SPANS_SHAPE)
    spans = told.where("hash is null").drop("hash").unionByName(compared.drop("hash"))
    per_text = materialize(spans.groupBy("id", "salt").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeats")
    joined = named.join(per_text, ["id", "salt"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            raw = batch.column("raw_text").cast(pa.large_binary())
            for text, spans in zip(raw, batch.column("spans").to_pylist()):
                text, runs = text.as_py(), []
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                kept, at = [], 0
                for start, end in runs:
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                for column, value in zip(out, (len(text), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], b"".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([
                batch.column("case_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                pa.array([len(r) for r in out[2]], pa.int64()),
                pa.array(out[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[3], pa.binary())],
                ["case_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.select("case_id", "raw_text", "spans").mapInArrow(
        tidy(cut), "case_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
