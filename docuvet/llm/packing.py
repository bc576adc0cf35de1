"""Token sequences of fixed capacity: a configuration linear program over the length histogram, then best fit."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .support import shuffle_partitions, text_rows, tidy

CAPACITY = 4096
END_ID = 1
#: Size classes of the linear program.
UNITS = 256
#: Lengths below this share of the capacity are left to the best fit.
SMALL = 1 / 16
#: Multiplicative weights: step and most rounds.
STEP = 0.3
ROUNDS = 3_000
#: Distinct words whose ids a worker remembers at once.
REMEMBERED = 1_000_000

#: Stops between an ASCII letter and white space: tokens of their own.
_STOPS = re.compile(rb"(?<=[A-Za-z])([.,]+)(?=[ \n]|$)")


class Encoder:
    """Token ids of whole texts through the ids of their distinct white-space-free parts.

    The tokenizer drops white space and never joins what it separates, so the ids of a
    text are those of its parts one after another. It also separates letters from the
    stops behind them and ignores case. Plain ASCII words are therefore encoded many to
    a line by the same model without the text normaliser, and told apart by their
    word-end ids; all other parts are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        setup |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.plain = Tokenizer.from_str(json.dumps(setup))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this process: tasks that a worker runs one after another share what was learnt."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def learn(self, parts: set[bytes]) -> None:
        plain = [p for p in parts if p.isalpha()]  # ASCII letters only
        lettered, ends, others = [], [], []
        for part in parts.difference(plain):
            word = part.decode()
            core = word.rstrip(".,")
            if core.isalpha():
                lettered.append(part)
                ends.append(1 + (len(core) < len(word)))
            else:
                others.append(part)
        for at in range(0, len(plain), 1000):
            self._learn_line(self.plain, plain[at:at + 1000], None)
        for at in range(0, len(lettered), 1000):
            line = lettered[at:at + 1000]
            if not self._learn_line(self.tokenizer, line, ends[at:at + 1000]):
                others += line
        for at in range(0, len(others), 4096):
            some = others[at:at + 4096]
            coded = self.tokenizer.encode_batch_fast([o.decode() for o in some], add_special_tokens=False)
            self.known.update((part, np.array(one.ids, np.uint32).tobytes()) for part, one in zip(some, coded))

    def _learn_line(self, tokenizer, line: list[bytes], ends: list[int] | None) -> bool:
        """Encode parts in one go; ``ends``: how many word ends each has. False if they come out otherwise."""
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(line).decode()], add_special_tokens=False)[0].ids, np.uint32)
        stops = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if ends is not None:
            last = np.cumsum(ends) - 1
            if len(stops) != last[-1] + 1:
                return False
            stops = stops[last]
        stops = stops.tolist()
        packed = ids.tobytes()
        self.known.update(zip(line, map(packed.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        return True

    def encode(self, texts: list[bytes], remember: int = REMEMBERED) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; about ``remember`` words stay known."""
        if len(self.known) > remember:
            self.known = {}
        # a text that may name a special token keeps its case
        split = [_STOPS.sub(rb" \1", t if b"<|" in t else t.lower()).split() for t in texts]
        new = set()
        for parts in split:
            new.update(parts)
        new.difference_update(self.known)
        if new:
            self.learn(new)
        look = self.known.__getitem__
        return [b"".join(map(look, parts)) for parts in split]


def tokenize_cases(cases: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   remember: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """Token pieces of document analyses.

    ``cases``: case_id, raw_text (null: empty); other columns are ignored.
    ``tokenizer_path`` names a file that executors can read. Output, one row per piece:
    case_id, piece (from 0), start (ids of the text before it), length and ids
    (little-endian unsigned 32-bit). Each text ends with ``end_id``; texts longer than
    ``capacity`` ids are cut into pieces of it, the last one shorter. A worker keeps the
    ids of about ``remember`` words, which trades its memory for speed; unless ``lasting``
    it drops them and the tokenizer after each task, for jobs that go on with other work.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path) if lasting else Encoder(tokenizer_path)
        close = np.array([end_id], np.uint32).tobytes()
        for keys, texts in text_rows(batches, "case_id", "raw_text", 2 << 20):
            rows: list[list] = [[], [], [], [], []]
            for key, ids in zip(keys, encoder.encode(texts, remember)):
                ids += close
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (key, number, at // 4, len(cut) // 4, cut)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())],
                ["case_id", "piece", "start", "length", "ids"])

    rows = cases.select(F.col("case_id").cast("long").alias("case_id"), F.col("raw_text").cast("string").alias("raw_text"))
    return rows.mapInArrow(tidy(pieces), "case_id long, piece int, start long, length long, ids binary")


def _best_configuration(values: np.ndarray, units: int) -> dict[int, int]:
    """Knapsack pricing: the most valuable multiset of classes (class k takes k units)."""
    sizes = np.flatnonzero(values > 0)
    best, choice = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    price = values[sizes]
    for room in range(1, units + 1):
        fit = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if fit:
            got = best[room - sizes[:fit]] + price[:fit]
            at = int(got.argmax())
            if got[at] > best[room]:
                best[room], choice[room] = got[at], sizes[at]
    chosen: dict[int, int] = defaultdict(int)
    room = units
    while room > 0:
        if choice[room]:
            chosen[int(choice[room])] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return dict(chosen)


def configurations(demand: np.ndarray, units: int = UNITS, step: float = STEP, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """A fractional cover of ``demand`` (items by class) by configurations, largest amount first.

    Each class has a weight that falls as it is covered; each round adds the
    configuration of the largest weight, as much as its scarcest class allows.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    weight = np.zeros(units + 1)
    weight[classes] = 1.0 / demand[classes]
    covered = np.zeros(units + 1)
    amount: dict[tuple, float] = defaultdict(float)
    goal = np.log(len(classes) + 1) / step**2
    for _ in range(rounds):
        chosen = _best_configuration(weight, units)
        most = min(demand[k] / n for k, n in chosen.items())
        amount[tuple(sorted(chosen.items()))] += most
        for k, n in chosen.items():
            covered[k] += n * most / demand[k]
            weight[k] *= np.exp(-step * n * most / demand[k])
        weight /= weight.max()
        if covered[classes].min() >= goal:
            break
    scale = max(covered[classes].min(), 1.0)
    return sorted(((dict(c), x / scale) for c, x in amount.items()), key=lambda cx: (-cx[1], sorted(cx[0].items())))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Sequences for a histogram of lengths, as rows (length, first, sequence, offset), sorted.

    The ``first``-th piece of that length and those after it, up to the next row's
    first, go to ``sequence`` and those after it, at ``offset``. Whole configurations
    of the linear program are laid first, filled with the longest pieces of each class;
    all other pieces follow by decreasing length, each to the sequence it fills best.
    """
    unit = -(-capacity // UNITS)
    units = capacity // unit
    left = {k: v for k, v in histogram.items() if v}
    large = [k for k in left if k >= capacity * SMALL]
    demand = np.zeros(-(-capacity // unit) + 1)
    pools: dict[int, list[list[int]]] = defaultdict(list)
    # a length that fills the last, partial unit fits no configuration
    large = [k for k in large if -(-k // unit) <= units]
    for length in sorted(large):
        demand[-(-length // unit)] += left[length]
        pools[-(-length // unit)].append([length, left[length]])
    open_by_slack: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    slacks = 0

    def put(count: int, items: tuple[int, ...]) -> None:
        nonlocal slacks
        slack = capacity - sum(items)
        open_by_slack[slack].append((count, items))
        slacks |= 1 << slack

    remaining = demand.copy()
    for chosen, amount in configurations(demand[:units + 1], units):
        times = int(min(round(amount), *(remaining[k] // n for k, n in chosen.items())))
        if times < 1:
            continue
        slots = []
        # the smaller half of the places stays open: the best fit closes it to the token
        places = sorted(k for k, n in chosen.items() for _ in range(n))
        held = Counter(places[len(places) // 2:])
        for k, n in chosen.items():
            remaining[k] -= n * times
            for _ in range(held[k]):
                runs, need = [], times
                while need:
                    top = pools[k][-1]
                    taken = min(need, top[1])
                    runs.append([top[0], taken])
                    left[top[0]] -= taken
                    top[1] -= taken
                    need -= taken
                    if not top[1]:
                        pools[k].pop()
                slots.append(runs)
        while slots and slots[0]:
            alike = min(runs[0][1] for runs in slots)
            put(alike, tuple(runs[0][0] for runs in slots))
            for runs in slots:
                runs[0][1] -= alike
                if not runs[0][1]:
                    runs.pop(0)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            above = slacks >> length
            if above:
                slack = length + (above & -above).bit_length() - 1
                n, items = open_by_slack[slack].pop()
                taken = min(n, count)
                if taken < n:
                    open_by_slack[slack].append((n - taken, items))
                elif not open_by_slack[slack]:
                    slacks &= ~(1 << slack)
                put(taken, (*items, length))
                count -= taken
            else:
                each = capacity // length
                if count >= each:
                    put(count // each, (length,) * each)
                if count % each:
                    put(1, (length,) * (count % each))
                count = 0
    rows, used, sequence = [], defaultdict(int), 0
    for bins in open_by_slack:
        for count, items in bins:
            offset = 0
            for length in items:
                rows.append((length, used[length], sequence, offset))
                used[length] += count
                offset += length
            sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place token pieces into as few sequences of ``capacity`` tokens as the plan finds.

    ``pieces``: case_id, piece, length (1 to ``capacity``) and any other columns, which
    are kept unless they are called sequence_id or offset. Adds sequence_id (from 0) and
    offset (gapless inside a sequence). Repeated rows are packed each; an empty table
    gives an empty result.

    Only the histogram, of at most ``capacity`` rows, and the plan made from it reach the
    driver: the plan's size depends on the number of lengths and configurations, not on
    the number of pieces. Pieces of one length are numbered in hash blocks, so a
    frequent length does not meet in one task.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    blocks = shuffle_partitions(pieces)
    rows = pieces.select(*kept).withColumn("_block", F.pmod(F.xxhash64("case_id", "piece", "length"), F.lit(blocks)))
    sizes = rows.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    ranges = pieces.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    inside = Window.partitionBy("length", "_block").orderBy("case_id", "piece")
    numbered = (
        rows.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["length", "_block"])
        .select(*kept, (F.col("_first") + F.col("_row")).cast("long").alias("_ordinal"))
    )
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_ordinal")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranges.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            ordinal = np.asarray(batch.column("_ordinal"))
            at = np.searchsorted(keys, (np.asarray(batch.column("length")) << 44) + ordinal, side="right") - 1
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_ordinal"]
            names = [name for name in batch.schema.names if name != "_ordinal"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(table[at, 2] + ordinal - table[at, 1]), pa.array(table[at, 3])],
                [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(tidy(place), f"{shape}, sequence_id long, offset long")


def pack_cases(cases: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
               remember: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """Tokenize and place document analyses: case_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenize_cases(cases, tokenizer_path, capacity, end_id, remember, lasting)
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack_pieces(pieces, capacity)
