"""Collocations of case texts by dynamic itemset counting over cyclic shard scans."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, materialize
from .support import mix, tidy

UNKNOWN_LANGUAGE = "und"
#: Shards that one full cycle visits.
SHARDS = 4
#: Bytes of text that one packed row of a shard holds, about.
BATCH_BYTES = 2 << 20
#: Slots of the table of activation steps, one byte each: the bound of what is broadcast, whatever the corpus.
SLOTS = 1 << 24
#: Slots that words, then pairs of words, are counted in before anything else; one bit each once they are counted.
PART_SLOTS = 1 << 27
#: Slots of one page of bits.
PAGE_SLOTS = 1 << 15
_NEVER = 255

_FOLDED = bytearray(range(256))
_FOLDED[65:91] = range(97, 123)
for _end in b".,;:!?\n\x0b\x0c\r":
    _FOLDED[_end] = 10
_FOLDED = bytes(_FOLDED)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each shard as word numbers, -1 after every piece, beside the words themselves."""
    held: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)

    def packed(shard: int) -> pa.RecordBatch:
        numbers = count()
        known: dict[str, defaultdict] = {}
        ids: list[int] = []
        for language, text in held.pop(shard):
            words = known.setdefault(language, defaultdict(numbers.__next__))
            for piece in text.split(b"\n"):
                found = piece.split()
                if found:
                    ids.extend(map(words.__getitem__, found))
                    ids.append(-1)
        size.pop(shard)
        words = [b""] * next(numbers)
        spoken = np.zeros(len(words), np.int32)
        hashes = np.zeros(len(words), np.uint64)
        for place, (language, own) in enumerate(known.items()):
            seed, at = xxhash.xxh64_intdigest(language), list(own.values())
            spoken[at] = place
            hashes[at] = [xxhash.xxh64_intdigest(word, seed) for word in own]
            for word, n in own.items():
                words[n] = word
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int32), hashes, spoken)),
            pa.array([list(known)], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
        ], ["shard", "ids", "hashes", "spoken", "languages", "words"])

    for batch in batches:
        for shard, language, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "language", "raw_text"))):
            raw = text.encode().translate(_FOLDED)
            held[shard].append((language, raw))
            size[shard] += len(raw)
            if size[shard] >= BATCH_BYTES:
                yield packed(shard)
    for shard in list(held):
        yield packed(shard)


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(slots - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def _slot_columns(slots: int):
    return F.array(*[part.bitwiseAND(F.lit(slots - 1)) for part in (F.col("hash"), F.shiftrightunsigned("hash", 32))])


def _runs(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each different phrase of ``length`` words among the places ``at``."""

    def unlike(order: np.ndarray) -> np.ndarray:
        p, q = order[:-1], order[1:]
        changed = np.zeros(len(p), bool)
        for j in range(length):
            changed |= ids[p + j] != ids[q + j]
        return changed

    order = at[np.argsort(hashes[at], kind="stable")]
    changed = unlike(order)
    if (changed & (hashes[order[:-1]] == hashes[order[1:]])).any():  # hashes collide: order by the words instead
        order = at[np.lexsort([ids[at + j] for j in reversed(range(length))])]
        changed = unlike(order)
    first = np.flatnonzero(np.concatenate([[True], changed])) if len(order) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(order)))


def _full(hashes: np.ndarray, bits: bytes | None) -> np.ndarray:
    """Which hashes lie in full slots; without bits all do."""
    if bits is None:
        return np.ones(len(hashes), bool)
    slot = (hashes & np.uint64(PART_SLOTS - 1)).astype(np.int32)
    return np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1


def _levels(ids: np.ndarray, each: np.ndarray, bits: tuple[bytes | None, bytes | None], ages: np.ndarray, longest: int, step: int):
    """Per length: places of phrases whose parts are in ``ages`` by ``step``, their first step, and hashes by place.

    ``each``: a hash of every word with its language; ``bits``: the slots of words and of
    pairs that can be frequent at all, the others end a phrase like a piece does. ``ages`` holds at a phrase's two
    slots the step at which it reached the threshold. Slots never change once set, so
    every task and step derives the same cycle for a phrase; a shared slot only lets a
    phrase start its (complete) cycle earlier.
    """
    held = np.append(_full(each, bits[0]), False)[ids]
    inside = np.append(held, np.zeros(longest, bool))
    alive = np.flatnonzero(held)
    words = np.zeros(len(ids), np.uint64)
    words[alive] = each[ids[alive]]
    hashes, begun = words, np.zeros(len(alive), np.int64)
    for length in range(1, longest + 1):
        if length > 1:
            # no earlier than its parts begin: their slots may have been taken by others before
            begun = np.maximum(np.maximum(age[alive], age[alive + 1]) + 1, np.maximum(start[alive], start[alive + 1]))
            keep = inside[alive + length - 1] & (begun <= step)
            alive, begun = alive[keep], begun[keep]
            rolled = np.zeros(len(ids), np.uint64)
            rolled[alive] = mix(hashes[alive] * np.uint64(0x9E3779B97F4A7C15) + words[alive + length - 1], length)
            hashes = rolled
        if length == 2:
            possible = _full(hashes[alive], bits[1])
            alive, begun = alive[possible], begun[possible]
        if not len(alive):
            return
        yield length, alive, begun, hashes
        one, two = _slots(hashes[alive], len(ages))
        age = np.full(len(ids) + 1, _NEVER, np.int64)
        age[alive] = np.maximum(ages[one], ages[two])
        start = np.zeros(len(ids) + 1, np.int64)
        start[alive] = begun


def count_batch(ids: np.ndarray, each: np.ndarray, bits: tuple, ages: np.ndarray, step: int, shards: int, longest: int):
    """Hashes, numbers and cycles of the phrases whose cycle includes ``step``; a cycle is first step * 8 + length."""
    for length, alive, begun, hashes in _levels(ids, each, bits, ages, longest, step):
        if length == 1:
            if step < shards:
                usable = _full(each, bits[0])
                yield each[usable], np.bincount(ids[alive], minlength=len(each))[usable], np.ones(int(usable.sum()), np.int64)
            continue
        counted = begun + shards > step
        found, first, numbers = np.unique(hashes[alive[counted]], return_index=True, return_counts=True)
        yield found, numbers, begun[counted][first] * 8 + length


def marked_slots(slots: DataFrame, size: int) -> np.ndarray:
    """The numbers in the column ``slot`` as one bit of ``size`` each, however many rows there are; pages of bits are put together by the tasks."""
    pages = slots.groupBy(F.shiftright("slot", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(PAGE_SLOTS - 1)).cast("long")).alias("bits"))
    bits = np.zeros(max(size, PAGE_SLOTS) >> 3, np.uint8)
    for batch in pages.toArrow().to_batches():
        for page, own in zip(batch.column("page").to_pylist(), batch.column("bits")):
            bits[page * PAGE_SLOTS >> 3:(page + 1) * PAGE_SLOTS >> 3] = np.frombuffer(own.as_buffer(), np.uint8)
    return bits


def count_phrases(cases: DataFrame, threshold: int = 100, longest: int = 5, shards: int = SHARDS, slots: int = SLOTS):
    """Exact numbers of all phrases of up to ``longest`` words that occur ``threshold`` times or more in a language.

    Returns ``(phrases, totals)``: language, phrase (words joined by a space), length,
    occurrences; and language, n_words over all words. The cases are dealt into
    ``shards`` shards by a hash. Scans visit one shard after another, over and over. All
    words are counted from the first scan on; a longer phrase from the scan after both
    its parts of one word less have reached the threshold, each for exactly one cycle.
    Counting ends when nothing has reached the threshold for a cycle.

    Words, then pairs of words are first counted by slot: those of a slot that stays below
    the threshold cannot be frequent and are left out of the scans. Scans count hashes of phrases, and
    hashes that share a value can only count too much. What they find frequent is then counted by its words in one last scan, whose
    numbers are the result. Counts stay in Spark, grouped where they are made before they
    are shuffled; each scan's state is written to the shared folder and replaces the one
    before. What passes through the driver is a table of ``slots`` bytes (a power of two) and bits of slots.
    """
    language = F.coalesce(F.col("language").cast("string"), F.lit(UNKNOWN_LANGUAGE))
    dealt = cases.select(
        F.pmod(F.xxhash64("case_id", "raw_text"), F.lit(shards)).cast("int").alias("shard"), language.alias("language"),
        F.coalesce(F.col("raw_text").cast("string"), F.lit("")).alias("raw_text"))
    packed = materialize(
        dealt.mapInArrow(tidy(_pack), "shard int, ids binary, hashes binary, spoken binary, languages array<string>, words array<string>"),
        "shards", ["shard"])
    spark = cases.sparkSession

    def slot_bits(read_hashes) -> bytes:
        """One bit for each slot that holds ``threshold`` occurrences or more of what ``read_hashes`` finds in a packed row."""

        def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def summed() -> Iterator[pa.RecordBatch]:
                used, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
                held.clear()
                for lo in range(0, len(used), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(used[lo:lo + 100_000]), pa.array(sums[lo:lo + 100_000])], ["slot", "n"])

            for batch in batches:
                for row in range(batch.num_rows):
                    hashes, numbers = read_hashes(
                        np.frombuffer(batch.column("ids")[row].as_py(), np.int32), np.frombuffer(batch.column("hashes")[row].as_py(), np.uint64))
                    held.append(((hashes & np.uint64(PART_SLOTS - 1)).astype(np.int32), numbers))
                    if sum(len(x) for x, _ in held) > 1_000_000:
                        yield from summed()
            if held:
                yield from summed()

        # of all slots one bit each comes to the driver and goes to the tasks
        full = packed.select("ids", "hashes").mapInArrow(tidy(by_slot), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(
            F.col("n") >= threshold)
        return marked_slots(full, PART_SLOTS).tobytes()

    word_bits = spark.sparkContext.broadcast(slot_bits(lambda ids, each: (each, np.bincount(ids[ids >= 0], minlength=len(each)))))

    def pairs_of(ids: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros(0, np.uint64)
        for length, alive, _, hashes in _levels(ids, each, (word_bits.value, None), np.zeros(1, np.uint8), 2, 1):
            if length == 2:
                found = hashes[alive]
        return np.unique(found, return_counts=True)

    pair_bits = spark.sparkContext.broadcast(slot_bits(pairs_of))

    def set_slots(hashes: DataFrame) -> np.ndarray:
        """Which slots the hashes take: one bit of each comes to the driver."""
        bits = marked_slots(hashes.select(F.explode(_slot_columns(slots)).alias("slot")), slots)
        return np.unpackbits(bits, bitorder="little")[:slots].view(bool)

    ages = np.full(slots, _NEVER, np.uint8)
    begun = F.floor(F.col("cycle") / 8)
    state, found = None, []
    step, last = 0, -1
    while step <= last + shards:
        if step >= _NEVER - shards:
            raise ValueError("too many scans for one byte a slot: take fewer shards")
        shipped = spark.sparkContext.broadcast(ages.tobytes())

        def scan(batches: Iterator[pa.RecordBatch], step=step, shipped=shipped) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(shipped.value, np.uint8)
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int32)
                    each = np.frombuffer(batch.column("hashes")[row].as_py(), np.uint64)
                    for hashes, numbers, cycle in count_batch(ids, each, (word_bits.value, pair_bits.value), table, step, shards, longest):
                        for lo in range(0, len(hashes), 100_000):
                            part = slice(lo, lo + 100_000)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(hashes[part].view(np.int64)), pa.array(cycle[part].astype(np.int32)), pa.array(numbers[part])],
                                ["hash", "cycle", "occurrences"])

        going = packed.where(F.col("shard") == step % shards).select("ids", "hashes").mapInArrow(
            tidy(scan), "hash long, cycle int, occurrences long")
        if state is not None:
            going = going.unionByName(state.where(begun + shards > step))
        sums = going.groupBy("hash").agg(F.max("cycle").alias("cycle"), F.sum("occurrences").alias("occurrences"))
        previous, state = state, materialize(sums, "phrases")
        shipped.destroy()
        if previous is not None:
            discard(previous)
        changed = set_slots(state.where((F.col("occurrences") >= threshold) & (F.col("cycle") % 8 < longest)))
        changed &= ages == _NEVER
        if changed.any():
            ages[changed] = step
            last = step
        found.append(materialize(
            state.where((begun + shards - 1 == step) & (F.col("occurrences") >= threshold)).select("hash"), "frequent"))
        step += 1
    frequent = found[0]
    for part in found[1:]:
        frequent = frequent.unionByName(part)
    kept = np.full(slots, _NEVER, np.uint8)
    kept[set_slots(frequent)] = 0
    shipped = spark.sparkContext.broadcast(kept.tobytes())

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shipped.value, np.uint8)
        keys = ["language", "phrase", "length"]
        held: list[pa.RecordBatch] = []

        def summed() -> Iterator[pa.RecordBatch]:
            sums = pa.Table.from_batches(held).group_by(keys).aggregate([("occurrences", "sum")])
            held.clear()
            yield from sums.select([*keys, "occurrences_sum"]).rename_columns([*keys, "occurrences"]).to_batches(100_000)

        for batch in batches:
            for row in range(batch.num_rows):
                ids, each, spoken = (
                    np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("ids", np.int32), ("hashes", np.uint64), ("spoken", np.int32)))
                languages, words = batch.column("languages")[row].values, batch.column("words")[row].values
                sums = np.bincount(spoken[ids[ids >= 0]], minlength=len(languages))
                held.append(pa.RecordBatch.from_arrays(
                    [languages, pa.nulls(len(sums), pa.string()), pa.array(np.zeros(len(sums), np.int32)), pa.array(sums.astype(np.int64))],
                    [*keys, "occurrences"]))
                for length, alive, _, hashes in _levels(ids, each, (word_bits.value, pair_bits.value), table, longest, 1):
                    one, two = _slots(hashes[alive], slots)
                    first, numbers = _runs(ids, hashes, alive[(table[one] == 0) & (table[two] == 0)], length)
                    spelled = [words.take(pa.array(ids[first + j])) for j in range(length)]
                    held.append(pa.RecordBatch.from_arrays([
                        languages.take(pa.array(spoken[ids[first]])), pc.binary_join_element_wise(*spelled, " ") if length > 1 else spelled[0],
                        pa.array(np.full(len(first), length, np.int32)), pa.array(numbers.astype(np.int64)),
                    ], [*keys, "occurrences"]))
                if sum(x.num_rows for x in held) > 500_000:
                    yield from summed()
        if held:
            yield from summed()

    named = materialize(
        packed.mapInArrow(tidy(name), "language string, phrase string, length int, occurrences long")
        .groupBy("language", "phrase", "length").agg(F.sum("occurrences").alias("occurrences")).where(
            (F.col("length") == 0) | (F.col("occurrences") >= threshold)), "candidates")
    shipped.destroy()
    word_bits.destroy()
    pair_bits.destroy()
    for used in (state, packed, *found):
        discard(used)
    return named.where("length > 0"), named.where("length = 0").select("language", F.col("occurrences").alias("n_words"))


def _joined(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    cases: DataFrame, threshold: int = 100, longest: int = 5, best: int = 2_000, absorb_percent: int = 100,
    shards: int = SHARDS, slots: int = SLOTS,
) -> DataFrame:
    """The phrases of each language whose words keep together most, from the texts of all cases.

    ``cases``: case_id, raw_text, language; other columns are ignored, whatever their
    names. A-Z are lower-cased; texts are split into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. Candidates have two to ``longest`` words and
    occur ``threshold`` times or more inside pieces, overlaps included. A candidate is cut
    in two where ``1000 * occurrences * n_words / (first * rest)``, floored, is least (of
    equals the shortest first part). A candidate inside a longer one that has
    ``absorb_percent`` of its occurrences or more is left out.

    Output, the ``best`` ones of each language (a top list is the purpose): language,
    rank (from 1; by score, occurrences, then the phrase in UTF-8 order), phrase,
    occurrences, first_occurrences, rest_occurrences, n_words, score. Null texts are
    empty, a null language is ``und``, repeated rows count again, an empty table gives an
    empty result. Products are decimals of 38 digits.
    """
    known, totals = count_phrases(cases, threshold, longest, shards, slots)
    words = F.split("phrase", " ")
    many = known.where("length > 1")
    cuts = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).withColumns({
        "first": _joined(words, F.lit(1), F.col("cut")), "rest": _joined(words, F.col("cut") + 1, F.col("length") - F.col("cut"))})
    for side in ("first", "rest"):
        cuts = cuts.join(known.select("language", F.col("phrase").alias(side), F.col("occurrences").alias(f"{side}_occurrences")), ["language", side])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("occurrences", "n_words", "first_occurrences", "rest_occurrences")}
    score = F.call_function(
        "div", wide["occurrences"] * wide["n_words"] * F.lit(1000).cast("decimal(4,0)"),
        wide["first_occurrences"] * wide["rest_occurrences"])
    loosest = (
        cuts.join(totals, "language").withColumn("score", score)
        .groupBy("language", "phrase", "length", "occurrences", "n_words")
        .agg(F.min(F.struct("score", "cut", "first_occurrences", "rest_occurrences")).alias("at"))
    )
    longer = known.where("length > 2").select("language", "occurrences", F.explode(F.array(
        _joined(words, F.lit(1), F.col("length") - 1), _joined(words, F.lit(2), F.col("length") - 1))).alias("phrase"))
    absorbing = longer.groupBy("language", "phrase").agg(F.max("occurrences").alias("in_longer"))
    free = loosest.join(absorbing, ["language", "phrase"], "left").where(
        F.col("in_longer").isNull() | (100 * F.col("in_longer") < absorb_percent * F.col("occurrences")))
    order = Window.partitionBy("language").orderBy(F.desc("at.score"), F.desc("occurrences"), "phrase")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select(
        "language", "rank", "phrase", "occurrences", F.col("at.first_occurrences").alias("first_occurrences"),
        F.col("at.rest_occurrences").alias("rest_occurrences"), "n_words", F.col("at.score").alias("score"))
