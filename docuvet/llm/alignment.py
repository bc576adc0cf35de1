"""Alignment of two tokenizers over case texts: fragments that compose, and counts of linked ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .support import kept_in_process, ragged, text_rows, tidy

#: Bytes of a fragment; longer texts are cut into ranges of this size, wherever they end.
RANGE_BYTES = 1 << 16
#: Fragments that one composition takes.
FAN = 16
#: Bytes of text that share one table of links.
BATCH_BYTES = 2 << 20
#: Distinct units that a worker remembers at once.
REMEMBERED = 150_000
#: Units that one line of a tokenizer's input holds.
TOGETHER = 200
#: Groups with more links are linked id by id, not token by token.
WIDE = 4_096


def _spelled_bytes() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Ids, groups and links of texts through their distinct units.

    A unit ends before a single space between two characters that are not white space.
    Neither tokenizer joins what such a space separates (:func:`__init__` checks both
    vocabularies for it), so the tokens of a text are those of its units.
    """

    def __init__(self, byte_level_path: str, piece_path: str):
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_file(byte_level_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        setup = json.loads(self.first.to_str())
        if setup["pre_tokenizer"]["type"] != "ByteLevel" or not setup["pre_tokenizer"]["use_regex"] or setup["normalizer"]:
            raise ValueError("the first tokenizer must be byte-level and split before spaces")
        spelled = _spelled_bytes()
        self.first_bytes = [b""] * (max(self.first.get_vocab().values()) + 1)
        for token, i in self.first.get_vocab(with_added_tokens=False).items():
            self.first_bytes[i] = bytes(spelled[c] for c in token)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece joins what a space separates")
        self.second_bytes = [
            b"" if self.second.is_control(i) or self.second.is_unknown(i)
            else bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)]
        self.first_sizes = np.array(list(map(len, self.first_bytes)), np.int64)
        self.second_sizes = np.array(list(map(len, self.second_bytes)), np.int64)
        self.width = len(self.second_bytes)
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        #: unit: numbers of first ids, second ids, groups, links; the groups in writing; pairs and how often each is linked
        self.known: dict[str, tuple | None] = {}
        #: units that were met in more than one batch
        self.again: set[str] = set()

    @classmethod
    def of(cls, byte_level_path: str, piece_path: str) -> Aligner:
        return kept_in_process(("aligner", byte_level_path, piece_path), lambda: cls(byte_level_path, piece_path))

    def learn(self, units: list[str]) -> None:
        """Tokenize new units and remember their groups; a unit that its tokens do not spell is remembered as None.

        Units that neither start nor end in white space are tokenized many to a line, as a
        space separates them like in a text; the others one by one.
        """
        odd = [u for u in units if u[0].isspace() or u[-1].isspace()]
        if odd:
            skip = set(odd)
            units = [u for u in units if u not in skip]
            self._learn(odd, 1)
        if units:
            self._learn(units, TOGETHER)

    def _learn(self, units: list[str], together: int) -> None:
        raw = [(" " + u).encode() for u in units]
        lines = [" ".join(units[i:i + together]) for i in range(0, len(units), together)]
        first = [e.ids for e in self.first.encode_batch_fast([" " + line for line in lines], add_special_tokens=False)]
        second = self.second.encode(lines, num_threads=1)
        whole = b"".join(raw)
        spell_first, spell_second = self.first_bytes.__getitem__, self.second_bytes.__getitem__
        flat = [np.fromiter(chain.from_iterable(side), np.int64) for side in (first, second)]
        ends = [np.cumsum(s[f]) for s, f in zip((self.first_sizes, self.second_sizes), flat)]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))

        def closes(side: np.ndarray) -> bool:
            """Do this side's tokens end where units end?"""
            at = np.searchsorted(side, stops)
            return len(side) > 0 and at[-1] < len(side) and np.array_equal(side[at], stops) and side[-1] == stops[-1]

        if not (closes(ends[0]) and closes(ends[1]) and b"".join(map(spell_first, flat[0].tolist())) == whole
                and b"".join(map(spell_second, flat[1].tolist())) == whole):
            if together > 1:  # find the units that are not spelled
                return self._learn(units, 1)
            good = [b"".join(map(spell_first, a)) == r == b"".join(map(spell_second, b)) for a, b, r in zip(first, second, raw)]
            self.known.update((u, None) for u, g in zip(units, good) if not g)
            if any(good):
                self._learn([u for u, g in zip(units, good) if g], 1)
            return
        counts = [np.bincount(np.searchsorted(stops, e), minlength=len(units)) for e in ends]
        shared = np.intersect1d(*ends)
        group = [np.searchsorted(shared, e) for e in ends]
        n = [np.bincount(g, minlength=len(shared)) for g in group]
        start = [np.cumsum(x) - x for x in n]
        unit = np.searchsorted(stops, shared)
        links = n[0] * n[1]
        narrow = np.where(links <= WIDE, links, 0)
        of = np.repeat(np.arange(len(shared)), narrow)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(narrow) - narrow, narrow)
        pair = flat[0][start[0][of] + inside // n[1][of]] * self.width + flat[1][start[1][of] + inside % n[1][of]]
        owner, often = unit[of], np.ones(len(of), np.int64)
        for g in np.flatnonzero(links > WIDE).tolist():
            a, many_a = np.unique(flat[0][start[0][g]:start[0][g] + n[0][g]], return_counts=True)
            b, many_b = np.unique(flat[1][start[1][g]:start[1][g] + n[1][g]], return_counts=True)
            pair = np.concatenate([pair, (a[:, None] * self.width + b).ravel()])
            often = np.concatenate([often, (many_a[:, None] * many_b).ravel()])
            owner = np.concatenate([owner, np.full(len(a) * len(b), unit[g])])
        order = np.lexsort([pair, owner])
        owner, pair, often = owner[order], pair[order], often[order]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])]))
        often = np.add.reduceat(often, head)
        owner, pair = owner[head], pair[head]
        edges = np.searchsorted(owner, np.arange(len(units) + 1)).tolist()
        groups = np.bincount(unit, minlength=len(units))
        linked = np.bincount(unit, links, len(units)).astype(np.int64)
        names = [list(map(str, f.tolist())) for f in flat]
        written = [
            f"{','.join(names[0][a:a + i])}|{','.join(names[1][b:b + j])}"
            for a, i, b, j in zip(*(x.tolist() for x in (start[0], n[0], start[1], n[1])))]
        at = (np.cumsum(groups) - groups).tolist()
        rows = zip(units, counts[0].tolist(), counts[1].tolist(), groups.tolist(), linked.tolist(), at, edges[:-1], edges[1:])
        pairs, oftens = pair.tobytes(), often.tobytes()
        for u, n_a, n_b, n_groups, n_links, g, lo, hi in rows:
            told = written[g] if n_groups == 1 else ";".join(written[g:g + n_groups])
            self.known[u] = (n_a, n_b, n_groups, n_links, told.encode(), pairs[8 * lo:8 * hi], oftens[8 * lo:8 * hi])

    def align(self, texts: list[str]) -> dict:
        """Counts, written groups and the link tables of many texts; an empty text has no units."""
        if len(self.known) > REMEMBERED:  # most units never come again
            self.known = {u: self.known[u] for u in self.again}
            self.again = set()
        split = [self.cut.split(t) if t else [] for t in texts]
        place: defaultdict[str, int] = defaultdict(count().__next__)
        rows = [np.fromiter(map(place.__getitem__, units), np.int64, len(units)) for units in split]
        del split
        new = [u for u in place if u not in self.known]
        self.again.update(self.known.keys() & place.keys())
        for lo in range(0, len(new), 50_000):
            self.learn(new[lo:lo + 50_000])
        found = [self.known[u] for u in place]
        spelled = np.array([e is not None for e in found], bool)
        found = [e or (0, 0, 0, 0, b"", b"", b"") for e in found]
        columns = list(zip(*found)) if found else [()] * 7
        per_unit = np.array(columns[:4], np.int64).T
        written = columns[4]
        valid = np.array([len(r) > 0 and bool(spelled[r].all()) for r in rows], bool)
        rows = [r if v else r[:0] for r, v in zip(rows, valid)]
        sizes = np.array(list(map(len, rows)), np.int64)
        text = np.repeat(np.arange(len(rows)), sizes)
        units = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(per_unit[units], axis=0)])
        stop = np.cumsum(sizes)
        both, often = np.unique(text * max(len(found), 1) + units, return_counts=True)
        pairs = np.frombuffer(b"".join(columns[5]), np.int64)
        pair_names, pair_of = np.unique(pairs, return_inverse=True)
        return {
            "valid": valid, "counts": sums[stop] - sums[stop - sizes],
            "written": lambda i: b";".join(map(written.__getitem__, rows[i].tolist())),
            "text": both // max(len(found), 1), "unit": both % max(len(found), 1), "often": often,
            "unit_pairs": np.fromiter(map(len, columns[5]), np.int64, len(found)) // 8, "pair_of": pair_of,
            "pair_often": np.frombuffer(b"".join(columns[6]), np.int64), "pairs": pair_names,
        }


def split_ranges(text: str, size: int) -> list[str]:
    """A text in ranges of about ``size`` bytes that end between characters, with no regard to words."""
    raw, out, start = text.encode(), [], 0
    while start < len(raw):
        end = min(start + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        out.append(raw[start:end].decode())
        start = end
    return out


def fragment(text: str, cut: re.Pattern) -> tuple[str, str, str | None]:
    """Open prefix, closed middle, open suffix of a range; without a cut all is prefix and the suffix is None."""
    parts = cut.split(text)
    return (text, "", None) if len(parts) == 1 else (parts[0], " ".join(parts[1:-1]), parts[-1])


def compose(left: tuple[str, str | None], right: tuple[str, str | None], cut: re.Pattern) -> tuple[tuple[str, str | None], str]:
    """Two neighbouring fragments (prefix, suffix) as one, and the text that closes between them.

    Associative: however neighbours are put together, the same units close, because
    units depend only on the characters around a cut.
    """
    seam = cut.split((left[0] if left[1] is None else left[1]) + right[0])
    opens, ends = left[1] is None, right[1] is None
    closed = seam[1 if opens else 0: len(seam) - (1 if ends else 0)]
    if opens and ends and len(seam) == 1:
        return (seam[0], None), ""
    return (seam[0] if opens else left[0], seam[-1] if ends else right[1]), " ".join(closed)


_FRAGMENT = "row long, level_index long, begin long, prefix string, suffix string, place long, closed string"


def _long_texts(cases: DataFrame, key_type: str, range_bytes: int, fan: int):
    """Long texts as pieces that may be tokenized apart: row, place (their order), raw_text; and the case_id of each row.

    Ranges become fragments, a tree of compositions closes the units between them, level
    by level in Spark tasks; what stays open at the root is closed by the text's ends.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pieces = split_ranges(batch.column("raw_text")[i].as_py(), range_bytes)
                for lo in range(0, len(pieces), 64):
                    part = pieces[lo:lo + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column("row")[i].as_py()] * len(part), pa.int64()),
                        pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part, pa.string())], ["row", "begin", "raw_text"])

    def columns(rows: list[tuple]) -> list[pa.Array]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]

    names = [x.split()[0] for x in _FRAGMENT.split(", ")]

    def open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(r"(?<=\S) (?=\S)")
        for batch in batches:
            rows = []
            for row, begin, text in zip(*(batch.column(c).to_pylist() for c in ("row", "begin", "raw_text"))):
                prefix, closed, suffix = fragment(text, cut)
                rows.append((row, begin, begin, prefix, suffix, 2 * begin, closed or None))
            yield pa.RecordBatch.from_arrays(columns(rows), names)

    def reduce(table: pa.Table) -> pa.Table:
        cut = re.compile(r"(?<=\S) (?=\S)")
        whole, out = None, []
        for x in sorted(table.to_pylist(), key=lambda x: x["begin"]):
            if whole is None:
                row, index, begin, whole = x["row"], x["level_index"], x["begin"], (x["prefix"], x["suffix"])
                continue
            whole, closed = compose(whole, (x["prefix"], x["suffix"]), cut)
            if closed:
                out.append((row, None, None, None, None, 2 * x["begin"] - 1, closed))
        out.append((row, index // fan, begin, *whole, None, None))
        return pa.Table.from_arrays(columns(out), names)

    rows = materialize(cases.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = rows.mapInArrow(tidy(ranges), "row long, begin long, raw_text string")
    level = materialize(parts.repartition("row", "begin").mapInArrow(tidy(open_ends), _FRAGMENT), "fragments")
    closed = level.where("closed is not null")
    most = level.agg(F.max("begin")).first()[0] or 0
    while most > 0:
        level = level.where("level_index is not null").groupBy("row", F.floor(F.col("level_index") / fan).alias("parent")).applyInArrow(
            tidy(reduce), _FRAGMENT)
        level = materialize(level, "fragments")
        closed = closed.unionByName(level.where("closed is not null"))
        most //= fan
    roots = level.where("level_index is not null").select("row", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("place"), F.col("prefix").alias("closed")),
        F.struct(F.lit(2**62).alias("place"), F.col("suffix").alias("closed")))).alias("at")).select("row", "at.*").where("closed <> ''")
    pieces = closed.select("row", "place", "closed").unionByName(roots).withColumnRenamed("closed", "raw_text")
    return pieces, rows.select("row", "case_id")


_BATCH = (
    "batch long, case_ids array<{key}>, rows array<long>, places array<long>, valid array<boolean>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, hashes array<string>, written array<binary>, tables array<binary>, "
    "a array<int>, b array<int>, cases array<long>, long_rows array<long>, long_pairs array<long>")
_SCORED = (
    "case_id {key}, row long, place long, valid boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, written binary")


def align_cases(
    cases: DataFrame, byte_level_path: str, piece_path: str, range_bytes: int = RANGE_BYTES, batch_bytes: int = BATCH_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """Where two tokenizers agree in each case text, and how usual the id pairs are that they put together.

    ``cases``: case_id, raw_text; other columns are ignored, whatever their names. The
    first tokenizer is a byte-level BPE file, applied to a space and the text; the second
    a SentencePiece model with byte fallback, which puts that space itself. Special
    tokens are neither added nor recognised. Byte offsets where tokens of both end cut
    a text into groups; each token of one side is linked with each of the other in its
    group. The count of an id pair is the number of rows with such a link.

    Output, one row per input row: case_id, n_a, n_b, n_groups, n_links, n_best (links
    whose count is the highest of their first id, ties included), count_sum (counts over
    all links), groups_sha256 (of ``a1,a2|b1;a3|b2``). Texts that are null or empty, or
    that the tokens of one side do not spell, have zeros and an empty string. Repeated
    rows count again; an empty table gives an empty result. Files must be readable on
    executors.

    Texts over ``range_bytes`` are cut anywhere into ranges; each becomes a fragment of
    open prefix, closed part and open suffix, which a tree of associative compositions
    puts together across tasks. Links of a batch of texts are stored as one table of its
    distinct units; only its distinct pairs are shuffled, to be summed and to learn their
    counts. The hash of a long text is folded over its pieces in order, in constant memory.
    """
    key = cases.schema["case_id"].dataType.simpleString()
    texts = cases.select("case_id", F.coalesce(F.col("raw_text").cast("string"), F.lit("")).alias("raw_text"))
    is_long = F.octet_length("raw_text") > range_bytes
    pieces, long_cases = _long_texts(texts.where(is_long), key, range_bytes, fan)
    none = F.lit(None)
    entries = texts.where(~is_long).select("case_id", none.cast("long").alias("row"), none.cast("long").alias("place"), "raw_text").unionByName(
        pieces.select(none.cast(key).alias("case_id"), "row", "place", "raw_text"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(byte_level_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            kind = batch.schema.field("case_id").type
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("raw_text")], ["at", "raw_text"])
            for at, raw in text_rows([numbered], "at", "raw_text", batch_bytes):
                found = aligner.align([t.decode() for t in raw])
                case_ids, rows, places = (batch.column(c).take(pa.array(at)).to_pylist() for c in ("case_id", "row", "place"))
                whole = np.array([r is None for r in rows], bool)
                hashes, written = [], []
                for i, valid in enumerate(found["valid"].tolist()):
                    groups = found["written"](i) if valid else b""
                    hashes.append(hashlib.sha256(groups).hexdigest() if valid and whole[i] else "")
                    written.append(None if whole[i] else groups)
                # in how many texts of this batch is each pair linked
                unit_pairs = found["unit_pairs"]
                first = np.cumsum(unit_pairs) - unit_pairs
                spread = found["pair_of"][ragged(first[found["unit"]], unit_pairs[found["unit"]])]
                text = np.repeat(found["text"], unit_pairs[found["unit"]])
                n_pairs = max(len(found["pairs"]), 1)
                once = np.unique(text * n_pairs + spread)
                in_whole = whole[once // n_pairs]
                cases_with = np.bincount(once[in_whole] % n_pairs, minlength=len(found["pairs"]))
                apart = once[~in_whole]
                row_of = np.array([-1 if r is None else r for r in rows], np.int64)
                tables = [x.astype(np.int32).tobytes() for x in (found["text"], found["unit"], found["often"], unit_pairs, found["pair_of"])]
                tables.append(found["pair_often"].astype(np.int64).tobytes())
                codec = pa.Codec("zstd", 1)
                sizes = np.array([len(x) for x in tables], np.int64).tobytes()
                packed = [sizes, *(codec.compress(x, asbytes=True) if x else b"" for x in tables)]
                counts = found["counts"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([case_ids], pa.list_(kind)), pa.array([rows], pa.list_(pa.int64())),
                    pa.array([places], pa.list_(pa.int64())), pa.array([found["valid"].tolist()], pa.list_(pa.bool_())),
                    *(pa.array([counts[:, c]], pa.list_(pa.int64())) for c in range(4)),
                    pa.array([hashes], pa.list_(pa.string())), pa.array([written], pa.list_(pa.binary())),
                    pa.array([packed], pa.list_(pa.binary())),
                    pa.array([(found["pairs"] // aligner.width).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([(found["pairs"] % aligner.width).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([cases_with.astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([row_of[apart // n_pairs]], pa.list_(pa.int64())),
                    pa.array([found["pairs"][apart % n_pairs] if len(apart) else np.zeros(0, np.int64)], pa.list_(pa.int64())),
                ], names)
                number += 1

    names = [x.split()[0] for x in _BATCH.split(", ")]
    batches = materialize(entries.mapInArrow(tidy(link), _BATCH.format(key=key)), "aligned")
    broken = batches.select(F.explode(F.arrays_zip("rows", "valid")).alias("x")).where("x.rows is not null and not x.valid").select(
        F.col("x.rows").alias("row")).distinct()

    width = _pieces(piece_path)
    pair = F.col("x.a").cast("long") * width + F.col("x.b")
    whole = batches.select(F.explode(F.arrays_zip("a", "b", "cases")).alias("x")).where("x.cases > 0").select(
        pair.alias("pair"), F.col("x.cases").alias("n"))
    apart = batches.select(F.explode(F.arrays_zip("long_rows", "long_pairs")).alias("x")).select(
        F.col("x.long_rows").alias("row"), F.col("x.long_pairs").alias("pair")).distinct().join(broken, "row", "left_anti")
    counted = whole.unionByName(apart.select("pair", F.lit(1).cast("long").alias("n"))).groupBy("pair").agg(F.sum("n").alias("cases"))
    counted = materialize(counted, "pairs")
    a = F.floor(F.col("pair") / F.lit(width).cast("long"))
    best = counted.groupBy(a.alias("a")).agg(F.max("cases").alias("most"))
    weights = counted.withColumn("a", a).join(best, "a").select("pair", "cases", (F.col("cases") == F.col("most")).alias("best"))
    asked = batches.select(F.col("batch").alias("asking"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "x")).select(
        "asking", "at", pair.alias("pair"))
    answers = asked.join(weights, "pair").select("asking", "at", "cases", "best")
    scored_names = [x.split()[0] for x in _SCORED.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        sizes, *packed = row["tables"].as_py()
        codec = pa.Codec("zstd", 1)
        raw = [codec.decompress(x, int(n), asbytes=True) if n else b"" for x, n in zip(packed, np.frombuffer(sizes, np.int64))]
        text, unit, often, unit_pairs, pair_of = (np.frombuffer(x, np.int32).astype(np.int64) for x in raw[:5])
        pair_often = np.frombuffer(raw[5], np.int64)
        values = np.zeros((2, len(row["a"])), np.int64)  # pairs of broken texts alone have no count
        at = right.column("at").to_numpy()
        values[0, at] = right.column("best").to_numpy(zero_copy_only=False)
        values[1, at] = right.column("cases").to_numpy()
        edge = np.concatenate([[0], np.cumsum(unit_pairs)])
        sums = []
        for value in values:
            run = np.concatenate([[0], np.cumsum(pair_often * value[pair_of])])
            total = np.zeros(len(row["rows"]), np.int64)
            np.add.at(total, text, often * (run[edge[1:]] - run[edge[:-1]])[unit])
            sums.append(pa.array(total))
        flat = [row[c].values for c in ("case_ids", "rows", "places", "valid", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*flat, *sums, row["hashes"].values, row["written"].values], scored_names)

    scored = batches.drop("cases", "long_rows", "long_pairs", "b").groupBy("batch").cogroup(answers.groupBy("asking")).applyInArrow(
        lambda left, right: tidy(lambda t: score(t, right))(left), _SCORED.format(key=key))
    scored = materialize(scored, "scored")
    result = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    short = scored.where("row is null").select("case_id", *result, "groups_sha256")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash over the pieces of each row; they come sorted."""
        current, digest = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for row, written in zip(batch.column("row").to_pylist(), batch.column("written")):
                if row != current:
                    if current is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = row, hashlib.sha256()
                else:
                    digest.update(b";")
                digest.update(written.as_py())
        if current is not None:
            done.append((current, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], ["row", "groups_sha256"])

    long = scored.where("row is not null")
    hashed = long.select("row", "place", "written").repartition("row").sortWithinPartitions("row", "place").mapInArrow(
        tidy(fold), "row long, groups_sha256 string")
    sums = long.groupBy("row").agg(*[F.sum(c).alias(c) for c in result])
    told = sums.join(hashed, "row").join(broken.withColumn("broken", F.lit(True)), "row", "left")
    spoilt = F.col("broken").isNotNull()
    told = long_cases.join(told, "row").select(
        "case_id", *[F.when(spoilt, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in result],
        F.when(spoilt, F.lit("")).otherwise(F.col("groups_sha256")).alias("groups_sha256"))
    return short.unionByName(told)


def _pieces(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
