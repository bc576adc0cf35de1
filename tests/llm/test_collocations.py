import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docuvet.llm import collocations

SCHEMA = "case_id long, raw_text string, language string"


def by_hand(rows, threshold, best):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, language in rows:
        language = language or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[language] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[language][tuple(words[i:i + n])] += 1
    out = []
    for language, own in counts.items():
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in frequent.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if not inside:
                n = totals[language]
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]], n))
        out += [(language, rank, p.decode(), -a, left, right, n, -score)
                for rank, (score, a, p, left, right, n) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def found(table, **options):
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = ["no", "of", "the", "Passport", "visa", "é", "日本", "date", "birth", "X"]
    fixed = ["date of birth", "place of issue", "Republic of Utopia, passport", "a a a a a a a", "x\ty  z", "\r\nno. 12!x"]
    out = []
    for i in range(400):
        text = " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.integers(1, 40)))
        out.append((i, text, str(rng.choice(["en", "fr"]))))
    return [*out, (None, "date of birth", None), (1, None, "en"), (2, "", None), (7, "a a", "en"), (7, "a a", "en")] + [
        (9, "left alone " * 30, None)]


@pytest.mark.parametrize("options", [{}, {"shards": 7}, {"shards": 1, "slots": 1 << 10}, {"slots": 2}])
def test_equal_to_counting_everything(spark, rows, options):
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(table, threshold=20, best=15, **options) == by_hand(rows, 20, 15)


def test_nothing_frequent_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([(1, "a b", "en")], SCHEMA)) == []
    assert found(spark.createDataFrame([], SCHEMA)) == []
    odd = spark.createDataFrame([(i, "left alone", "en", 1, "x") for i in range(5)], SCHEMA + ", hash int, phrase string")
    assert found(odd, threshold=5) == [("en", 1, "left alone", 5, 5, 5, 10, 2000)]


def test_a_very_long_text(spark):
    rows = [(1, "visa granted " * 60_000, "en")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows, 100, 2_000)


def test_products_past_64_bits_stay_exact(spark):
    table = spark.createDataFrame([(3_000_000_000_000_000_001, 4_000_000_000_000_000_003, 7, 11)], "a long, n long, l long, r long")
    wide = {c: table[c].cast("decimal(19,0)") for c in "anlr"}
    from pyspark.sql import functions as F

    got = table.select(F.call_function("div", wide["a"] * wide["n"], wide["l"] * F.lit(10**18).cast("decimal(19,0)") * wide["r"])).first()[0]
    assert got == 3_000_000_000_000_000_001 * 4_000_000_000_000_000_003 // (77 * 10**18)


def test_slots_come_to_the_driver_as_bits(spark, monkeypatch):
    """Neither words, pairs nor phrases come as rows: of any number of slots the driver sees pages of bits."""
    slots = spark.range(200_000).selectExpr("cast(id * 7 % 100003 as int) as slot")
    bits = np.unpackbits(collocations.marked_slots(slots, 1 << 17), bitorder="little")
    assert bits.sum() == 100_003 and bits[:100_003].all()
    came = []
    frame = type(slots)
    to_arrow = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: came.append(to_arrow(self)) or came[-1])
    monkeypatch.setattr(frame, "toPandas", None)
    rows = [(i, " ".join(f"w{(i + k) % 2000}" for k in range(30)), "en") for i in range(2000)]
    found(spark.createDataFrame(rows, SCHEMA), threshold=5, slots=1 << 15)
    assert len(came) > 3 and all(t.column_names == ["page", "bits"] for t in came)
    assert all(t.num_rows <= collocations.PART_SLOTS // collocations.PAGE_SLOTS for t in came)
