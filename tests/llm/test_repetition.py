import re
from collections import Counter

import numpy as np
import pytest

from docuvet.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    """Word by word, every n-gram a tuple."""
    text = text or ""
    words = WORD.findall(text)
    size = [len(w) for w in words]
    out = {"n_words": len(words), "word_chars": sum(size), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines, chars = lines + 1, chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    out |= {"n_dup_lines": lines, "dup_line_chars": chars}
    for n in range(2, 11):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        copies, before = Counter(grams), set()
        twice, later = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for i, g in enumerate(grams):
            twice[i:i + n] |= copies[g] > 1
            later[i:i + n] |= g in before
            before.add(g)
        if n == 3:
            out["n_repeat_words"] = int(twice.sum())
        if n >= 5:
            out[f"dup_{n}_chars"] = int(np.array(size)[later].sum()) if words else 0
        if n <= 4:
            out[f"top_{n}_chars"] = max([k * sum(map(len, g)) for g, k in copies.items() if k > 1], default=0)
    return out


TEXTS = [
    None, "", " \n\t\r", "a", "a a a a a a a a a a a a", "Photo Page\nPhoto Page\n\nPhoto Page \nphoto page", "x\r\nx\r\nx",
    "é日本 #1 * 50% <b>é日本</b>", "a b\tc\x0bd\x0ce  f a b c d e f a b c d e f", "one two three four five\n" * 40,
    "no-break space no-break space no-break space",
]


@pytest.fixture(scope="module")
def measured(spark, sf_dir, cases):
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = list(enumerate(TEXTS + given)) + [(None, "nobody"), (3, "a"), (3, "a")]
    return rows, repetition.repetition_quality(cases(rows)).collect()


def test_equal_to_counting_by_hand(measured):
    rows, got = measured
    assert len(got) == len(rows)
    want = sorted(((i, by_hand(t)) for i, t in rows), key=str)
    names = list(want[0][1])
    assert sorted(((r.case_id, {c: r[c] for c in names}) for r in got), key=str) == want


def test_verdict(cases):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    clean = " ".join(rng.choice(words, 300))
    rows = [(1, clean), (2, " ".join(["renew your permit here today now"] * 30)), (3, clean + "\n" + clean), (4, None),
            (5, "Republic of Utopia passport office\n" + clean + "\nRepublic of Utopia passport office")]
    got = {r.case_id: (r.kept, list(r.failed)) for r in repetition.repetition_quality(cases(rows)).collect()}
    assert {k for k, (kept, _) in got.items() if kept} == {1, 4, 5}
    assert "dup_10_chars" in got[2][1] and "dup_5_chars" in got[3][1] and got[4][1] == []


def test_hash_collisions_are_found_and_hashed_anew(monkeypatch):
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    real = repetition.mix
    monkeypatch.setattr(repetition, "mix", lambda v, seed=0: real(v // 2 if seed == 0 else v, seed))  # words 2 and 3 collide at first
    placed, first, runs = repetition._equal_windows(ids, np.zeros(9, np.int64), np.arange(7), 3)
    assert sorted(placed[f] for f, n in zip(first, runs) if n > 1) == [0]


def test_very_long_text_empty_table_and_clashing_columns(cases):
    text = " ".join(str(i % 5_000) for i in range(400_000))
    row = repetition.repetition_quality(cases([(1, text, True)], "case_id long, raw_text string, kept boolean")).first()
    assert (row.n_words, row.kept) == (400_000, False) and row.n_repeat_words == 400_000
    assert repetition.repetition_quality(cases([])).count() == 0
