import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docuvet.llm import language, ppm, scoring


def nats(train, order, texts):
    """Partial matching by the book: dictionaries, escapes and exclusion, symbol by symbol."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        raw = bytes([255] * order) + text + b"\xff"
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen[k][raw[i - k:i]][raw[i]] += 1
    out = []
    for text in texts:
        raw, total = bytes([255] * order) + text + b"\xff", 0.0
        for i in range(order, len(raw)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                counts = {s: n for s, n in seen[k].get(raw[i - k:i], {}).items() if s not in excluded}
                n, d = sum(counts.values()), len(counts)
                if raw[i] in counts:
                    p *= counts[raw[i]] / (n + d)
                    break
                if d:
                    p *= d / (n + d)
                    excluded |= set(counts)
            else:
                p /= 256 - len(seen[0][b""])
            total -= math.log(p)
        out.append(total)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_frozen_tables_give_exact_code_lengths(order):
    rng = random.Random(order)
    train = [bytes(rng.choice(b"abcde ") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [b""]
    texts = train[:5] + [b"", b"zz top abc", "ab é cd".encode()]
    codes, counts = ppm.gram_counts(iter([train[:9], train[9:]]), order)
    levels = ppm.levels_of(codes.astype(np.int64), counts.astype(float), order)
    model = ppm.freeze(levels, np.unique(np.append(codes & 255, ppm.END)).astype(int), order)
    assert np.allclose(ppm.code_lengths(model, texts)[:, 0], nats(train, order, texts), atol=1e-4)


def test_slices_do_not_change_code_lengths(monkeypatch):
    texts = [b"abc" * 40, b"", b"x" * 300]
    codes, counts = ppm.gram_counts(iter([texts]))
    model = ppm.freeze(ppm.levels_of(codes.astype(np.int64), counts.astype(float)), np.unique(np.append(codes & 255, ppm.END)).astype(int))
    whole = ppm.code_lengths(model, texts)
    monkeypatch.setattr(ppm, "SLICE", 17)
    assert np.allclose(whole, ppm.code_lengths(model, texts))


SCHEMA = "case_id long, raw_text string, language string"
WORDS = {"en": "the name of holder is given on this page and valid until".split(),
         "de": "der name des inhabers steht auf dieser seite und gilt bis zum".split()}


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS[l]) for _ in range(30)), l) for i, l in enumerate(["en", "de"] * 60)]


def test_lookup_finds_every_code_and_no_other():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 40, 5000))
    table = ppm.Lookup.of(codes, np.arange(len(codes), dtype=np.int32))
    asked = np.concatenate([codes, codes + 1, rng.integers(0, 1 << 40, 5000)])
    want = {c: i for i, c in enumerate(codes.tolist())}
    assert table.find(asked, np.full(len(asked), -7)).tolist() == [want.get(c, -7) for c in asked.tolist()]


def test_languages_of_unseen_texts_and_undetermined_ones(cases, labelled):
    asked = [(1, "the holder of this page", "x"), (2, "seite des inhabers", "x"), (3, None, "x"), (4, "12 34 ..", "x"), (5, "", "x"),
             (None, "the name is given", "x"), (1, "the holder of this page", "x")]
    got = language.identify_language(cases(asked, SCHEMA), cases(labelled, SCHEMA)).collect()
    assert [(r.case_id, r.language) for r in got] == [
        (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got[2:5]] == [0.0] * 3


def test_language_without_training_rows_and_without_rows(cases, labelled):
    some = cases(labelled[:4], SCHEMA)
    assert {r.language for r in language.identify_language(some, some.limit(0)).collect()} == {"und"}
    assert language.identify_language(some.limit(0), some).count() == 0
    kept = language.identify_language(some, some, keep=["language", "raw_text"]).collect()
    assert [(r.kept_language, r.kept_raw_text) for r in kept] == [(l, t) for _, t, l in labelled[:4]]


def test_held_out_accuracy_on_the_documents_table(spark, sf_dir):
    from docuvet.llm.catalogue import op4_language_id

    found = op4_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = [r.lang == r.lang_pred for r in found.where("held_out").join(truth, "doc_id").collect()]
    assert len(right) > 20 and sum(right) / len(right) >= 0.97


def test_scores_match_brute_force(cases, monkeypatch):
    monkeypatch.setattr(scoring, "BATCH_BYTES", 600)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Name", "Passport", "NO", "x1", "é"]) for _ in range(rng.randint(0, 30))), i % 4 != 2) for i in range(60)]
    rows += [(100, None, True), (101, "", False), (102, "unseen words \t here", None), (5, rows[5][1], True), (None, "Name", False)]
    got = scoring.score_cases(cases(rows, "case_id long, raw_text string, trains boolean")).collect()
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in low]
    count, ends = Counter(), 0
    for w, (_, _, trains) in zip(words, rows):
        if trains:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    plain = [" ".join(w).encode() for w in words]
    lengths = nats([t for t, r in zip(plain, rows) if r[2]], scoring.ORDER, plain)
    want = sorted((len(w) + 1, sum(count[x] > 0 for x in w) + 1, n,
                   sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)),
                   -s / math.log(10)) for w, s in zip(words, lengths))
    have = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-5)


def test_scores_without_training_texts_and_without_rows(cases):
    schema = "case_id long, raw_text string, trains boolean, score string"
    got = scoring.score_cases(cases([(1, "ab", False, "x")], schema)).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.score == pytest.approx(-3 * math.log10(256), rel=1e-5)
    assert scoring.score_cases(cases([], schema)).count() == 0


def test_language_models_keep_eight_thousand_contexts_a_length():
    codes = (np.arange(1 << 13) << 8) | 97
    levels = ppm.levels_of(codes, np.ones(len(codes)), 3, language.MAX_CONTEXTS)
    assert len(levels[3][0]) == 1 << 13


def test_scores_use_every_context_of_the_training_texts(cases):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(12)]
    asked = texts[0][:300]
    rows = [*((i, t, True) for i, t in enumerate(texts)), (99, asked, False)]
    got = scoring.score_cases(cases(rows, "case_id long, raw_text string, trains boolean")).where("case_id = 99").first()
    (want,) = nats([t.encode() for t in texts], scoring.ORDER, [asked.encode()])
    assert got.score == pytest.approx(-want / math.log(10), rel=1e-5)
