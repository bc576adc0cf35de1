import random

import numpy as np
import pytest

from docuvet.llm import repeats


def brute(rows, window):
    """What is left of each text, and how many runs went."""
    seen, out = set(), {}
    for case, text in sorted(rows):
        raw = (text or "").encode()
        mark = np.zeros(len(raw), bool)
        for at in range(len(raw) - window + 1):
            piece = raw[at:at + window]
            if piece in seen:
                mark[at:at + window] = True
            seen.add(piece)
        runs = int((mark & ~np.concatenate(([False], mark[:-1]))).sum())
        out[case] = (len(raw), int(mark.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~mark]))
    return out


def cut(cases, rows, window, **options):
    found = repeats.remove_repeats(cases(rows), window, **options).collect()
    return {r.case_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = "".join(rng.choice("ab é") for _ in range(3000))
    mixed = [(i, "".join(base[(a := rng.randint(0, 2800)):a + rng.randint(0, 300)] for _ in range(5))) for i in range(40)]
    return mixed + [(100, None), (101, ""), (102, "a" * 1000), (103, "a" * 500), (104, "ab" * 700), (105, "short")]


def test_removes_exactly_what_also_starts_earlier(cases, rows):
    assert cut(cases, rows, 100) == brute(rows, 100)


def test_shards_are_merged(cases, rows):
    assert cut(cases, rows, 40, gram=8, shard_bytes=500) == brute(rows, 40)


def test_only_shards_that_share_an_anchor_are_merged(monkeypatch):
    rng = random.Random(8)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    data = np.frombuffer(base + base[:1500] + base[700:2500], np.uint8)
    starts, windows, hashes = repeats.anchored_runs(data, np.array([0, len(data)]), 40, 8)
    passages = np.concatenate([data[a:a + n + 39] for a, n in zip(starts, windows)])
    places = np.column_stack([np.zeros((len(starts), 2), np.int64), starts])
    want = repeats.resolve(hashes, windows, places, passages, 40)
    assert len(want)

    def unneeded(self, other):
        raise AssertionError("shards without a common anchor were merged")

    monkeypatch.setattr(repeats.Shard, "merge", unneeded)
    most = max(windows[hashes == h].sum() + 39 * (hashes == h).sum() for h in np.unique(hashes))
    assert (repeats.resolve(hashes, windows, places, passages, 40, int(most)) == want).all()


def test_frequent_anchors_change_nothing(cases, rows, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST", 2)
    monkeypatch.setattr(repeats, "FREQUENT", 0.0)
    assert cut(cases, rows, 100) == brute(rows, 100)


def test_text_longer_than_a_part(cases, monkeypatch):
    monkeypatch.setattr(repeats, "POSITIONS", 1 << 10)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, text), (2, text[700:3200] + "x" + text[3300:])]
    assert cut(cases, rows, 100) == brute(rows, 100)


def test_repeated_rows_missing_ids_and_clashing_columns(cases):
    page = "identity page " * 20
    rows = [(1, page, "k"), (1, page, "k"), (None, page, "k")]
    found = repeats.remove_repeats(cases(rows, "case_id long, raw_text string, kept string")).collect()
    # equal rows are one text; the text without a case comes last
    assert sorted((r.case_id or 0, r.n_removed == len(page)) for r in found) == [(0, True), (1, False), (1, False)]
    assert repeats.remove_repeats(cases([])).count() == 0


def test_equal_rows_with_partly_repeated_texts_stay_one_text(cases):
    rng = random.Random(6)
    words = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    part = words(150)
    rows = [(1, words(90) + part + words(90)), (2, words(70) + part + words(60))]
    for shard_bytes in (4 << 20, 300):
        got = cut(cases, [*rows, *rows], 100, shard_bytes=shard_bytes)
        assert got == brute(rows, 100)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab") for _ in range(700))
    data = np.frombuffer(raw, np.uint8)
    order, _ = repeats.suffix_order(data, 700)
    assert order.tolist() == sorted(range(700), key=lambda i: raw[i:])
    shared = repeats.common_prefixes(data, order, 100)
    for before, at, got in zip(order, order[1:], shared[1:]):
        want = next((k for k in range(700) if raw[before + k:before + k + 1] != raw[at + k:at + k + 1] or at + k >= 700), 700)
        assert min(got, 100) == min(want, 100)
