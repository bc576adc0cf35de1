import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docuvet.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(histogram, capacity):
    bins, opened = Counter(), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            slack = next((s for s in range(length, capacity + 1) if bins[s]), None)
            if slack is None:
                opened, slack = opened + 1, capacity
            else:
                bins[slack] -= 1
            bins[slack - length] += 1
    return opened


@pytest.mark.parametrize("n,centre", [(0, 6), (1, 6), (400, 6.5), (6000, 7.3)])
def test_plan_places_every_piece_and_is_near_the_bound(n, centre):
    rng = np.random.default_rng(n)
    histogram = Counter(np.clip(rng.lognormal(centre, 1.0, n), 1, 4096).astype(int).tolist())
    rows = packing.plan(dict(histogram)).tolist()
    fill, placed = Counter(), Counter()
    for k, (length, first, sequence, _) in enumerate(rows):
        last = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
        placed[length] += last - first
        for i in range(last - first):
            fill[sequence + i] += length
    assert placed == histogram
    assert max(fill.values(), default=0) <= 4096 and set(fill) == set(range(len(fill)))
    if n:
        assert len(fill) <= 1.005 * best_fit(histogram, 4096) + 1


def test_configurations_cover_the_demand():
    demand = np.zeros(packing.UNITS + 1)
    demand[[100, 90, 60, 128]] = [400, 300, 500, 200]
    found = packing.configurations(demand)
    for k in (100, 90, 60, 128):
        assert sum(c.get(k, 0) * x for c, x in found) >= 0.999 * demand[k]
    assert all(sum(k * n for k, n in c.items()) <= packing.UNITS for c, _ in found)
    # the weights' step bounds what the cover spends above what the sizes alone demand
    assert sum(x for _, x in found) <= (1 + packing.STEP) * (demand * np.arange(packing.UNITS + 1)).sum() / packing.UNITS


def test_ids_are_those_of_whole_texts():
    texts = ["", "İstanbul dIş", "it's don't we'll, (x).. 12.5, ΑΣ ΑΣ. <|endoftext|> <|ENDOFTEXT|> a b́ c ",
             "​ \x1c x\x1cy \x85 　 z", "日本語 テスト。. é.,.", "Name, NAME. name.,", "word\n\nword.\tend."]
    whole = Tokenizer.from_file(PATH)
    got = packing.Encoder(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packed_cases(cases):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["visa", "number", "utopia"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (7, rows[7][1]), (None, "visa")]
    got = packing.pack_cases(cases(rows), PATH, capacity=32).collect()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for case, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 32)):
            part = np.array(ids[at:at + 32], np.uint32)
            want[(case, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.case_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 32 and len(ends) <= math.ceil(1.1 * sum(r.length for r in got) / 32)


def test_clashing_columns_and_empty_tables(cases):
    extra = cases([(1, "visa", 9, 9)], "case_id long, raw_text string, sequence_id long, length long")
    assert packing.pack_cases(extra, PATH).count() == 1
    assert packing.pack_cases(cases([]), PATH).count() == 0
