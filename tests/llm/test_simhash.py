import itertools
import random
import re

import numpy as np
import xxhash

from docuvet.llm import components, simhash


def reference_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(prints, radius):
    """By doc id, over all pairs."""
    ids = sorted(prints)
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if bin(prints[a] ^ prints[b]).count("1") <= radius]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_masks_leave_out_any_four_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = random.Random(0)
    for _ in range(3000):
        gone = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & gone == 0 for m in masks)


def test_fingerprints_and_groups_match_brute_force(cases):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Name"), (4, "NAME"), (5, "a b c d"), (6, "A  B\tC\nD e")]
    for i in range(10, 60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))))
    for i in range(60, 90):
        near = rows[rng.randint(7, 50)][1].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append((i, " ".join(near)))
    rows.append((90, rows[20][1]))
    got = simhash.near_duplicate_cases(cases(rows)).collect()
    prints = {i: reference_print(t) for i, t in rows}
    assert {r.case_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.case_id: r.component_id for r in got} == reference_components(prints, 4)


def test_full_buckets_are_split_without_loss(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:3]:
        prints |= {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(60)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    want = reference_components({s: s & (1 << 64) - 1 for s, in signed}, 4)
    for split_from in (2, 1000):
        links = simhash.fingerprint_links(table, split_from=split_from)
        found = {r.node: r.component for r in components.connected(links).collect()}
        assert {s: found.get(s, s) for s in want} == want


def test_missing_ids_repeated_rows_clashing_columns_and_empty(cases):
    rows = [(None, "same text here now", 1), (5, "same text here now", 2), (5, "same text here now", 2)]
    got = simhash.near_duplicate_cases(cases(rows, "case_id long, raw_text string, fp long")).collect()
    assert sorted((r.case_id or 0, r.component_id) for r in got if r.case_id) == [(5, 5), (5, 5)]
    assert [r.component_id for r in got if r.case_id is None] == [None]
    assert simhash.near_duplicate_cases(cases([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {i: 100 for i in range(100, 161)}.items() <= got.items()
    assert {i: 500 for i in range(500, 540)}.items() <= got.items()
    assert np.isin([7, 3], list(got)).sum() == 0
