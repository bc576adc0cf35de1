import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docuvet.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CUT = re.compile(r"(?<=\S) (?=\S)")


def by_hand(rows):
    """Whole texts by the libraries, groups by walking the offsets, counts by dictionaries."""
    first, second = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    spelled = alignment._spelled_bytes()
    groups_of = []
    for _, text in rows:
        groups = []
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(spelled[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [[], []]
                for side, tokens in enumerate((a, b)):
                    at = 0
                    for i, x in tokens:
                        at += len(x)
                        ends[side].append((at, i))
                common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                groups = [([], []) for _ in common]
                for side in (0, 1):
                    for e, i in ends[side]:
                        groups[bisect.bisect_left(common, e)][side].append(i)
        groups_of.append(groups)
    held = Counter(p for groups in groups_of for p in {(a, b) for g in groups for a in g[0] for b in g[1]})
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (case_id, _), groups in zip(rows, groups_of):
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((case_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(table, **options):
    return sorted((tuple(r) for r in alignment.align_cases(table, FIRST, SECOND, **options).select(
        "case_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(3)
    letters = "ab c  \n\té日本語😀ﬁ①İ.,'<|endoftext|>\x00​　\xa0 xyz the ing  s 12 </s>"
    made = ["", None, " ", "  ", "a", "\n", "x" * 300, "  lead", "trail  ", "\n\n a", "▁ x", "a ▁b", "<|endoftext|> <s>", " " * 45,
            "日本" * 200, "PASSPORT\nP<UTOERIKSSON<<ANNA<MARIA", "a b", "a b", "﻿x y", "it's we'll a'b"]
    made += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    return [*enumerate(made + given), (None, "no case"), (5, "a b"), (5, "a b")]


def test_equal_to_whole_text_tokenization(cases, rows):
    assert found(cases(rows)) == by_hand(rows)


def test_fragments_of_any_size_give_the_same(cases, rows):
    short = [(i, t) for i, t in rows if t is None or len(t) < 1500]
    want = by_hand(short)
    for range_bytes, fan in ((7, 2), (64, 3)):
        assert found(cases(short), range_bytes=range_bytes, fan=fan) == want


def test_composition_is_associative_and_closes_the_units():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\xa0é") for _ in range(rng.randint(2, 60)))
        parts = alignment.split_ranges(text, rng.randint(1, 5))
        nodes = [((p, s), closed) for p, closed, s in (alignment.fragment(x, CUT) for x in parts)]

        def join(x, y):
            whole, closed = alignment.compose(x[0], y[0], CUT)
            return whole, " ".join(t for t in (x[1], closed, y[1]) if t)

        while len(nodes) > 1:  # any neighbours, in any order
            at = rng.randrange(len(nodes) - 1)
            nodes[at:at + 2] = [join(*nodes[at:at + 2])]
        (prefix, suffix), closed = nodes[0]
        assert " ".join(t for t in (prefix, closed, suffix) if t) == text
        assert [u for t in (prefix, closed, suffix) if t for u in CUT.split(t)] == CUT.split(text)


def test_very_long_texts(cases):
    rng = random.Random(7)
    words = ["visa", "permit", "Straße", "\n", "No.", "日本", "x" * 40]
    rows = [(1, " ".join(rng.choice(words) for _ in range(60_000))), (2, "z" * 2_000 + " visa" * 20_000), (3, "▁" + "visa " * 30_000), (4, "visa permit")]
    assert found(cases(rows)) == by_hand(rows)


def test_wide_groups_are_linked_by_id():
    aligner = alignment.Aligner(FIRST, SECOND)
    wide, alignment.WIDE = alignment.WIDE, 1
    try:
        by_id = alignment.Aligner(FIRST, SECOND)
        texts = ["日本語の旅券 übergröße 0123456789 aaaaaaaaaaaaa"]
        a, b = aligner.align(texts), None
        alignment.WIDE = 1
        b = by_id.align(texts)
    finally:
        alignment.WIDE = wide
    assert a["counts"].tolist() == b["counts"].tolist() and a["pairs"].tolist() == b["pairs"].tolist()
    assert a["pair_often"].tolist() == b["pair_often"].tolist()


def test_empty_table_and_clashing_columns(cases):
    assert found(cases([])) == []
    odd = cases([(1, "a b", 7, "x")], "case_id long, raw_text string, row long, n_a string")
    assert found(odd) == by_hand([(1, "a b")])
