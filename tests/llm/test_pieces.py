import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from docuvet.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(1)
    letters = "ab c  \n\té日本語😀ﬁ①İ▁.,<0x0A>\x00​　 xyz the ing"
    made = ["", " ", "  ", "a", "\n", "x" * 300, "ab" * 400 + " " + "é" * 200, "  lead", "trail  ", "\n\n a", "▁▁ x",
            "</s> <s> <unk>", " " * 45]
    made += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    return made + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect()]


def test_ids_equal_the_models_own(texts):
    got = pieces.Encoder(pieces.Vocabulary(PATH)).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == SentencePieceProcessor(model_file=PATH).encode(texts)


def test_every_occurrence_of_every_piece_is_found():
    vocabulary = pieces.Vocabulary(PATH)
    raw = "▁the▁inspection▁thesis▁the".encode()
    position, row = pieces.occurrences(np.frombuffer(raw, np.uint8), vocabulary)
    names = set(vocabulary.names)
    want = [(a, raw[a:b]) for a in range(len(raw)) for b in range(a + 1, min(len(raw), a + 48) + 1) if raw[a:b] in names]
    assert [(p, vocabulary.names[r]) for p, r in zip(position.tolist(), row.tolist())] == want


def test_round_trip_through_tables(cases, texts):
    rows = [(i, t) for i, t in enumerate(texts) if "▁" not in t] + [(9_000, None), (None, "no case"), (5, texts[5]), (5, texts[5])]
    back = pieces.decode_cases(pieces.encode_cases(cases(rows), PATH), PATH).collect()
    assert sorted((r.case_id or -1, r.raw_text) for r in back) == sorted((i or -1, t or "") for i, t in rows)


def test_empty_table_clashing_columns_and_ids_without_text(cases):
    extra = cases([(1, "a", "x")], "case_id long, raw_text string, piece_ids string")
    assert bytes(pieces.encode_cases(extra, PATH).first().piece_ids)
    assert pieces.encode_cases(cases([]), PATH).count() == 0
    assert pieces.decode_cases(cases([(1, None)], "case_id long, piece_ids binary"), PATH).first().raw_text == ""
