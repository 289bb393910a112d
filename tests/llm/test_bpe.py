import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(5)
    chars = "abcthe  \n\t\r'sreélößñ,.!#012  　中文字かな٣½🙂́\x1c\x85_"
    made = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(400)]
    return made + [None, "", " ", "   ", "  a", "a  ", "I'll  don't", "ab" * 5000, "the " * 3000, "<|endoftext|> x", "x\n \n y"]


def test_equals_tiktoken_and_decodes(spark, documents, sf_dir, model):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = list(enumerate(odd_texts() + real)) + [(0, "again"), (None, "no id")]
    encoded = bpe.encode(documents(rows), RANKS, P.PATTERN)
    got = bpe.decode(encoded, RANKS).collect()
    want = sorted((repr(i), model.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((repr(r.id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want


def test_random_bytes_of_one_piece(model):
    tables, rnd = bpe.Bpe(bpe.read_ranks(RANKS), P.PATTERN), random.Random(1)
    for _ in range(3000):
        piece = "".join(rnd.choice("abeinorstué") for _ in range(rnd.randrange(1, 30)))
        assert np.frombuffer(tables.piece(piece), "<u4").tolist() == model.encode_ordinary(piece)


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([]), RANKS, P.PATTERN), RANKS).collect() == []
