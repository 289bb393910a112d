from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm.packing import cost, pack, pack_block

PATH = P.path("byte_bpe_50k.json")


def check(lengths, pieces, capacity):
    of, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        of[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for spans, totals in ((of.items(), dict(enumerate(lengths))), (sequences.items(), None)):
        for key, parts in spans:
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == totals[key] if totals else at == capacity or (at < capacity and at & (at - 1) == 0)
    assert set(of) == {d for d, n in enumerate(lengths) if n}
    return sequences


@given(st.lists(st.integers(1, 100), max_size=60))
def test_every_id_once_and_no_padding(lengths):
    check(lengths, pack_block(lengths, 32), 32)


def test_costs_are_balanced():
    rnd = np.random.default_rng(3)
    sequences = check(n := rnd.integers(10, 1500, 600).tolist(), pack_block(n), 2048)
    costs = [sum(cost(n) for _, n in s) for s in sequences.values() if sum(n for _, n in s) == 2048]
    assert np.std(costs) < 0.25 * np.mean(costs)


def test_ids_are_the_tokenizers(spark, documents, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    odd = [None, "", " ", "a  b", "x\n\n y", "  lead", "trail  ", "tab\t x", "é  ü", "I'll  'll", "long " * 5000, "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", " <|endoftext|>\n x", "<|endoftext", "x\u3000y \xa0z \x85 \u0301a b\u0301", "a_b. _c ,, .x"]
    rows = list(enumerate(odd + real)) + [(0, None)]
    out = pack(documents(rows), PATH, P.PATTERN, block=20_000).collect()
    tokenizer = Tokenizer.from_file(PATH)
    got, places = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        places[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    want = {i: t for i, t in rows if i}
    for i, t in want.items():
        assert sum((ids for _, ids in sorted(got[i])), []) == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    assert len(got[0]) == 2
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert pack(documents([]), PATH, P.PATTERN).collect() == []
