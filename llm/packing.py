"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece is linear plus quadratic in its length, as attention is. Documents are cut at the
sequence length; what is left over of each goes, dearest first, to the cheapest sequence with room
for it. Where no sequence has room for all of it, it is cut and fills the cheapest one. A block of
documents gets exactly as many places as it has tokens: whole sequences, and for the rest
sequences of a power of two, so nothing is padded.

Packing is a narrow map: a task reads its rows once, holds one block of them, and shuffles nothing,
so no key can be hot. Which documents share a sequence depends on the input partitions.

Edge cases: added tokens of the file (as `<|endoftext|>`) are found in a text, as the tokenizer does by default; a null text is empty, and an empty text is one closing id; a text longer than a sequence
(or a block) is cut; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.units import UnitCache, text_slices

CAPACITY = 2048
#: Tokens packed together; bounds the memory of a task.
BLOCK_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def _rooms(tokens: int, capacity: int) -> list[int]:
    """Places for exactly so many tokens: whole sequences, then falling powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents count from 0."""
    pieces, left, full = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, full, 0))
            full += 1
        if n % capacity:
            left.append((n % capacity, doc, n - n % capacity))
    left.sort(key=lambda x: (-cost(x[0]), x[1]))
    size = np.array(_rooms(sum(n for n, _, _ in left), capacity), dtype=np.int64)
    room, spent = size.copy(), np.zeros(len(size))
    for n, doc, start in left:
        while n:
            fits = np.where(room >= n, spent, np.inf)
            at = int(fits.argmin())
            if not np.isfinite(fits[at]):
                at = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(n, int(room[at]))
            pieces.append((doc, start, take, full + at, int(size[at] - room[at])))
            room[at] -= take
            spent[at] += cost(take)
            start, n = start + take, n - take
    return pieces


def _byte_marks() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(2)
def _tokenizer(path: str, pattern: str) -> tuple[UnitCache, Callable[[str], bytes]]:
    """An encoder of texts by the file's own BPE model, and its cache, built once in a worker.

    A text is cut at the added tokens of the file, the longest where several start. What lies between
    goes to the tokenizer's model piece by piece, in its byte alphabet, as its own splitter would
    hand it over.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer, marks = Tokenizer.from_file(path), _byte_marks()
    model, added = tokenizer.model, tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("added tokens that strip spaces or stand for whole words only are not supported")
    single = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
    cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(single, key=len, reverse=True))) + ")") if single else None

    def piece(text: str) -> bytes:
        found = model.tokenize(text.encode().decode("latin-1").translate(marks))
        return np.array([t.id for t in found], "<u4").tobytes()

    cache = UnitCache(regex.compile(pattern).findall, piece)

    def encode(text: str) -> bytes:
        if not any(t in text for t in single):
            return cache.text(text)
        # Every second part is an added token.
        return b"".join(single[part] if k % 2 else cache.text(part) for k, part in enumerate(cuts.split(text)))

    return cache, encode


def _packed(batches: Iterator[pa.RecordBatch], path: str, pattern: str, closing: int, capacity: int, block: int):
    (cache, encode), end = _tokenizer(path, pattern), np.array([closing], "<u4").tobytes()
    sequence = TaskContext.get().partitionId() << 40
    ids, held, tokens = [], [], 0

    def flush():
        nonlocal sequence, ids, held, tokens
        pieces = pack_block([len(x) // 4 for x in held], capacity)
        columns = [[] for _ in _ARROW]
        for doc, start, length, at, offset in pieces:
            row = (ids[doc], start, length, held[doc][4 * start : 4 * (start + length)], len(held[doc]) // 4, sequence + at, offset)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        sequence += 1 + max(p[3] for p in pieces)
        ids, held, tokens = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for some, texts in text_slices(batch):
            for i, x in zip(some, map(encode, texts), strict=True):
                ids.append(i)
                held.append(x + end)
                tokens += len(held[-1]) // 4
                if tokens >= block:
                    yield flush()
    if held:
        yield flush()
    cache.clear()


def pack(
    docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    closing: int = 1, capacity: int = CAPACITY, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: its document, place there, ids, and place in its sequence.

    `tokenizer` is a byte-level BPE file that every executor can read, `pattern` what it splits text by.
    `capacity` is a power of two.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run = partial(_packed, path=tokenizer, pattern=pattern, closing=closing, capacity=capacity, block=block)
    return rows.mapInArrow(run, SCHEMA)
