"""Byte-level BPE encoding and decoding of whole texts by a rank file.

Token bytes are mapped to Latin-1, so that one pyahocorasick automaton finds all tokens that match
anywhere in a piece. The encoder takes the longest match, and steps back to shorter ones where a
token may not follow the one before it. Two tokens may be neighbours if undoing their merges, latest
first, never meets a merge across their border that would have come earlier; answers are memoised. Every end
is given up at most once, so the work is linear in the piece, and the result is that of merging pairs
by rank.

Edge cases: a null text is empty and has no ids; very long texts are handled in units; an empty table
gives no rows; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.units import UnitCache, text_slices


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Bpe:
    """Exact merges by backtracking over longest matches."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * len(tokens)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            made = self._merge(token, i)
            if len(made) > 2:
                continue  # no merges lead to it: only a piece that equals it gets it
            if len(made) == 2:
                self.parts[i] = (made[0], made[1])
                self.joined[made[0], made[1]] = i
            self.automaton.add_word(token.decode("latin-1"), i)
        for i, token in enumerate(tokens):
            self.shorter[i] = next(
                (j for n in range(len(token) - 1, 0, -1) if (j := self.rank.get(token[:n])) is not None and self._reached(j)),
                -1,
            )
        self.automaton.make_automaton()
        self.may_follow = lru_cache(1 << 18)(self._may_follow)

    def _reached(self, i: int) -> bool:
        return len(self.tokens[i]) == 1 or self.parts[i] is not None

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Merge the bytes of a token by ranks lower than its own."""
        made = [self.rank[token[k : k + 1]] for k in range(len(token))]
        while len(made) > 1:
            best = min(((r, k) for k, p in enumerate(zip(made, made[1:])) if (r := self.joined.get(p, below)) < below), default=None)
            if best is None:
                break
            made[best[1] : best[1] + 2] = [best[0]]
        return made

    def _may_follow(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens together keeps the border between them."""
        bound = len(self.tokens)  # merges from this rank on would come too late
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            inner_left, inner_right = self.parts[left], self.parts[right]
            # Undo the later of the two; of equal ones the left one is merged first.
            if inner_left and (left > right or not inner_right):
                bound, left = left, inner_left[1]
            elif inner_right:
                bound, right = right + 1, inner_right[0]
            else:
                return True

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if (whole := self.rank.get(raw)) is not None:
            return np.array([whole], "<u4").tobytes()
        longest = [-1] * len(raw)
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - len(self.tokens[i])] = i  # ends rise, so the longest comes last
        size, tokens, shorter, may_follow = len(raw), self.tokens, self.shorter, self.may_follow
        dead = bytearray(size + 1)  # ends from which the rest has been tried in vain
        out, at, token = [], 0, longest[0]
        while at < size:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (before < 0 or may_follow(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += len(tokens[token])
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return np.array(out, "<u4").tobytes()


@lru_cache(2)
def load(path: str, pattern: str) -> UnitCache:
    """An encoder for a rank file, built once in a worker."""
    tables = Bpe(read_ranks(path), pattern)
    return UnitCache(tables.find, tables.piece)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    cache = load(path, pattern)
    for batch in batches:
        for ids, texts in text_slices(batch):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(cache.texts(texts), pa.binary())], ["id", "ids"])
    cache.clear()


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (little-endian unsigned 32-bit) of each text.

    `ranks` is a file that every executor can read; `pattern` cuts a text into pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encoded, path=ranks, pattern=pattern), "id long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = read_ranks(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = [
                b"".join([tokens[i] for i in np.frombuffer(ids.as_py() or b"", "<u4").tolist()]) for ids in part.column(1)
            ]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["id", "ids", "decoded"])


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Append the bytes that the ids stand for."""
    return encoded.select("id", "ids").mapInArrow(partial(_decoded, path=ranks), "id long, ids binary, decoded binary")
