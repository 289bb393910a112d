"""Texts as units that byte-level tokenizers treat separately, with bounded caches of their ids.

The split pattern of byte-level BPE always starts a new piece at a space that a visible character
follows. So a text is cut there, and the ids of a unit never depend on its neighbours. Units repeat
a lot, and pieces inside units even more, so most of a text is looked up instead of encoded.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

#: Cached units and pieces of a Python worker; a full cache is emptied.
CACHE_UNITS = 600_000
CACHE_PIECES = 500_000
#: Texts encoded together, in characters.
SLICE_CHARS = 1 << 20

#: Trailing marks that form one piece of their own; an apostrophe may open a contraction.
_MARKS = string.punctuation.replace("'", "")


def _opens(piece: str) -> bool:
    """True if the piece starts with a character that is surely no white space."""
    return bool(piece) and ("!" <= piece[0] <= "~" or piece[0].isalnum())


class UnitCache:
    """ids (little-endian unsigned 32-bit) of whole texts, by cached units and pieces.

    `find` cuts a text into the pieces of its pattern, `piece` encodes one of them.
    """

    def __init__(self, find: Callable[[str], list[str]], piece: Callable[[str], bytes]):
        self._find, self._piece = find, piece
        self._units: dict[str, bytes] = {}  # without the space in front
        self._pieces: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        body = unit[1:]
        word = body.rstrip(_MARKS)
        if unit[:1] == " " and word.isalpha():  # the most common forms need no pattern
            pieces = [unit] if len(word) == len(body) else [unit[: 1 + len(word)], body[len(word) :]]
        else:
            pieces = self._find(unit)
        known, out = self._pieces, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                if len(known) >= CACHE_PIECES:
                    known.clear()
                ids = known[p] = self._piece(p)
            out.append(ids)
        return b"".join(out)

    def text(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        known = self._units
        found = list(map(known.get, rest))
        if None not in found:
            return self._unit(head) + b"".join(found)
        if all(p is not None or _opens(u) for u, p in zip(rest, found)):
            for k, ids in enumerate(found):
                if ids is None:
                    if len(known) >= CACHE_UNITS:
                        known.clear()
                    found[k] = known[rest[k]] = self._unit(" " + rest[k])
            return self._unit(head) + b"".join(found)
        # A space before a space or an unusual character belongs to the unit before it.
        units = [head]
        for u in rest:
            if _opens(u):
                units.append(" " + u)
            else:
                units[-1] += " " + u
        return b"".join(map(self._unit, units))

    def clear(self) -> None:
        """Give the memory back; a worker may have other work to do after a task."""
        self._units.clear()
        self._pieces.clear()

    def texts(self, texts: Sequence[str]) -> list[bytes]:
        return list(map(self.text, texts))


def text_slices(batch: pa.RecordBatch, id_col: int = 0, text_col: int = 1) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch in slices of bounded size; null texts are empty."""
    ids, texts, chars = [], [], 0
    for i, t in zip(batch.column(id_col), batch.column(text_col), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS or len(ids) >= 1024:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts
