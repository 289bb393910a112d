"""Removal of passages that an earlier document has too, by repeated-phrase automata.

A word goes if a window of `window` consecutive words covers it and the same window also starts in a
document with a smaller id.

1. Candidates. Every window is represented by the smallest hash among its short word n-grams, which
   depends on the window alone. Few hashes are ever chosen; those that two documents choose lead to
   the documents and windows that may repeat. Documents with the same words as an earlier one
   are settled at once.
2. Confirmation. Hashes of the candidate windows are counted; a window of two documents belongs to
   the earliest of them. Neighbouring windows that a document owns form its passages.
3. Location. Each candidate document meets the passages of the owners it shares windows with. A shard is
   a run of such documents with their passages: blocks of half a window are compiled into one
   pyahocorasick automaton, the documents are streamed through it, and every hit is extended word
   by word on the texts themselves.

Every table between the steps is reduced before it is shuffled or joined by a key that skew
handling can split; no list grows beyond a document and the passages it shares.

Edge cases: null and empty texts have no words and keep none; texts shorter than a window stay whole;
repeated rows (same id) count as one document and get the same result; null ids are never earlier
than others and lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import landed
from llm.words import Words, mix, word_slices

WINDOW = 50
#: Words of the n-grams that represent a window.
GRAM = 8
#: Bytes of passages compiled into one automaton; a document with more gets its own.
SHARD_BYTES = 1 << 20

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, representing hash) of all windows that lie inside a text."""
    grams = words.grams(GRAM)
    if len(words.hashes) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    chosen = _least(grams, window - GRAM + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    start = np.flatnonzero(text[: len(chosen)] == text[window - 1 :])
    return text[start], start, chosen[start]


def _outlined(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per document: number of words, digests of the word sequence, and chosen hashes."""
    for batch in batches:
        for lo, hi, words in word_slices(batch.column(1)):
            n = hi - lo
            text, _, chosen = _windows(words, window)
            pairs = np.unique(np.rec.fromarrays([text, chosen.view(np.int64)])) if len(text) else np.rec.fromarrays([text, text])
            edges = np.searchsorted(pairs["f0"], np.arange(n + 1)).astype(np.int32)
            kept = [words.text(a, b) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            yield pa.record_batch(
                [
                    batch.column(0).slice(lo, n), pa.array(np.diff(words.first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.ListArray.from_arrays(edges, pa.array(pairs["f1"])),
                ],
                ["id", "n_words", "words_sha256", "chosen"],
            )


def _candidate_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(hash, id, first word) of the windows whose representing hash several documents chose."""
    for batch in batches:
        for lo, hi, words in word_slices(batch.column(1)):
            text, start, chosen = _windows(words, window)
            lists = batch.column(2).slice(lo, hi - lo)
            shared, of = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            # Both sides as one number each: the hash with the text mixed in.
            salt = mix(np.arange(1, hi - lo + 1).astype(np.uint64))
            wanted = shared.view(np.uint64) ^ salt[np.repeat(np.arange(hi - lo), of)]
            hit = np.flatnonzero(np.isin(chosen ^ salt[text], wanted))
            hashes = words.grams(window)[start[hit]].view(np.int64)
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(text[hit]))
            yield pa.record_batch([pa.array(hashes), ids, pa.array(start[hit] - words.first[text[hit]])], ["window", "id", "start"])


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(owner, start, text) of each run of windows that a document owns."""
    for batch in batches:
        owners, starts, texts = [], [], []
        for owner, text, owned in zip(*batch.columns, strict=True):
            words = text.as_py().encode().split()
            at = np.unique(owned.values.to_numpy())
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                owners.append(owner.as_py())
                starts.append(int(run[0]))
                texts.append(b" ".join(words[run[0] : run[-1] + window]))
        yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["owner", "start", "passage"])


class Automaton:
    """Finds where texts share whole windows with passages."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        import ahocorasick

        self.window, self.passages, blocks = window, [(owner, text.split()) for owner, text in passages], {}
        half = max(1, window // 2)
        for p, (_, words) in enumerate(self.passages):
            # Every window holds one block that starts at a multiple of half a window.
            for at in range(0, len(words) - half + 1, half):
                block = b" " + b" ".join(words[at : at + half]) + b" "
                blocks.setdefault(block.decode("latin-1"), []).append((p, at))
        self.half, self.found = half, ahocorasick.Automaton()
        for block, places in blocks.items():
            self.found.add_word(block, places)
        self.found.make_automaton()

    def covered(self, words: list[bytes], before: int) -> np.ndarray:
        """Marks the words that lie in a window shared with a passage of an owner below `before`."""
        marked = np.zeros(len(words), bool)
        if not len(self.found):
            return marked
        ends = {e: j for j, e in enumerate(np.cumsum([len(w) + 1 for w in words]).tolist())}
        reached: dict[tuple[int, int], int] = {}
        for end, places in self.found.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            first = ends[end] + 1 - self.half
            for p, at in places:
                owner, passage = self.passages[p]
                shift = first - at
                if owner >= before or reached.get((p, shift), -1) > first:
                    continue
                lo, hi = first, first + self.half
                while lo > 0 and lo > shift and words[lo - 1] == passage[lo - 1 - shift]:
                    lo -= 1
                while hi < len(words) and hi - shift < len(passage) and words[hi] == passage[hi - shift]:
                    hi += 1
                reached[p, shift] = hi
                if hi - lo >= self.window:
                    marked[lo:hi] = True
        return marked


def _located(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Removed spans and kept text of each candidate document, shard by shard."""

    def shard(docs, passages):
        automaton = Automaton([(owner, text) for (owner, _), text in passages.items()], window)
        ids, spans, kept = [], [], []
        for i, text in docs:
            words = text.encode().split()
            gone = automaton.covered(words, i)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            ids.append(i)
            spans.append([{"start": a, "stop": b} for a, b in edge.tolist()])
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(spans, _SPANS), pa.array(kept)], ["id", "removed", "kept"])

    docs, passages, size = [], {}, 0
    for batch in batches:
        for i, text, given in zip(*batch.columns, strict=True):
            docs.append((i.as_py(), text.as_py()))
            for p in given.as_py():
                if (p["owner"], p["start"]) not in passages:
                    passages[p["owner"], p["start"]] = p["passage"]
                    size += len(p["passage"])
            if size >= SHARD_BYTES:
                yield shard(docs, passages)
                docs, passages, size = [], {}, 0
    if docs:
        yield shard(docs, passages)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, removed spans of words, words_sha256 (of the whole text's
    words joined by one space), and kept (the remaining words, or null where nothing is removed)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    outlined = landed(
        rows.mapInArrow(partial(_outlined, window=window), "id long, n_words long, words_sha256 string, chosen array<long>"),
        "outlines",
    )
    # Equal word sequences: the earliest stands for all.
    firsts = outlined.where(F.col("n_words") >= window).groupBy("n_words", "words_sha256").agg(F.min("id").alias("first_id"))
    firsts = landed(firsts, "first-of-equal-words")
    own = outlined.join(firsts.where("first_id IS NOT NULL"), ["n_words", "words_sha256"]).where("id = first_id")
    chosen = landed(own.select("id", F.explode("chosen").alias("gram")).distinct(), "chosen-grams")
    met = chosen.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    lists = chosen.join(landed(met.select("gram"), "shared-grams"), "gram").groupBy("id").agg(F.collect_set("gram").alias("grams"))
    candidates = landed(rows.join(lists, "id").dropDuplicates(["id"]).select("id", "text", "grams"), "candidates")

    windows = candidates.mapInArrow(partial(_candidate_windows, window=window), "window long, id long, start long")
    confirmed = windows.groupBy("window").agg(
        F.min("id").alias("owner"), F.min_by("start", "id").alias("start"), F.max("id").alias("last")
    ).where("owner < last")
    confirmed = landed(confirmed.select("window", "owner", "start"), "confirmed-windows")
    owned = confirmed.groupBy(F.col("owner").alias("id")).agg(F.collect_list("start").alias("owned"))
    passages = candidates.join(owned, "id").select("id", "text", "owned")
    passages = landed(
        passages.mapInArrow(partial(_passages, window=window), "owner long, start long, passage binary"), "passages"
    )
    pairs = windows.join(confirmed.select("window", "owner"), "window").where("id > owner").select("id", "owner").distinct()
    pairs = landed(pairs, "documents-of-owners")
    given = pairs.join(passages, "owner").groupBy("id").agg(F.collect_list(F.struct("owner", "start", "passage")).alias("passages"))
    located = candidates.select("id", "text").join(given, "id").select("id", "text", "passages").mapInArrow(
        partial(_located, window=window), "id long, removed array<struct<start:long,stop:long>>, kept string"
    )
    located = landed(located, "located")

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    copy = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    out = outlined.drop("chosen").join(firsts, ["n_words", "words_sha256"], "left").join(located, "id", "left")
    return out.select(
        "id", "n_words", "words_sha256",
        F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(copy, F.lit("")).when(F.size("removed") > 0, F.col("kept")).alias("kept"),
    )
