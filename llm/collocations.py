"""Collocations of two to five words per language, from count streams in prefix and suffix order.

Counting: whole texts are counted in three passes (words, pairs, then three to five words). A phrase is
only counted where the shorter phrases inside it are frequent; a bitmap of hashes, bounded in size, says
where they may be, and exact counts decide afterwards. So chance hits cost work but never change results.

Joining: the frequent phrases form one stream sorted by their words from the last to the first (suffix
order) and one sorted from the first to the last (prefix order). In suffix order a phrase's endings stand
right above it on a short stack, and its extensions to the left below it; prefix order gives
beginnings and extensions to the right. Each stream is cut into ranges at sampled phrases, and the few
phrases that reach over a cut are carried into the ranges they reach. Nothing is looked up by hash.

A longer phrase that absorbs a candidate has at most the count of any phrase between the two, so looking at
extensions by one word to either side finds every absorbed candidate.

Edge cases: null and empty texts have no words; a null language counts as `und`; repeated rows count as
often as they occur; ties in score are ordered by count, then by phrase in UTF-8 byte order; an empty table gives
no rows; a text of any length is read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import broadcast_if_small
from llm.common import landed, ship
from llm.words import mix

#: Bytes of text counted together; a longer text is counted alone.
SLICE_BYTES = 1 << 23
#: Bits for each frequent phrase, and at most in all (16 MiB for all workers).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Phrases in a range, ranges at most, and sampled phrases for each range; bounds what the driver holds.
RANGE_ROWS, MOST_RANGES, SAMPLED = 50_000, 4096, 16
#: Parts whose best rows are found before the best of a language are.
PARTS = 64

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A
_CLEAN[0x09] = 0x20

COUNTS = "lang string, phrase string, n int, f long"
SUFFIXED = "lang string, words array<string>, f long, total long, ends array<long>, left long, partial boolean"
SCORED = "lang string, phrase string, n int, a long, l long, r long, total long, score long, extended long, partial boolean"


# --- Counting ---------------------------------------------------------------


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, cleaned bytes, offsets) over a batch."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, _CLEAN[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words in order; for each its text and a number that changes from piece to piece."""
    inside = (data != 0x20) & (data != 0x0A)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    texts = np.searchsorted(offsets, starts, "right") - 1
    pieces = np.searchsorted(np.flatnonzero(data == 0x0A), starts) + texts
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return words.dictionary_encode(), texts, pieces


def _hash(lang: str, words: list[bytes]) -> int:
    seed = xxhash.xxh64_intdigest(lang.encode())
    parts = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
    return int(_pair(parts[:1], parts[1:])[0] if len(parts) == 2 else mix(parts)[0])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counted(batches, least: int, most: int, known) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of `least` to `most` words; `known` marks the frequent words (for pairs) or
    the frequent pairs (for longer phrases). Single words come with their sum for each language."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in _slices(batch.column(0)):
            encoded, texts, pieces = _words(data, offsets)
            if not len(texts):
                continue
            distinct, w = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lang = codes[lo:hi][texts].astype(np.int64)
            ids = lang * len(distinct) + w
            parts = []  # (n, first word of an example, count)
            if least == 1:
                _, example, n = np.unique(ids, return_index=True, return_counts=True)
                parts.append((1, example, n))
                used, each = np.unique(lang, return_counts=True)
                yield pa.record_batch(
                    [pa.array([names[i] for i in used]), pa.nulls(len(used), pa.string()), pa.array(np.zeros(len(used), np.int32)), pa.array(each)],
                    ["lang", "phrase", "n", "f"],
                )
            else:
                # Hashes of the (language, word) pairs that occur, then of every place.
                there, at = np.unique(ids, return_inverse=True)
                seeds = [xxhash.xxh64_intdigest(x.encode()) for x in names]
                plain = distinct.to_pylist()
                hashes = np.array([xxhash.xxh64_intdigest(plain[i % len(plain)], seeds[i // len(plain)]) for i in there.tolist()], np.uint64)
                joined = pieces[1:] == pieces[:-1]
                if least == 2:
                    good = _among(known.value, mix(hashes))[at]
                    open_ = joined & good[1:] & good[:-1]
                else:
                    h = hashes[at]
                    open_ = joined & _among(known.value, _pair(h[:-1], h[1:]))
                # From place to place: a dense number for the phrase that starts there.
                fits, number = open_, at.astype(np.int64)
                for n in range(2, most + 1):
                    if n > 2:
                        fits = fits[:-1] & open_[n - 2 :]
                    p = np.flatnonzero(fits)
                    if not len(p):
                        break
                    _, example, dense, count = np.unique(
                        number[p] * len(there) + at[p + n - 1], return_index=True, return_inverse=True, return_counts=True
                    )
                    number = np.zeros(len(at), np.int64)
                    number[p] = dense
                    if n >= least:
                        parts.append((n, p[example], count))
            for n, example, count in parts:
                flat = distinct.take(pa.array(w[(example[:, None] + np.arange(n)).ravel()])).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat)
                yield pa.record_batch(
                    [
                        langs.dictionary.take(pa.array(lang[example])), pc.binary_join(lists, b" ").cast(pa.string()),
                        pa.array(np.full(len(example), n, np.int32)), pa.array(count),
                    ],
                    ["lang", "phrase", "n", "f"],
                )


def _places(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        # From 1 on, as the bitmap functions count.
        yield pa.record_batch([pa.array([(_hash(g, p.encode().split(b" ")) & (size - 1)) + 1 for g, p in rows], pa.int64())], ["place"])


def _bitmap(phrases: DataFrame):
    """Bits of the phrases' hashes, for all workers; at most MOST_BITS / 8 bytes reach the driver."""
    size = min(MOST_BITS, 1 << max(15, (BITS_EACH * phrases.count()).bit_length()))
    places = phrases.select("lang", "phrase").mapInArrow(partial(_places, size=size), "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for part, found in parts.collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(found), np.uint8)[: len(bits)]
    return phrases.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n, f) of all phrases with f >= least; with n = 0 and no phrase, the words of a language."""
    known, parts = None, []
    for low, high in ((1, 1), (2, 2), (3, longest)):
        if low > longest:
            break
        counts = rows.mapInArrow(partial(_counted, least=low, most=high, known=known), COUNTS)
        counts = counts.groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f"))
        part = landed(counts.where((F.col("f") >= least) | (F.col("n") == 0)), f"phrases-{low}")
        parts.append(part)
        if high < longest:
            known = _bitmap(part.where("n > 0"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


# --- Ordered streams --------------------------------------------------------


def _dealt(batches, bounds: list[tuple], reverse: bool) -> Iterator[pa.RecordBatch]:
    """Add the range of each row (0 from the start, i from bound i on), its key and its kind: 0 a phrase,
    1 a phrase carried into a range that its extensions reach, 2 a partial row of the other order."""
    reach: dict[tuple, list[int]] = {}
    for i, (lang, words) in enumerate(bounds, 1):
        for n in range(1, len(words)):
            reach.setdefault((lang, tuple(words[:n])), []).append(i)
    for batch in batches:
        keys = [k[::-1] if reverse else k for k in batch.column("words").to_pylist()]
        langs, half = batch.column("lang").to_pylist(), batch.column("partial").to_pylist()
        at, place, kind = [], [], []
        for i, k in enumerate(keys):
            at.append(i)
            place.append(bisect.bisect_right(bounds, (langs[i], k)))
            kind.append(2 if half[i] else 0)
            for further in () if half[i] else reach.get((langs[i], tuple(k)), ()):
                at.append(i)
                place.append(further)
                kind.append(1)
        out = batch.take(pa.array(at, pa.int64()))
        extra = [pa.array(place, pa.int32()), pa.array([keys[i] for i in at], pa.list_(pa.string())), pa.array(kind, pa.int32())]
        yield pa.RecordBatch.from_arrays([*out.columns, *extra], [*out.schema.names, "range", "key", "kind"])


def _ordered(stream: DataFrame, reverse: bool) -> DataFrame:
    """The stream in ranges of its key, sorted in each, with what reaches over a cut carried along."""
    spark = stream.sparkSession
    n = stream.count()
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    key = F.reverse("words") if reverse else F.col("words")
    chance = F.pmod(F.xxhash64("lang", "words"), F.lit(1 << 20))
    drawn = stream.where(~F.col("partial") & (chance < min(1.0, SAMPLED * ranges / max(1, n)) * (1 << 20)))
    keys = sorted((r.lang, r.key) for r in drawn.select("lang", key.alias("key")).collect())
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    bounds = [b for i, b in enumerate(bounds) if i == 0 or b != bounds[i - 1]]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    dealt = stream.mapInArrow(partial(_dealt, bounds=bounds, reverse=reverse), f"{names}, range int, key array<string>, kind int")
    return dealt.repartitionByRange(ranges, "range").sortWithinPartitions("range", "lang", "key", "kind")


class _Open:
    """A phrase whose extensions may still follow."""

    __slots__ = ("row", "counts", "extended")

    def __init__(self, row: dict, above: list[_Open]):
        self.row = row
        self.counts = [x.row["f"] for x in above]
        self.extended = 0


def _walk(batches, columns: tuple[str, ...]) -> Iterator[_Open]:
    """Each phrase once with the counts of the shorter ones it starts with, and its best extension."""
    stack: list[_Open] = []
    at = None
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            key, here = row["key"], (row["range"], row["lang"])
            if here != at:
                yield from reversed(stack)
                stack, at = [], here
            while stack and stack[-1].row["key"] != key[: len(stack)]:
                yield stack.pop()
            if len(stack) == len(key):  # a partial row, below its phrase
                stack[-1].row["left"] = max(stack[-1].row["left"], row["left"])
                continue
            if stack:
                stack[-1].extended = max(stack[-1].extended, row["f"])
            stack.append(_Open(row, stack))
    yield from reversed(stack)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == 2000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _suffix_counts(batches) -> Iterator[pa.RecordBatch]:
    """The counts of each phrase's endings, shortest first, and of its best extension to the left."""

    def rows():
        for x in _walk(batches, ("range", "lang", "key", "kind", "f", "total")):
            carried = x.row["kind"] == 1
            if not carried or x.extended:
                yield x.row["lang"], x.row["key"][::-1], x.row["f"], x.row["total"], x.counts, x.extended, carried

    yield from _batched(rows(), pa.schema([
        ("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("total", pa.int64()),
        ("ends", pa.list_(pa.int64())), ("left", pa.int64()), ("partial", pa.bool_()),
    ]))


def _prefix_scores(batches, scale: int) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of each candidate and its best extension to either side."""

    def rows():
        for x in _walk(batches, ("range", "lang", "key", "kind", "f", "total", "ends", "left")):
            row, n, carried = x.row, len(x.row["key"]), x.row["kind"] == 1
            if n < 2 or carried and not x.extended:
                continue
            # Python's integers: products may pass 64 bits.
            cuts = [(scale * row["f"] * row["total"] // (l * r), l, r) for l, r in zip(x.counts, row["ends"][::-1], strict=True)]
            score, l, r = min(cuts, key=lambda c: c[0])
            extended = x.extended if carried else max(x.extended, row["left"])
            yield row["lang"], " ".join(row["key"]), n, row["f"], l, r, row["total"], score, extended, carried

    yield from _batched(rows(), pa.schema([
        ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()),
        ("total", pa.int64()), ("score", pa.int64()), ("extended", pa.int64()), ("partial", pa.bool_()),
    ]))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5,
    scale: int = 1000, absorbed: int = 100,
) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, n, score) of every candidate that no longer one absorbs.

    Candidates have two to `longest` words and a count `a` of `least` or more; one is absorbed by a longer
    one around it with 100 * f(longer) >= absorbed * a.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    phrases = frequent_phrases(rows, least, longest)
    totals = phrases.where("n = 0").select("lang", F.col("f").alias("total"))
    stream = phrases.where("n > 0").select("lang", F.split("phrase", " ").alias("words"), "f").join(broadcast_if_small(totals), "lang")
    stream = landed(stream.withColumn("partial", F.lit(False)), "phrases")
    suffixed = landed(_ordered(stream, reverse=True).mapInArrow(_suffix_counts, SUFFIXED), "suffix-order")
    scored = landed(_ordered(suffixed, reverse=False).mapInArrow(partial(_prefix_scores, scale=scale), SCORED), "prefix-order")
    lost = 100 * F.col("extended") >= absorbed * F.col("a")
    # At most longest - 1 for each range.
    reaching = scored.where(F.col("partial") & lost).select("lang", "phrase").distinct()
    kept = scored.where(~F.col("partial") & ~lost).join(F.broadcast(reaching), ["lang", "phrase"], "left_anti")
    return kept.select("lang", "phrase", F.col("n").alias("n_words"), "a", "l", "r", F.col("total").alias("n"), "score")


def best_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first `top` collocations of each language, with their rank from 1.

    The best of PARTS parts of a language are found first, so that no task gets all of a frequent one.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    first = found.withColumn("_part", part).withColumn("_place", place).where(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return first.withColumn("rank", rank).where(F.col("rank") <= top).drop("_part", "_place")
