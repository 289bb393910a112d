"""TF-IDF, ordinal codes and standardised numbers; long tables and ML vectors."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions import number, text
from alertloom.operators.clean import present
from alertloom.operators.labels import long_values
from alertloom.operators.ranking import index_within
from alertloom.session import broadcast_if_small, cut_lineage, is_small, ship_sources, spread, stored
from alertloom.spec import FeatureSpec, TextParams

_UNIGRAMS, _TERMS = "_unigrams", "_terms"
NULL_CATEGORY = "Unknown"


def with_terms(df: DataFrame, column: str, sizes: tuple[int, int], name: str = _TERMS) -> DataFrame:
    """Add the array of n-grams of a text column."""
    # Two projections: the unigrams are extracted once and then read several times.
    return (
        df.withColumn(_UNIGRAMS, text.unigrams(F.col(column)))
        .withColumn(name, text.ngrams(F.col(_UNIGRAMS), sizes))
        .drop(_UNIGRAMS)
    )


def tokenize(
    df: DataFrame, column: str, key: Sequence[str], sizes: tuple[int, int] = (1, 2)
) -> DataFrame:
    """(key..., term): one row per n-gram occurrence."""
    rows = with_terms(df.select(*key, column), column, sizes)
    return rows.select(*key, F.explode(_TERMS).alias("term"))


#: Words of the texts whose n-grams are held at once, and bytes of text counted for a word.
SLICE_WORDS, WORD_BYTES = 1 << 20, 8
#: Bits of the hash slots whose occurrences show which terms may belong to a vocabulary; and terms of a slice that are proposed for each one wanted.
SLOT_BITS, PROPOSED = 18, 2
#: Text columns whose vocabularies are fitted at once.
FITTED_AT_ONCE = 4


@cache
def _word_points() -> np.ndarray:
    """Whether a code point belongs to `text.TOKEN_PATTERN`."""
    return np.array([chr(i) == "_" or unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)])


#: Bytes of the code point that each byte starts; 1 for the others.
_POINT_BYTES = np.repeat(np.array([1, 2, 3, 4, 1]), [0xC0, 0x20, 0x10, 8, 8])


def _in_words(raw: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is one of a code point that belongs to words."""
    points = _word_points()
    inside = np.append(points[:128], np.zeros(128, bool))[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    size = _POINT_BYTES[raw[lead]]
    for n in (2, 3, 4):
        # Code points beyond ASCII are few; only they are decoded.
        at = lead[size == n]
        point = raw[at].astype(np.int32) & (0xFF >> (n + 1))
        for k in range(1, n):
            point = point << 6 | (raw[at + k] & 0x3F)
        belongs = points[point]
        for k in range(n):
            inside[at + k] = belongs
    return inside


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What `text.TOKEN_PATTERN` finds in lower-cased texts (no nulls), and how many words each text has."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0]))
    raw, border = np.frombuffer(data, np.uint8), ends - ends[0]
    inside = _in_words(raw)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # No word crosses texts.
    cut = border[(border > 0) & (border < len(inside))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    # More than one code point.
    long_ = hi - lo > _POINT_BYTES[raw[lo]]
    lo, hi = lo[long_], hi[long_]
    counts = np.diff(np.searchsorted(lo, border))
    # Words and what lies between them, by turns.
    pieces = pa.LargeStringArray.from_buffers(max(0, 2 * len(lo) - 1), pa.py_buffer(np.stack([lo, hi], axis=1).ravel().astype(np.int64)), data)
    return pieces.take(pa.array(np.arange(0, len(pieces), 2))).cast(pa.string()), counts


def _word_slices(tokens: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, words, the row of each word in the slice) of a column of lower-cased texts or of word lists, in slices of bounded size."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    plain = not pa.types.is_list(tokens.type)
    sizes = pc.binary_length(tokens) if plain else pc.list_value_length(tokens)
    most = SLICE_WORDS * WORD_BYTES if plain else SLICE_WORDS
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    lo = 0
    while lo < len(tokens):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        part = tokens.slice(lo, hi - lo)
        words, counts = _words(part) if plain else (part.flatten(), np.diff(ends[lo : hi + 1]))
        yield lo, words, np.repeat(np.arange(hi - lo), counts)
        lo = hi


def _lowered(column: str) -> Column:
    """The text whose words the tasks find."""
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _gram_lists(words: pa.Array, row: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """(n-grams, their rows); no n-gram crosses rows."""
    count = max(0, len(words) - n + 1)
    whole = row[:count] == row[len(row) - count :]
    grams = pc.binary_join_element_wise(*[words.slice(k, count) for k in range(n)], " ").filter(pa.array(whole))
    return grams, row[:count][whole]


@dataclass
class _Grams:
    """The n-grams of a slice of texts as numbers: a word's place in `known`, two places in one number, or a longer n-gram's place."""

    n: int
    key: np.ndarray
    row: np.ndarray
    known: pa.Array
    #: Of the known words or n-grams, where slots are wanted.
    hashes: np.ndarray | None = None

    @property
    def most(self) -> int:
        return max(1, len(self.known)) ** (2 if self.n == 2 else 1)

    def names(self, keys: np.ndarray) -> pa.Array:
        if self.n != 2:
            return self.known.take(pa.array(keys))
        size = max(1, len(self.known))
        return pc.binary_join_element_wise(self.known.take(pa.array(keys // size)), self.known.take(pa.array(keys % size)), " ")

    def slots(self, bits: int) -> np.ndarray:
        """The hash slot of each occurrence, of 2**bits; a term has the same one in all slices."""
        # Wraps around, as is wanted.
        mixed = self.hashes * np.uint64(0x9E3779B97F4A7C15)
        if self.n == 2:
            first, second = np.divmod(self.key, max(1, len(self.known)))
            mixed = (mixed[first] + self.hashes[second]) * np.uint64(0xBF58476D1CE4E5B9)
            return (mixed >> np.uint64(64 - bits)).astype(np.int64)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)[self.key]

    def within(self, kept: np.ndarray) -> _Grams:
        return replace(self, key=self.key[kept], row=self.row[kept])

    def keys(self, terms: list[str]) -> np.ndarray:
        """The numbers of some terms; -1 for those that are not in the slice or no such n-grams."""
        if self.n != 2:
            return pc.fill_null(pc.index_in(pa.array(terms, pa.string()), self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sides = [t.split(" ") if t.count(" ") == 1 else ["", ""] for t in terms]
        a, b = (pc.fill_null(pc.index_in(pa.array([s[i] for s in sides], pa.string()), self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        return np.where((a >= 0) & (b >= 0), a * len(self.known) + b, -1)


def _hashes(known: pa.Array) -> np.ndarray:
    """A hash of each term: its bytes as the digits of a number, modulo 2**64."""
    known = known.cast(pa.large_binary())
    ends = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
    raw = np.frombuffer(known.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends, sizes = ends - ends[0], np.diff(ends)
    digits = np.cumprod(np.full(sizes.max(initial=0), 0xD6E8FEB86659FD93, np.uint64))
    # Wraps around, as is wanted.
    sums = np.cumsum((raw + np.uint64(1)) * digits[np.arange(len(raw)) - np.repeat(ends[:-1], sizes)])
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    return sums[ends[1:]] - sums[ends[:-1]]


def _gram_keys(words: pa.Array, row: np.ndarray, sizes: tuple[int, int], hashed: bool = False) -> Iterator[_Grams]:
    """The n-grams for each n from sizes[0] to sizes[1]; words are looked up once."""
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    hashes = _hashes(known) if hashed else None
    for n in range(sizes[0], sizes[1] + 1):
        if n == 1:
            yield _Grams(1, code, row, known, hashes)
        elif n == 2:
            whole = row[:-1] == row[1:]
            yield _Grams(2, (code[:-1] * len(known) + code[1:])[whole], row[:-1][whole], known, hashes)
        else:
            grams, at = _gram_lists(words, row, n)
            longer = grams.dictionary_encode()
            key, names = longer.indices.to_numpy(zero_copy_only=False).astype(np.int64), longer.dictionary
            yield _Grams(n, key, at, names, _hashes(names) if hashed else None)


def _counted(key: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, occurrences, rows that hold the key); keys are below `most`."""
    rows = int(row.max()) + 1 if len(row) else 1
    names = None
    if most * rows >= 1 << 63:
        names, key = np.unique(key, return_inverse=True)
    both = np.sort(key * rows + row)
    key = both // rows
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(starts):
        return key, key, key
    tf, df = np.diff(starts, append=len(key)), np.add.reduceat(np.diff(both, prepend=-1) != 0, starts, dtype=np.int64)
    return (key[starts] if names is None else names[key[starts]]), tf, df


def _term_sums(batches, sizes: tuple[int, int], by: int, open_: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(by..., term, tf, df) of each slice of texts, of the terms in open slots if given; the texts or word lists are the last column."""
    for batch in batches:
        # Rows of equal `by` (one column at most) are counted together.
        groups = pc.unique(batch.column(0)) if by else [None]
        for value in groups:
            part = batch.filter(pc.equal(batch.column(0), value) if value.is_valid else pc.is_null(batch.column(0))) if by else batch
            for _, words, row in _word_slices(part.column(by)):
                for grams in _gram_keys(words, row, sizes, open_ is not None):
                    if open_ is not None:
                        grams = grams.within(open_[grams.slots(len(open_).bit_length() - 1)])
                    found, *counts = _counted(grams.key, grams.row, grams.most)
                    keys = [pa.array([value.as_py()] * len(found), batch.schema.field(0).type)] if by else []
                    columns = [*keys, grams.names(found), *map(pa.array, counts)]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:by], "term", "tf", "df"])


def _proposals(batches, sizes: tuple[int, int], most: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(slot, term, tf, df, rows): about `most` frequent terms of each slice of texts, with its rows that have words; without
    a term, the occurrences in each hash slot of all slices."""
    names = ["slot", "term", "tf", "df", "rows"]
    sums = np.zeros(1 << bits, np.int64)
    for batch in batches:
        for _, words, row in _word_slices(batch.column(0)):
            every, filled = list(_gram_keys(words, row, sizes, True)), np.count_nonzero(np.diff(row, prepend=-1))
            slots = [grams.slots(bits) for grams in every]
            own = sum(np.bincount(s, minlength=len(sums)) for s in slots)
            sums += own
            # The most frequent terms lie in the fullest slots.
            least = np.partition(own, -most)[-most] if most < len(own) else 0
            for grams, slot in zip(every, slots):
                grams = grams.within(own[slot] >= least)
                found, tf, df = _counted(grams.key, grams.row, grams.most)
                top = np.argsort(-tf, kind="stable")[:most]
                numbers = [pa.array(x) for x in (tf[top], df[top], np.full(len(top), filled))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int32()), grams.names(found[top]).cast(pa.string()), *numbers], names)
    slot = np.flatnonzero(sums)
    none = np.zeros(len(slot), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.nulls(len(slot), pa.string()), *map(pa.array, (sums[slot], none, none))], names)


def _open_slots(df: DataFrame, column: str, params: TextParams, n: int) -> np.ndarray | None:
    """The hash slots that may hold terms of the vocabulary of `n` rows; None if all may.

    Terms that are frequent in slices of texts bound the last place of the vocabulary from below: what was counted of them
    there is at most what they have in all. A slot with fewer occurrences holds no term that is as frequent.
    """
    ship_sources(df.sparkSession)
    rows = spread(df.select(column)).select(_lowered(column).alias(_UNIGRAMS))
    schema = "slot int, term string, tf long, df long, rows long"
    found = rows.mapInArrow(partial(_proposals, sizes=params.ngrams, most=PROPOSED * params.max_features, bits=SLOT_BITS), schema)
    found = cut_lineage(found.groupBy("slot", "term").agg(*[F.sum(c).alias(c) for c in ("tf", "df", "rows")]))
    # Rows of other slices may all hold a term.
    sure = (F.col("df") >= params.min_df) & (F.col("df") + n - F.col("rows") <= F.lit(params.max_df * n))
    best = found.where(F.col("term").isNotNull() & sure).orderBy(F.desc("tf")).limit(params.max_features)
    count, least = best.agg(F.count("*"), F.min("tf")).first()
    if not count or count < params.max_features:
        return None
    open_ = np.zeros(1 << SLOT_BITS, bool)
    # At most as many as there are slots.
    open_[[r.slot for r in found.where(F.col("slot").isNotNull() & (F.col("tf") >= least)).select("slot").collect()]] = True
    return open_


def term_counts(
    df: DataFrame, column: str, sizes: tuple[int, int], by: Sequence[str] = (), open_: np.ndarray | None = None
) -> DataFrame:
    """(by..., term, tf, df): occurrences and rows holding the term, for each value of `by` (one column at most).

    Occurrences and rows are counted together within slices of texts, on numbers of the words; one
    aggregation adds the counts up. No (row, term) pair is shuffled. Only terms in open hash slots are counted, if given.
    """
    ship_sources(df.sparkSession)
    rows = spread(df.select(*by, column)).select(*by, _lowered(column).alias(_UNIGRAMS))
    schema = rows.drop(_UNIGRAMS).schema.add("term", "string").add("tf", "long").add("df", "long")
    counted = rows.mapInArrow(partial(_term_sums, sizes=sizes, by=len(by), open_=open_), schema)
    return counted.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fit_tfidf(df: DataFrame, column: str, params: TextParams, rows: int | None = None) -> DataFrame:
    """(term, idx, tf, df, idf): the vocabulary of one column.

    Kept are terms in at least `min_df` rows and at most the share `max_df` of the
    rows; of those the `max_features` most frequent (ties: smaller term first),
    numbered in term order. At most `max_features` rows, written once. A first pass finds out which
    terms can be frequent enough; only those are shuffled and counted.
    """
    n = df.count() if rows is None else rows
    if params.max_df * n < params.min_df:
        raise ValueError(f"max_df admits fewer rows than min_df for {column}")
    return _vocabulary(term_counts(df, column, params.ngrams, open_=_open_slots(df, column, params, n)), params, n)


def _vocabulary(counts: DataFrame, params: TextParams, n: int) -> DataFrame:
    """The vocabulary of `n` rows from their term counts."""
    kept = counts.where(
        (F.col("df") >= params.min_df) & (F.col("df") <= F.lit(params.max_df * n))
    )
    top = kept.orderBy(F.desc("tf"), F.asc("term")).limit(params.max_features)
    # At most max_features rows, so one task may number them.
    place = F.row_number().over(Window.orderBy("term")) - 1
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0
    return cut_lineage(
        top.select("term", place.cast("int").alias("idx"), "tf", "df", idf.alias("idf"))
    )


def fit_text_features(df: DataFrame, spec: FeatureSpec) -> dict[str, tuple[DataFrame, TextParams]]:
    """Vocabulary per text column; unigrams only where the first try fails, else left out."""
    columns = present(df, spec.text)
    if not columns:
        return {}
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.length(text.strip(F.col(c))) > 0).alias(c) for c in columns],
    ).first()

    def fit(c: str) -> tuple[DataFrame, TextParams] | None:
        for params in (spec.text_params(c), spec.fallback_text):
            try:
                vocabulary = fit_tfidf(df, c, params, counts["_rows"])
            except ValueError:
                continue
            if not vocabulary.isEmpty():
                return vocabulary, params
        return None

    filled = [c for c in columns if counts[c] >= 2]
    # Columns do not wait for each other's last tasks.
    with ThreadPoolExecutor(FITTED_AT_ONCE) as pool:
        found = dict(zip(filled, pool.map(inheritable_thread_target(df.sparkSession)(fit), filled)))
    return {c: f for c, f in found.items() if f}


def _text_block(vocabulary: DataFrame, params: TextParams) -> TextBlock:
    # At most max_features rows.
    vocab = vocabulary.orderBy("idx").select("term", "idf").collect()
    return TextBlock([r["term"] for r in vocab], np.array([r["idf"] for r in vocab], np.float64), params.sublinear, params.ngrams)


@dataclass
class TextBlock:
    """Terms of one text column with their weights."""

    terms: list[str]
    idf: np.ndarray
    sublinear: bool
    sizes: tuple[int, int]

    def counts(self, tokens: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, place, occurrences) of the terms in texts or lists of words, by row and place."""
        size = max(1, len(self.terms))
        for first, words, row in _word_slices(tokens):
            keys = []
            for grams in _gram_keys(words, row, self.sizes):
                known = grams.keys(self.terms)
                order = np.argsort(known, kind="stable")
                at = np.minimum(np.searchsorted(known[order], grams.key), len(known) - 1) if len(known) else np.zeros(0, np.int64)
                met = np.flatnonzero(known[order][at] == grams.key) if len(known) else at
                keys.append(grams.row[met] * size + order[at[met]])
            found, tf = np.unique(np.concatenate(keys), return_counts=True)
            yield first + found // size, found % size, tf.astype(np.float64)

    def weigh(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of the entries that are not zero; each row has norm 1."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        row, place, tf = (np.concatenate(x) for x in zip(none, *self.counts(tokens)))
        weight = (1.0 + np.log(tf) if self.sublinear else tf) * self.idf[place]
        norm = np.sqrt(np.bincount(row, weight * weight, len(tokens)))
        return row, place, weight / norm[row]


def sparse_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, entries of each row, values) of unwrapped vectors, sparse or dense."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind, values, indices = (column.field(f) for f in ("type", "values", "indices"))
    ends, given = values.offsets.to_numpy(), indices.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    places = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    sparse = np.repeat(kind.to_numpy(zero_copy_only=False) == 0, sizes)
    places[sparse] = indices.values.to_numpy(zero_copy_only=False)[given[0] : given[-1]]
    return places.astype(np.int64), sizes, flat


def _long_weights(batches, block: TextBlock) -> Iterator[pa.RecordBatch]:
    """Keys, term and weight of every entry; the texts are the last column."""
    terms = pa.array(block.terms, pa.string())
    for batch in batches:
        row, place, weight = block.weigh(batch.column(batch.num_columns - 1))
        keys = [c.take(pa.array(row)) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*keys, terms.take(pa.array(place)), pa.array(weight)], [*batch.schema.names[:-1], "term", "weight"])


def transform_tfidf(
    df: DataFrame, column: str, key: Sequence[str], vocabulary: DataFrame, params: TextParams
) -> DataFrame:
    """(key..., term, weight): non-zero weights, each row of norm 1 (or absent)."""
    ship_sources(df.sparkSession)
    rows = spread(df.select(*key, column)).select(*key, _lowered(column).alias(_UNIGRAMS))
    schema = rows.drop(_UNIGRAMS).schema.add("term", "string").add("weight", "double")
    return rows.mapInArrow(partial(_long_weights, block=_text_block(vocabulary, params)), schema)


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_CATEGORY))


def fit_ordinal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): distinct values in code-point order, from 0."""
    values = long_values(df, present(df, columns), _category, name="column").distinct()
    return index_within(values, ["column"], ["value"], "code")


def ordinal_encode(
    df: DataFrame, codes: DataFrame, columns: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Replace (or, with a suffix, add) codes; unseen values get 0.

    Codes of proven small size go into one in-memory lookup for all columns.
    Otherwise each column is joined, broadcast or shuffled by size.
    """
    columns = present(df, columns)
    if not columns:
        return df
    if is_small(codes):
        by_column: dict[str, list[str]] = {c: [] for c in columns}
        for r in codes.orderBy("column", "code").collect():
            if r["column"] in by_column:
                by_column[r["column"]].append(r["value"])
        df = df.withColumns({f"_cat_{c}": _category(c) for c in columns})
        known = [c for c in columns if by_column[c]]
        model = StringIndexerModel.from_arrays_of_labels(
            [by_column[c] for c in known],
            inputCols=[f"_cat_{c}" for c in known],
            outputCols=[f"_code_{c}" for c in known],
            handleInvalid="keep",
        )
        df = model.transform(df)
        made = {
            f"{c}{suffix}": F.when(F.col(f"_code_{c}") < len(by_column[c]), F.col(f"_code_{c}"))
            .otherwise(0.0)
            .cast("bigint")
            if by_column[c]
            else F.lit(0).cast("bigint")
            for c in columns
        }
        return df.withColumns(made).drop(
            *[f"_cat_{c}" for c in columns], *[f"_code_{c}" for c in columns]
        )
    for c in columns:
        known = codes.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        df = (
            df.join(broadcast_if_small(known), _category(c) == F.col("_value"), "left")
            .withColumn(f"{c}{suffix}", F.coalesce("_code", F.lit(0).cast("bigint")))
            .drop("_value", "_code")
        )
    return df


def _number(df: DataFrame, column: str) -> Column:
    """The column as double; null, NaN and (in an aligned blank column) text as 0."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return number.coerce(F.col(column).cast("double"), T.DoubleType())
    return F.coalesce(number.parse(F.col(column)), F.lit(0.0))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of 0 counts as 1."""
    columns = present(df, columns)
    if not columns:
        return {}
    values = {c: _number(df, c) for c in columns}
    row = df.agg(
        *[
            a
            for i, c in enumerate(columns)
            for a in (F.avg(values[c]).alias(f"m{i}"), F.stddev_pop(values[c]).alias(f"s{i}"))
        ]
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, moments: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x - mean) / deviation with nulls as 0."""
    return df.withColumns(
        {
            f"{c}{suffix}": (_number(df, c) - F.lit(m)) / F.lit(s)
            for c, (m, s) in moments.items()
            if c in df.columns
        }
    )


@dataclass
class FittedFeatures:
    """Everything learned from the training rows; all of it of bounded size but `codes`."""

    texts: dict[str, tuple[DataFrame, TextParams]] = field(default_factory=dict)
    codes: DataFrame | None = None
    categorical: tuple[str, ...] = ()
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def names(self) -> list[str]:
        """Feature names in matrix order: text blocks, categories, numbers."""
        found = []
        for c, (vocabulary, _) in self.texts.items():
            found += [f"{c}={r['term']}" for r in vocabulary.orderBy("idx").select("term").collect()]
        return found + list(self.categorical) + list(self.moments)


def fit_features(df: DataFrame, spec: FeatureSpec) -> FittedFeatures:
    """Fit text, categorical and numeric blocks on the columns that are there."""
    inputs = df.drop(*spec.targets)
    categorical = present(inputs, spec.categorical)
    return FittedFeatures(
        texts=fit_text_features(inputs, spec),
        codes=fit_ordinal(inputs, categorical) if categorical else None,
        categorical=tuple(categorical),
        moments=fit_standard(inputs, spec.numeric),
    )


def _merged(parts: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """(n, mean, sum of squared deviations) of several sets of rows together."""
    n, mean, off = 0.0, 0.0, 0.0
    for m, other, spread_ in parts:
        if m:
            total, gap = n + m, other - mean
            off += spread_ + gap * gap * n * m / total
            n, mean = total, mean + gap * m / total
    return n, mean, off


def fit_fold_features(df: DataFrame, spec: FeatureSpec, fold: str, k: int) -> list[FittedFeatures]:
    """What `fit_features` finds on the rows outside each of the folds 0..k-1, from statistics kept per fold.

    Term counts and values are counted once by fold; training counts are the whole less the fold's own.
    Moments of the other folds are merged, which loses no digits to differences.
    """
    inputs = df.drop(*spec.targets)
    texts: list[dict] = _fold_texts(inputs, spec, fold, k)
    categorical, numeric = present(inputs, spec.categorical), present(inputs, spec.numeric)
    codes = _fold_codes(inputs, categorical, fold, k)
    values = {c: _number(inputs, c) for c in numeric}
    sums = [a for c in numeric for a in (F.count(values[c]), F.avg(values[c]), F.var_pop(values[c]) * F.count(values[c]))]
    moments: dict[int, list] = {}
    if numeric:
        # One row per fold.
        moments = {r[0]: list(r[1:]) for r in inputs.groupBy(fold).agg(*[a.alias(f"a{i}") for i, a in enumerate(sums)]).collect()}
    fitted = []
    for f in range(k):
        others = [m for g, m in moments.items() if g != f]
        merged = {c: _merged([tuple(x or 0.0 for x in m[3 * i : 3 * i + 3]) for m in others]) for i, c in enumerate(numeric)}
        scaled = {c: (mean, math.sqrt(off / n) or 1.0) if n else (0.0, 1.0) for c, (n, mean, off) in merged.items()}
        fitted.append(FittedFeatures(texts[f], codes[f], tuple(categorical), scaled))
    return fitted


def _fold_texts(df: DataFrame, spec: FeatureSpec, fold: str, k: int) -> list[dict]:
    columns = present(df, spec.text)
    filled = [F.count_if(F.length(text.strip(F.col(c))) > 0).alias(f"c{i}") for i, c in enumerate(columns)]
    # One row per fold.
    by_fold = {r[0]: list(r[1:]) for r in df.groupBy(fold).agg(F.count("*").alias("n"), *filled).collect()}
    whole = [sum(x) for x in zip(*by_fold.values())] or [0] * (1 + len(columns))
    counts: dict[tuple, DataFrame] = {}

    def counted(c: str, sizes: tuple[int, int]) -> DataFrame:
        if (c, sizes) not in counts:
            found = term_counts(df, c, sizes, [fold])
            own = [F.sum(F.when(F.col(fold) == f, F.col(x)).otherwise(0)).alias(f"{x}{f}") for f in range(k) for x in ("tf", "df")]
            counts[c, sizes] = stored(found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), *own), "fold-terms")
        return counts[c, sizes]

    out = []
    for f in range(k):
        own = by_fold.get(f, [0] * (1 + len(columns)))
        n, fitted = whole[0] - own[0], {}
        for i, c in enumerate(columns):
            if whole[1 + i] - own[1 + i] < 2:
                continue
            for params in (spec.text_params(c), spec.fallback_text):
                if params.max_df * n < params.min_df:
                    continue
                left = counted(c, params.ngrams).select("term", (F.col("tf") - F.col(f"tf{f}")).alias("tf"), (F.col("df") - F.col(f"df{f}")).alias("df"))
                vocabulary = _vocabulary(left, params, n)
                if not vocabulary.isEmpty():
                    fitted[c] = (vocabulary, params)
                    break
        out.append(fitted)
    return out


def _fold_codes(df: DataFrame, columns: list[str], fold: str, k: int) -> list[DataFrame | None]:
    if not columns:
        return [None] * k
    own = [F.count_if(F.col(fold) == f).alias(f"n{f}") for f in range(k)]
    # Counted by (column, value) before anything is shuffled.
    counts = long_values(df, columns, _category, name="column", keep=[fold]).groupBy("column", "value").agg(F.count("*").alias("n"), *own)
    counts = stored(counts, "fold-values")
    return [index_within(counts.where(F.col("n") > F.col(f"n{f}")).select("column", "value"), ["column"], ["value"], "code") for f in range(k)]


def assemble(
    df: DataFrame, fitted: FittedFeatures, keep: Sequence[str], name: str = "features"
) -> DataFrame:
    """(keep..., features): one compressed vector per row, without a shuffle.

    Input columns that are absent count as null, so the width is always that of training.
    """
    ship_sources(df.sparkSession)
    inputs = [*fitted.texts, *fitted.categorical, *fitted.moments]
    df = df.withColumns({c: F.lit(None).cast("string") for c in inputs if c not in df.columns})
    needed = [c for c in df.columns if c in {*keep, *inputs}]
    rows = df.select(*needed)
    texts: list[TextBlock] = []
    for i, (c, (vocabulary, params)) in enumerate(fitted.texts.items()):
        rows = rows.withColumn(f"_text{i}", _lowered(c))
        texts.append(_text_block(vocabulary, params))
    if fitted.categorical:
        rows = ordinal_encode(rows, fitted.codes, fitted.categorical, suffix="__code")
    rows = standardize(rows, fitted.moments, suffix="__std")
    plain = [*(f"{c}__code" for c in fitted.categorical), *(f"{c}__std" for c in fitted.moments)]
    numbers = F.array(*[F.col(c).cast("double") for c in plain]).cast("array<double>").alias("_numbers")
    rows = rows.select(*keep, *[f"_text{i}" for i in range(len(texts))], numbers)
    schema = df.select(*keep).schema.add(name, VectorUDT())
    return rows.mapInArrow(partial(_packed, texts=texts, plain=len(plain), name=name), schema)


def _packed(batches, texts: list[TextBlock], plain: int, name: str) -> Iterator[pa.RecordBatch]:
    """Kept columns and one sparse vector per row, from the texts and the plain numbers."""
    size = sum(len(t.terms) for t in texts) + plain
    for batch in batches:
        n, kept = batch.num_rows, batch.num_columns - len(texts) - 1
        parts, start = [], 0
        for i, block in enumerate(texts):
            row, place, weight = block.weigh(batch.column(kept + i))
            parts.append((row, place + start, weight))
            start += len(block.terms)
        numbers = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, plain)
        row, place = np.nonzero(numbers)
        parts.append((row, place + start, numbers[row, place]))
        row, place, value = (np.concatenate(x) for x in zip(*parts))
        # Blocks follow each other by place, so a stable sort by row leaves places in order.
        order = np.argsort(row, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
        vector = pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[order])),
            ],
            ["type", "size", "indices", "values"],
        )
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], vector], [*batch.schema.names[:kept], name])
