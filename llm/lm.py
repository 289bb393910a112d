"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus, as Spark joins.

    S(w | v) = c(v w) / c(v)        if c(v w) >= min_count
             = backoff * S(w)       otherwise,     S(w) = c(w) / words of the corpus

and likewise for longer contexts. N-grams do not cross documents; a document's first words have
shorter contexts and no penalty for that.

Count tables: n-grams of every length up to the order are exploded, counted within a slice of texts, and added up
by n-gram. The score of a distinct n-gram then comes from a join of its table with that of the next shorter ones: by the
context if the n-gram counts, else by the n-gram without its first word. So a chain of back-offs is walked once for each
distinct n-gram, not for each place. Documents are exploded again, each place as the longest n-gram that ends
there, equal ones of a document together; a join by n-gram gives their scores, summed per document. Tables are
partitioned by the n-gram's hash; a frequent n-gram is one row of its table, and its many rows on the side of the
documents are split by adaptive execution.

Edge cases: null and empty texts have no words and score 0; repeated rows count each, are scored together and
listed each; very long texts are exploded whole; an empty table gives no rows; other columns are not looked at.
N-grams are told apart by 64-bit hashes, and so are rows (id and text): at 10**9 distinct n-grams, the chance that
any two of them meet is about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import landed, ship
from llm.words import Words, word_slices

BACKOFF = 0.4
MIN_COUNT = 2
ORDER = 2


def _ending(words: Words, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The longest n-gram that fits before each word's end, and for each n the hashes of the n-grams by their last word."""
    size = len(words.hashes)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    room = np.minimum(np.arange(size) - words.first[text] + 1, order)
    ending = [words.hashes]
    for n in range(2, order + 1):
        grams = np.zeros(size, np.uint64)
        found = words.grams(n)
        grams[size - len(found) :] = found
        # Equal values of different lengths stay apart, as far as a hash can tell.
        ending.append(grams ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))
    return room, ending


def _counted(batches, order: int) -> Iterator[pa.RecordBatch]:
    """(n, gram, context, rest, c): n-grams of each slice of texts; `rest` lacks the first word."""
    for batch in batches:
        for _, _, words in word_slices(batch.column(0)):
            room, ending = _ending(words, order)
            for n in range(1, order + 1):
                last = np.flatnonzero(room >= n)
                grams, first, counts = np.unique(ending[n - 1][last], return_index=True, return_counts=True)
                last = last[first]
                shorter = ending[n - 2] if n > 1 else np.zeros(len(room), np.uint64)
                columns = [np.full(len(grams), n, np.int32), *(x.view(np.int64) for x in (grams, shorter[last - 1], shorter[last])), counts]
                yield pa.record_batch([pa.array(x) for x in columns], ["n", "gram", "context", "rest", "c"])


def _placed(batches, order: int) -> Iterator[pa.RecordBatch]:
    """(doc, gram, m): how often each longest n-gram ends in a document."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for lo, hi, words in word_slices(batch.column(1)):
            room, ending = _ending(words, order)
            grams = np.choose(room - 1, ending) if len(room) else words.hashes
            text = np.repeat(np.arange(hi - lo), np.diff(words.first))
            by = np.lexsort((grams, text))
            grams, text = grams[by], text[by]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])]))
            m = np.diff(np.append(starts, len(by)))
            columns = [docs[lo:hi][text[starts]], grams[starts].view(np.int64), m.astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in columns], ["doc", "gram", "m"])


def gram_scores(texts: DataFrame, order: int, min_count: int, backoff: float) -> list[DataFrame]:
    """For each n up to the order, (gram, c, score): the n-grams of the corpus, their counts and log scores."""
    exploded = texts.mapInArrow(partial(_counted, order=order), "n int, gram long, context long, rest long, c long")
    # Context and rest follow from the n-gram.
    grams = exploded.groupBy("n", "gram").agg(F.sum("c").alias("c"), F.min("context").alias("context"), F.min("rest").alias("rest"))
    grams = landed(grams, "lm-grams", ["n"])
    corpus = grams.where("n = 1").agg(F.sum("c")).first()[0] or 1
    tables: list[DataFrame] = []
    for n in range(1, order + 1):
        own = grams.where(F.col("n") == n).drop("n")
        if n == 1:
            scored = own.select("gram", "c", (F.log("c") - float(np.log(corpus))).alias("score"))
        else:
            counts = F.col("c") >= min_count
            lower = tables[-1].select(F.col("gram").alias("key"), F.col("c").alias("key_c"), F.col("score").alias("key_score"))
            joined = own.withColumn("key", F.when(counts, F.col("context")).otherwise(F.col("rest"))).join(lower, "key")
            scored = joined.select(
                "gram", "c", F.when(counts, F.log("c") - F.log("key_c")).otherwise(F.col("key_score") + float(np.log(backoff))).alias("score")
            )
        tables.append(landed(scored, f"lm-scores-{n}"))
    return tables


def stupid_backoff(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    min_count: int = MIN_COUNT, backoff: float = BACKOFF,
) -> DataFrame:
    """One row per input row: id, n_words, log_score (natural logarithm, summed over the words)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("id", "text"))
    tables = [t.select("gram", "score") for t in gram_scores(rows.select("text"), order, min_count, backoff)]
    placed = rows.select("doc", "text").mapInArrow(partial(_placed, order=order), "doc long, gram long, m int")
    scored = placed.join(reduce(DataFrame.union, tables), "gram")
    sums = scored.groupBy("doc").agg(F.sum(F.col("m") * F.col("score")).alias("total"), F.sum("m").alias("words"))
    listed = landed(rows.select("id", "doc"), "lm-rows")
    # Equal rows were added up together.
    copies = listed.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
    each = landed(sums.join(copies, "doc").select("doc", (F.col("words") / F.col("copies")).cast("long").alias("words"), (F.col("total") / F.col("copies")).alias("total")), "lm-sums")
    return listed.join(each, "doc", "left").select(
        "id", F.coalesce("words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("total", F.lit(0.0)).alias("log_score")
    )
