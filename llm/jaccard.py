"""Exact Jaccard self-join on word shingles by a grouped prefix join, reduced to linked classes.

Equal sets are one set first. A set's shingles are ordered from rare to common, so that two sets
that link share a shingle of their prefixes. Sets with the same prefix and size are collapsed into one
group; groups are paired through prefix shingles and filtered by size and by the places of
the shared shingle; then groups are expanded and their members verified on their whole sets.

Pairs are made in two steps, so that a large family of near copies does not give all its pairs. First
every group meets the group of a shingle's list that holds the shingle earliest, and every member meets
the first one of its group. Then only pairs of members that are not yet in one component are made. No link
between components is lost: every pair that the filter lets pass is either verified or already connected.

Every set has a parity bitmap of its shingles. Two bitmaps differ in no more places than the sets do, so a
pair that differs in more places than a link allows is left out before any text is moved.

The order of shingles is free; it only decides how much work there is. It is taken from counts of the
shingles that repeat within a task, the most frequent `ORDERED` of them.

Edge cases: null and empty texts and texts of white space have no shingles and link with nothing; a text
of fewer words than a shingle is one shingle; repeated rows are equal sets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import hash_sample, landed
from llm.components import components
from llm.words import Words, mix, word_slices

#: Most frequent shingles that are told apart by count: 16 bytes each in every worker.
ORDERED = 1 << 19
#: Larger counts are not told apart when shingles are picked.
MANY = 1 << 16
#: A shingle with fewer copies counts as rare.
RARE = 4
#: Least bits of a set's parity bitmap, and bits of the bitmap of ids whose texts are read again (2 MB).
BITS = 512
PLACES = 1 << 24


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text: (text, hash), sorted by text."""
    counts = np.diff(words.first)
    texts = np.repeat(np.arange(len(counts)), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1)))
    full = counts >= k
    hashes = np.zeros(len(texts), np.uint64)
    if len(texts):
        grams = words.grams(k)
        place = np.arange(len(texts)) - np.searchsorted(texts, texts) + words.first[texts]
        whole = full[texts]
        hashes[whole] = grams[place[whole]]
        for i in np.flatnonzero(~whole):  # a short text is one shingle
            a, b = words.first[texts[i]], words.first[texts[i] + 1]
            one = Words(words.data, words.starts[a:b], words.ends[a:b], np.array([0, b - a]), words.hashes[a:b])
            hashes[i] = one.grams(int(b - a))[0] + np.uint64(b - a)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[new], hashes[new]


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Shingles that repeat within a task, with their counts there."""
    held: list[np.ndarray] = []

    def counted():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > 1
        held.clear()
        return pa.record_batch([pa.array(values[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

    for batch in batches:
        for _, _, words in word_slices(batch.column(0), lower=True):
            held.append(shingles(words, k)[1])
            if sum(map(len, held)) > 2_000_000:
                yield counted()
    if held:
        yield counted()


def _prefixes(batches, k: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """Size, digest of the set, and prefix of each text."""
    known, classes = order.value
    for batch in batches:
        for lo, hi, words in word_slices(batch.column(1), lower=True):
            texts, hashes = shingles(words, k)
            rank = np.zeros(len(hashes), np.uint8)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rank = np.where(known[at] == hashes, classes[at], 0)
            arranged = np.lexsort((hashes, rank, texts))
            edges = np.searchsorted(texts, np.arange(hi - lo + 1))
            n = np.diff(edges)
            keep = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)
            index = np.arange(len(texts)) - edges[texts]
            prefix = hashes[arranged][index < keep[texts]].view(np.int64)
            sums = []
            for salt in (0x1234567, 0x89ABCDE):
                total = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(mix(hashes + np.uint64(salt)), out=total[1:])
                sums.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32), pa.array(prefix))
            # A power of two of at least one bit a shingle; larger maps fold onto smaller ones.
            size = BITS << np.ceil(np.log2(np.maximum(n, BITS) / BITS)).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)])
            bit = (mix(hashes) % size[texts].astype(np.uint64)).astype(np.int64) + begin[texts]
            odd = np.bincount(bit, minlength=begin[-1]) & 1
            bits = pa.ListArray.from_arrays((begin // 64).astype(np.int32), pa.array(np.packbits(odd.astype(bool)).view(np.int64)))
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists, bits],
                ["id", "n", "d1", "d2", "prefix", "bits"],
            )


def _whole_sets(batches, k: int, wanted) -> Iterator[pa.RecordBatch]:
    """The whole sets of the rows whose place is marked."""
    for batch in batches:
        place = batch.column(2).to_numpy()
        marked = wanted.value[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)
        batch = batch.filter(pa.array(marked.astype(bool)))
        for lo, hi, words in word_slices(batch.column(1), lower=True):
            texts, hashes = shingles(words, k)
            edges = np.searchsorted(texts, np.arange(hi - lo + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(edges, pa.array(hashes.view(np.int64)))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], ["id", "tokens"])


def _top(often: DataFrame) -> DataFrame:
    """At most ORDERED shingles of the largest counts; of those at the border, and of counts beyond MANY, the ones a hash picks.

    The counts' histogram tells where the border is, so nothing is sorted whole and one task gets no more rows than wanted.
    """
    count = F.least("n", F.lit(MANY))
    # At most MANY rows.
    sizes = sorted(((r.c, r.k) for r in often.groupBy(count.alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    taken = 0
    for c, k in sizes:
        if taken + k > ORDERED:
            border = hash_sample(often.where(count == c), ORDERED - taken, k, "token")
            return often.where(count > c).union(border.select(*often.columns))
        taken += k
    return often


def _order(rows: DataFrame, k: int):
    """Sorted frequent shingles and their count classes, for all workers: at most 9 bytes times ORDERED."""
    counted = rows.select("text").mapInArrow(partial(_frequent, k=k), "token long, n long")
    often = landed(counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE), "often")
    top = _top(often).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    classes = np.floor(np.log2(np.maximum(top.column("n").to_numpy(), 1))).astype(np.uint8)
    by_token = np.argsort(tokens)
    return rows.sparkSession.sparkContext.broadcast((tokens[by_token], classes[by_token]))


def _may_link(percent: int):
    """Two sets with a prefix shingle in common at places ka and kb can be similar enough."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return (
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= need)
    )


def _near_bits(percent: int):
    """Bitmaps a set's link partner can have; null bitmaps tell nothing."""

    def folded(own: str, other: str):
        half = (F.size(own) / 2).cast("int")
        fold = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), fold).otherwise(F.col(own))

    # Sizes of possible partners are a step apart at most, as their maps are.
    places = F.zip_with(folded("bits_a", "bits_b"), folded("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(places, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return F.isnull("bits_a") | F.isnull("bits_b") | (differing <= F.col("na") + F.col("nb") - 2 * need)


def _marked(ids: DataFrame):
    """A bitmap of hashed ids for all workers, of PLACES bits whatever the number of ids.

    It only spares rows the way through a shuffle: those it lets pass by chance fall out of the join.
    """
    place = ids.select(F.pmod(F.xxhash64("id"), F.lit(PLACES)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 AS int)))").alias("bits"))
    found, bitmap = words.toArrow(), np.zeros(PLACES // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that link: by their bitmaps first, then by their whole sets."""
    of_a = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    of_b = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    pairs = pairs.distinct().join(of_a, "a").join(of_b, "b").where(_near_bits(percent)).select("a", "b")
    pairs = landed(pairs, "pairs")
    ids = landed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    placed = rows.where("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(PLACES)).alias("place"))
    whole = placed.mapInArrow(partial(_whole_sets, k=k, wanted=_marked(ids)), "id long, tokens array<long>")
    sets = landed(whole.join(ids, "id").groupBy("id").agg(F.first("tokens").alias("tokens")), "whole-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = _order(rows, k)
    found = landed(
        rows.mapInArrow(
            partial(_prefixes, k=k, percent=percent, order=order), "id long, n long, d1 long, d2 long, prefix array<long>, bits array<long>"
        ),
        "prefixes",
    )
    # Equal sets: the row with the smallest id stands for them.
    same = ["n", "d1", "d2"]
    sets = found.where("n > 0").groupBy(same).agg(F.min("id").alias("set_id"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    sets = landed(sets.where("set_id IS NOT NULL").withColumn("p", F.xxhash64("prefix")), "sets")
    # Sets of equal prefix and size: one group, named by its first member.
    groups = landed(
        sets.groupBy("n", "p").agg(
            F.min("set_id").alias("gid"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("members"),
            F.when(F.count(F.lit(1)) == 1, F.first("bits")).alias("bits"),
        ),
        "groups",
    )
    members = landed(sets.select("set_id", "n", "p").join(groups.select("n", "p", "gid", "members"), ["n", "p"]).select("set_id", "gid", "members"), "members")

    postings = groups.select("gid", "n", F.posexplode("prefix").alias("k", "token"))
    hubs = postings.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("k", "gid", "n")).alias("hub"))
    hubs = landed(hubs.where("groups > 1"), "hubs")
    shared = landed(postings.join(hubs, "token"), "shared-postings")

    # First step: each group with its hubs, each member with the first of its group.
    star = shared.select(
        F.col("hub.gid").alias("ga"), F.col("hub.n").alias("na"), F.col("hub.k").alias("ka"),
        F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("k").alias("kb"),
    ).where("ga <> gb").where(_may_link(percent)).select("ga", "gb")
    first = star.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).union(
        members.where("set_id <> gid").select("gid", "set_id")
    )
    near = landed(components(_verified(first, sets, rows, k, percent)), "first-components")

    # Second step: pairs between components. A group that lies in one component passes it on.
    placed = landed(
        members.join(near.withColumnRenamed("id", "set_id"), "set_id", "left")
        .select("gid", "set_id", "members", F.coalesce("component", "set_id").alias("component")),
        "placed-members",
    )
    whole = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    whole = whole.select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).alias("in"))
    met = shared.drop("hub", "groups").join(whole, "gid")
    met = landed(met, "met")
    open_tokens = met.groupBy("token").agg(F.min("in").alias("low"), F.max("in").alias("high"), F.max(F.isnull("in")).alias("mixed"))
    met = landed(met.join(open_tokens.where("low <> high OR mixed").select("token"), "token"), "open-postings")
    a = met.select("token", F.col("gid").alias("ga"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("in").alias("in_a"))
    b = met.select("token", F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("in").alias("in_b"))
    apart = F.isnull("in_a") | F.isnull("in_b") | (F.col("in_a") != F.col("in_b"))
    between = a.join(b, (a.token == b.token) & (F.col("ga") < F.col("gb")) & apart & _may_link(percent)).select("ga", "gb")
    inside = placed.where("members > 1").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    bits_a = groups.select(F.col("gid").alias("ga"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    bits_b = groups.select(F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    between = landed(between.distinct(), "group-pairs").join(bits_a, "ga").join(bits_b, "gb").where(_near_bits(percent)).select("ga", "gb")
    candidates = landed(between.union(inside).distinct(), "near-group-pairs")
    of_a = placed.select(F.col("gid").alias("ga"), F.col("set_id").alias("a"), F.col("component").alias("ca"))
    of_b = placed.select(F.col("gid").alias("gb"), F.col("set_id").alias("b"), F.col("component").alias("cb"))
    rest = candidates.join(of_a, "ga").join(of_b, "gb").where("ca <> cb AND (ga <> gb OR a < b)")
    rest = landed(rest.select("a", "b", "ca", "cb"), "open-pairs")
    links = _verified(rest.select("a", "b"), sets, rows, k, percent).join(rest, ["a", "b"])
    joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = placed.join(joined.select(F.col("id").alias("component"), F.col("component").alias("last")), "component", "left")
    final = landed(final.select("set_id", F.coalesce("last", "component").alias("component_id")), "components")

    named = sets.select(*same, "set_id").join(final, "set_id").drop("set_id")
    named = landed(named, "named-sets")
    return found.drop("prefix", "bits").join(named, same, "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
