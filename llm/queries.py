"""The queries of this folder; each derives its columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import scratch_path
from llm import bpe
from llm.chat import conversation_digests, read_chat, write_chat
from llm.collocations import best_of_each, collocations
from llm.common import ship
from llm.exact import exact_groups
from llm.jaccard import linked_classes
from llm.lm import stupid_backoff
from llm.negatives import mine_negatives
from llm.neighbours import build, search
from llm.packing import pack
from llm.phrases import repeated_passages
from llm.ranker import CUT_AT, scored
from llm.sharding import shard_records
from llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
    )
    return shard_records(rows, 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return search(build(embeddings), embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(table(spark, sf_dir, "documents"), k=3, percent=90).withColumnRenamed("id", "doc_id")


#: Micro-batches of the stream of digests: all but the first meet kept digests.
OP5_BATCHES = 3


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), batches=OP5_BATCHES)
    return groups.withColumnRenamed("id", "doc_id")


OP5_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents
), g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""

def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url", "payload")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stupid_backoff(table(spark, sf_dir, "documents"))
    return scores.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 3).alias("log_score"))


def op7_lm_scoring_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams too: chains of back-offs, from three words to two to one."""
    scores = stupid_backoff(table(spark, sf_dir, "documents"), order=3)
    return scores.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 3).alias("log_score"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), one AS (SELECT w, count(*) AS c FROM w GROUP BY w),
t AS (SELECT b.doc_id, b.i, b.w, a.w AS v FROM w b LEFT JOIN w a ON a.doc_id = b.doc_id AND a.i = b.i - 1),
two AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT t.doc_id, CASE
    WHEN two.c >= 2 THEN ln(two.c / before.c)
    WHEN t.v IS NULL THEN ln(one.c / n.n)
    ELSE ln(0.4) + ln(one.c / n.n) END AS s
  FROM t JOIN one ON one.w = t.w LEFT JOIN one AS before ON before.w = t.v
  LEFT JOIN two ON two.v = t.v AND two.w = t.w CROSS JOIN n
)
SELECT d.doc_id, count(s.s) AS n_words, round(coalesce(sum(s.s), 0), 3) AS log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"),
        F.coalesce(F.sha2("kept", 256), F.col("words_sha256")).alias("kept_sha256"),
    )


def held_out(doc_id: str) -> Column:
    """A fifth of the ids, by checksum; their labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scores = scored(table(spark, sf_dir, "documents"), labels)
    return scores.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT_AT).cast("int").alias("predicted"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_of_each(collocations(table(spark, sf_dir, "documents")), 2000)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 6) AS s(size)),
f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM grams) GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
cuts AS (
  SELECT c.lang, c.phrase, k, a, l.f AS l, r.f AS r, totals.n, (1000::HUGEINT * a * totals.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN range(1, 5) AS t(k) ON k < c.size JOIN totals ON totals.lang = c.lang
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')
), inside AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, ws, m, unnest(range(1, size - m + 2)) AS i FROM c JOIN range(2, 5) AS t(m) ON m < c.size)
), gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN gone USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


#: A text of nothing but control strings, said and answered.
PLANTED = "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], columns)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    folder = scratch_path(spark, "chat")
    write_chat(rows, folder)
    order = spark.read.parquet(f"{folder}/conversations").select(F.col("conv_id").alias("_id"), "valid")
    digests = conversation_digests(read_chat(spark, folder))
    return digests.join(order, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, list_sum([(length(x) - length(replace(x, c, ''))) // length(c) FOR c IN
    ['\', '<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '[ROLE]', '[TEXT]', '[/ROLE]']]) AS marks
  FROM (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN text ELSE role || chr(10) || text END AS x FROM t)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + marks + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10
    ELSE length(role) + 25 END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
    ORDER BY turn, role), 's?(ua)+') AS valid
FROM e GROUP BY conv_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_nn_descent": op2_nn_descent,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_lm_scoring": op7_lm_scoring,
    "op7_lm_scoring_order3": op7_lm_scoring_order3,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_chat": op12_chat,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op7_lm_scoring": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_chat": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
