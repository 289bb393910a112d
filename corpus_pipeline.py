"""From raw documents to packed training sequences, one written table after the other.

Each stage works on all rows that the one before it kept and returns the columns of `documents`; the
last returns the pieces of packed sequences with their token ids. A stage's input has been written when the next
begins, so each stage first removes the scratch tables of those before it. Edge cases are those of the operators;
rows with a null doc_id pass the filters, repeated rows become one in the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import broadcast_if_small, scratch_path
from llm.common import forget_scratch, free_name, landed
from llm.exact import exact_groups
from llm.jaccard import linked_classes
from llm.packing import pack
from llm.phrases import repeated_passages
from llm.queries import held_out, table
from llm.ranker import CUT_AT, scored


def _begin(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of a stage; what earlier stages left in the scratch folder goes, but for files of `docs`."""
    forget_scratch(spark, docs.inputFiles())
    return docs


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in the written `ids` (column id).

    A list of checked size goes to the texts; only a longer one moves them.
    """
    gone = ids.select(F.col("id").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the ranker scores below its cut."""
    docs = _begin(spark, docs)
    scores = scored(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return _without(docs, landed(scores.where(F.col("score") < CUT_AT).select("id"), "rejected"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id, once."""
    docs = _begin(spark, docs)
    groups = landed(exact_groups(docs).select("id", "kept"), "exact")
    left = _without(docs, groups.where("NOT kept"))
    again = groups.where("kept AND id IS NOT NULL").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id")
    again = landed(again, "repeated")
    if again.isEmpty():
        return left
    again = broadcast_if_small(again)
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity of 0.8 or more) keep the smallest doc_id."""
    docs = _begin(spark, docs)
    classes = landed(linked_classes(docs, k=5, percent=80).where("id <> component_id").select("id"), "near")
    return _without(docs, classes)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 words or more that an earlier document has; n_chars follows.

    Changed texts come with their ids and meet the other columns of their rows; other texts stay where they are.
    """
    docs = _begin(spark, docs)
    left = free_name(docs, "text_left")
    found = repeated_passages(docs).where("kept IS NOT NULL").select(F.col("id").alias("doc_id"), F.col("kept").alias(left))
    changed = landed(found.dropDuplicates(["doc_id"]), "changed")
    about = docs.drop("text", "n_chars").join(changed, "doc_id")
    edited = about.withColumn("n_chars", F.length(left).cast(docs.schema["n_chars"].dataType)).withColumnRenamed(left, "text")
    rest = _without(docs, changed.select(F.col("doc_id").alias("id")))
    return rest.unionByName(edited.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences."""
    docs = _begin(spark, docs)
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: A classifier and token ids are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made, path = stage(spark, docs, sf_dir), scratch_path(spark, f"stage-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
