from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from alertloom.session import scratch_path
from llm.ranker import CUT_AT, scored
from brute import equal_texts, linked, without_repeats


def written(df):
    """As the pipeline passes a stage's output on: not among the scratch tables."""
    path = scratch_path(df.sparkSession, "test-stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, scores = docs.columns, {r.id: r.score for r in scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~corpus_pipeline.held_out("doc_id"))).collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if name == "quality":
            want = {i: t for i, t in want.items() if scores[i] >= CUT_AT}
        elif name == "exact":
            want = {i: want[i] for i in equal_texts(want)}
        elif name == "near":
            top = linked(want, 5, 80)
            want = {i: t for i, t in want.items() if top[i] == i}
        elif name == "passages":
            want = without_repeats(want, 50)
        else:
            break
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, used = defaultdict(list), Counter()
    for r in docs.collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    assert {i: sum((x for _, x in sorted(v)), []) for i, v in got.items()} == {
        i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in want.items()
    }


def test_clashing_columns_pass_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = {"kept": "doc_id", "id": "text", "component_id": "lang", "text_left": "source", "removed": "n_chars"}
    wide = docs.withColumns({name: F.col(c) for name, c in more.items()})
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = (written(stage(spark, d, sf_dir)) for d in (wide, plain))
        assert wide.columns == [*docs.columns, *more]
        rows = [{tuple(r) for r in d.select(*docs.columns).collect()} for d in (wide, plain)]
        assert rows[0] == rows[1], name


def test_repeated_null_and_empty_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", None, "s", 5), (1, "a b c", None, "s", 5), (2, None, "en", "s", 0), (3, "A B C", "en", None, None), (None, "lone text", "en", "s", 9)]
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)))
        assert sorted({str(r.doc_id) for r in docs.collect()}) == (["2", "3", "None"] if given else [])
