import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm import sharding
from llm.sharding import shard_records, write_shards


def records(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    text = F.coalesce("text", F.lit(""))
    return df.select("id", (F.octet_length(text) + 16).cast("long").alias("size"), F.xxhash64(text).alias("group_key"))


def check(rows, shards, out):
    assert Counter(r.id for r in out) == Counter(i for i, _ in rows)
    slots, bytes_of = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= k < shards for k in slots)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for k in range(shards):
        assert abs(bytes_of[k] - total / shards) <= max(largest, total / shards / 100) + 1


def test_sizes_are_near_equal_with_a_hot_group(spark):
    rows = [(i, "hot text of some words") for i in range(700)]
    rows += [(i, "w%d " % (i * 7919 % 1000) * (1 + i % 37)) for i in range(700, 2000)] + [(2000, None), (2001, ""), (None, "n")]
    out = shard_records(records(spark, rows), 8).collect()
    check(rows, 8, out)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 2} " * 3) for i in range(4000)]
    out = shard_records(records(spark, rows), 4).collect()
    shards = defaultdict(set)
    for r in out:
        shards[r.group_key].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_repeatable_few_rows_and_empty(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, "long " * 9000)]
    first, again = (sorted(map(tuple, shard_records(records(spark, rows), 3).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == 4
    assert shard_records(records(spark, rows).limit(0), 3).collect() == []


def test_written_shards_hold_whole_records(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assigned = shard_records(records(spark, rows), 4)
    write_shards(docs, assigned, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert {(r.doc_id, r.text) for r in back} == set(rows)


def test_written_shards_with_odd_ids_and_clashing_columns(spark, documents, tmp_path):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (2, None), (1, "long " * 9000)] + [(3, f"t{i}") for i in range(40)]
    docs = documents(rows).withColumn("slot", F.lit("own"))
    write_shards(docs, shard_records(records(spark, rows), 3), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    got = back.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert {r["_shard"] for r in got} == {5} and {r["_slot"] for r in got} == {"own"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    write_shards(docs.limit(0), shard_records(records(spark, rows).limit(0), 3), str(tmp_path / "none"))


def test_query_columns(spark, sf_dir):
    from llm.queries import op1_sharding

    out = op1_sharding(spark, sf_dir)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = out.collect()
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.size == len(docs[r.doc_id].encode()) + 16 for r in got)
    assert sorted(r.doc_id for r in got) == sorted(docs)


def test_many_ranges_keep_the_law_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 15)
    monkeypatch.setattr(sharding, "SAMPLE", 100)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 5} ") for i in range(3000)] + [(3000, "long " * 60)]
    out = shard_records(records(spark, rows), 6).collect()
    check(rows, 6, out)
    text, shards = dict(rows), defaultdict(set)
    for r in out:
        shards[text[r.id]].add(r.shard)
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot text") and len(shards["hot text"]) > 1


def test_sampled_keys_are_bounded_and_follow_sizes(spark):
    rows = spark.range(20000).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("key"), F.when(F.col("id") < 10000, 9).otherwise(1).alias("size"))
    keys = sharding._weighted_keys(rows, 1000, 100000, 1)
    assert 800 <= len(keys) <= 1000 and len(set(keys)) == len(keys)
    assert 0.85 < sum(k < "k010000" for k in keys) / len(keys) < 0.95
