"""An alert table put together from the star-schema test tables.

One row per document; nulls, null words, stray spaces and unparsable numbers are put
in on purpose, because the tables themselves are clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat alert table, columns as in `ALERTS_SQL`."""
    t = {n: table(spark, sf_dir, n) for n in ("documents", "orders", "customer", "nation", "labels", "conversations")}
    # All turns in order; a conversation is a handful of rows.
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    spoken = t["conversations"].groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("spoken"))
    joined = (
        t["documents"]
        .join(t["orders"], F.col("o_orderkey") == F.col("doc_id"), "left")
        .join(t["customer"], F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t["labels"], "doc_id", "left")
        .join(spoken, F.col("conv_id") == F.col("doc_id"), "left")
    )
    return joined.selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])


_LANDED: dict[tuple[str, str], str] = {}


def landed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table written once per session, for jobs that read their input several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        path = scratch_path(spark, "alerts")
        alerts(spark, sf_dir).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


# The expressions hold in Spark and in DuckDB alike.
COLUMNS = {
    "hit__hit_id": "concat('2024-', CAST(doc_id AS VARCHAR(20)))",
    "message_id": "CAST(floor(doc_id / 4) AS BIGINT)",
    "hit__matching_text": (
        "CASE doc_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'nan' "
        "WHEN 2 THEN concat('  ', text, ' ') ELSE text END"
    ),
    "hit__watchlist_text": "spoken",
    "mt103__sanction_list": "source",
    "hit__is_pep": (
        "CASE doc_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' "
        "WHEN 3 THEN 'false' WHEN 4 THEN '1' WHEN 5 THEN '0' END"
    ),
    "hit__hit_type": "o_orderstatus",
    "hit__matching_type": "lower(c_mktsegment)",
    "hit__priority": "CASE doc_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'Medium' WHEN 2 THEN 'high' END",
    "hit__severity": (
        "CASE doc_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN ' MEDIUM ' WHEN 2 THEN 'HIGH' "
        "WHEN 3 THEN 'NULL' END"
    ),
    "hit__country": "n_name",
    "hit__mt_type": "CASE doc_id % 3 WHEN 0 THEN 'MT103' WHEN 1 THEN 'MT202' END",
    "hit__score": (
        "CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'abc' "
        "ELSE CAST(doc_id % 100 AS VARCHAR(10)) END"
    ),
    "hit__fuzzy_match_score": "CAST((doc_id * 7) % 100 AS DOUBLE) / 100",
    "mt202__amount": "CASE WHEN doc_id % 50 = 0 THEN o_totalprice * 100 ELSE o_totalprice END",
    "mt103__hits_count_103": "CAST(n_chars % 10 AS INT)",
    "mt202__hits_count_202": "CAST(doc_id % 6 AS INT)",
    "mt202__charges": "c_acctbal",
    "mt103__reference": "CAST(o_custkey AS VARCHAR(20))",
    "mt103__city": "CASE WHEN doc_id % 2 = 0 THEN concat('o''', lower(c_mktsegment), ' 1st') END",
    "mt202__value_date": "CAST(NULL AS VARCHAR(10))",
    "hit__review_decision": "lang",
    "hit__review_comments": (
        "CASE WHEN doc_id % 11 = 0 THEN NULL "
        "ELSE concat('comment ', CAST((doc_id * 37) % 151 AS VARCHAR(10))) END"
    ),
    "decision__last_action": "CASE quality WHEN 1 THEN 'RELEASE' WHEN 0 THEN 'BLOCK' END",
    "decision__reviewer_comments": "CASE toxic WHEN 1 THEN 'escalate' WHEN 0 THEN 'no issue' END",
}

ALERTS_SQL = (
    "SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
    + " FROM (SELECT d.*, o.*, c.*, n.*, l.quality, l.toxic, w.spoken"
    " FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id"
    " LEFT JOIN customer c ON c.c_custkey = o.o_custkey"
    " LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"
    " LEFT JOIN labels l ON l.doc_id = d.doc_id"
    " LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS spoken"
    " FROM conversations GROUP BY conv_id) w ON w.conv_id = d.doc_id)"
)
