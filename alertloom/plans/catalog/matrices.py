"""Queries for the feature matrix of the documents and the features that tell its classes apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import models, vectors
from alertloom.plans.alerts import table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.plans.catalog.vectorising import VOCABULARY
from alertloom.session import stored
from alertloom.spec import FeatureSpec

SPEC = FeatureSpec(
    text=("text",), categorical=("lang", "source"), numeric=("n_chars",), hit_targets=(), message_targets=(), order=("doc_id",)
)
WEIGHED = [
    *VOCABULARY,
    (
        "raw",
        "SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2) "
        "JOIN (SELECT term, idf FROM vocabulary) USING (term)",
    ),
    ("weighed", "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw"),
]


def _codes(column: str) -> str:
    value = f"coalesce({column}, 'Unknown')"
    return (
        f"SELECT doc_id, '{column}' AS feature, code::DOUBLE AS value FROM documents JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code "
        f"FROM (SELECT DISTINCT {value} AS v FROM documents)) ON v = {value} WHERE code <> 0"
    )


@query("T7", sql.with_ctes(
    WEIGHED,
    f"SELECT doc_id, 'text=' || term AS feature, {sql.fixed('w')} AS value FROM weighed UNION ALL {_codes('lang')} UNION ALL {_codes('source')} "
    f"UNION ALL SELECT doc_id, 'n_chars' AS feature, {sql.fixed('(n_chars - m) / s')} AS value FROM documents "
    "CROSS JOIN (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents) WHERE n_chars <> m",
))
def assemble_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    fitted = vectors.fit_features(documents, SPEC)
    matrix = vectors.assemble(documents, fitted, ["doc_id"])
    # One name per feature; the matrix is bounded.
    names = spark.createDataFrame(list(enumerate(fitted.names())), "i int, feature string")
    long = matrix.select("doc_id", F.unwrap_udt("features").alias("v")).select("doc_id", "v.indices", "v.values")
    entries = F.arrays_zip("indices", "values")
    long = long.select("doc_id", F.explode(entries).alias("e")).select("doc_id", F.col("e.indices").alias("i"), F.col("e.values").alias("value"))
    return rounded(long.join(F.broadcast(names), "i").select("doc_id", "feature", "value"))


@query("M4", sql.with_ctes(
    [
        *WEIGHED,
        ("sizes", "SELECT coalesce(lang, 'none') AS c, count(*) AS n FROM documents GROUP BY 1"),
        (
            "sums",
            "SELECT term, c, sum(w) AS s, sum(w * w) AS q FROM weighed JOIN (SELECT doc_id, coalesce(lang, 'none') AS c FROM documents) USING (doc_id) "
            "GROUP BY 1, 2",
        ),
        ("whole", "SELECT count(*) AS k, sum(n) AS n FROM sizes"),
        (
            "parts",
            "SELECT term, greatest(sum(s * s / sizes.n) - sum(s) * sum(s) / any_value(whole.n), 0) AS b, greatest(sum(q) - sum(s * s / sizes.n), 0) AS w, "
            "any_value(k) AS k, any_value(whole.n) AS n FROM sums JOIN sizes USING (c) CROSS JOIN whole GROUP BY 1",
        ),
    ],
    f"SELECT term, {sql.fixed('(b / (k - 1)) / (w / (n - k))', 4)} AS f FROM parts",
))
def anova_by_language(spark, sf_dir):
    """The ANOVA F of every term against the languages."""
    documents = table(spark, sf_dir, "documents")
    spec = SPEC.with_(categorical=(), numeric=())
    fitted = vectors.fit_features(documents, spec)
    # One row per language.
    classes = documents.select(F.coalesce("lang", F.lit("none")).alias("c")).distinct().orderBy("c").collect()
    known = F.split(F.lit("\x1f".join(r.c for r in classes)), "\x1f")
    coded = documents.withColumn("y", F.array_position(known, F.coalesce("lang", F.lit("none"))))
    matrix = stored(vectors.assemble(coded, fitted, ["y"]))
    names = spark.createDataFrame([(i, n.split("=", 1)[1]) for i, n in enumerate(fitted.names())], "feature long, term string")
    found = models.anova_f(matrix, "y").join(F.broadcast(names), "feature").select("term", "f")
    return rounded(found, 4)
