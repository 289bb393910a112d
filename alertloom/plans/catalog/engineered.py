"""Queries for the engineered features."""

from __future__ import annotations

from alertloom.operators import features
from alertloom.plans.alerts import landed_alerts, table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.plans.preprocess import clean_by_role
from alertloom.spec import ALERTS

ID = "hit__hit_id"


def _cleaned(spark, sf_dir):
    return clean_by_role(landed_alerts(spark, sf_dir), ALERTS)


@query("F1 F2 F3", sql.with_ctes(
    sql.CLIPPED,
    f"SELECT hit__hit_id, {sql.fixed('hit__score * 0.6 + hit__fuzzy_match_score * 0.4')} AS risk_score_combined, "
    f"{sql.fixed('greatest(hit__score, hit__fuzzy_match_score)')} AS risk_score_max, "
    f"{sql.fixed('abs(hit__score - hit__fuzzy_match_score)')} AS risk_score_diff FROM clipped",
))
def risk_scores(spark, sf_dir):
    made = features.risk_scores(_cleaned(spark, sf_dir))
    return rounded(made.select(ID, "risk_score_combined", "risk_score_max", "risk_score_diff"))


def _shape_sql(c: str) -> str:
    w = sql.words(c)
    letters = f"length(array_to_string({w}, ''))"
    return (
        f"CAST(length({c}) AS INTEGER) AS {c}_length, CAST(len({w}) AS INTEGER) AS {c}_word_count, "
        f"CAST(len(list_distinct({w})) AS INTEGER) AS {c}_unique_words, "
        f"{sql.fixed(f'CASE WHEN len({w}) = 0 THEN 0 ELSE {letters} / len({w}) END')} AS {c}_avg_word_length"
    )


@query("F4 F5 F6 F7", f"SELECT doc_id, {_shape_sql('text')} FROM documents")
def text_shape(spark, sf_dir):
    made = features.text_shape(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])
    return rounded(made.drop("text"))


_PARTS = {
    "combined_primary_text": ["hit__matching_text", "hit__watchlist_text", "decision__reviewer_comments"],
    "combined_geography": ["hit__country", "mt103__city"],
}
_COMBINED_SQL = ", ".join(
    f"concat_ws(' | ', {', '.join(f'coalesce({c}, {chr(39)*2})' for c in cols)}) AS {name}"
    for name, cols in _PARTS.items()
)


@query("F8", sql.with_ctes(sql.CLIPPED, f"SELECT hit__hit_id, {_COMBINED_SQL} FROM clipped"))
def combined_texts(spark, sf_dir):
    return features.combined_texts(_cleaned(spark, sf_dir)).select(ID, *_PARTS)


@query("F9", sql.with_ctes(
    [("q", "SELECT quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem")],
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity > q75 AS INTEGER) AS high_quantity, "
    "CAST(l_extendedprice > q90 AS INTEGER) AS high_price FROM lineitem CROSS JOIN q",
))
def high_value_flags(spark, sf_dir):
    flags = {"high_quantity": ("l_quantity", 0.75), "high_price": ("l_extendedprice", 0.90)}
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_extendedprice")
    return features.high_value_flags(lines, flags).drop("l_quantity", "l_extendedprice")


_LEVEL = "CASE upper({0}) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 0 END"


@query("F10 F11 F12", sql.with_ctes(
    sql.CLIPPED,
    f"SELECT hit__hit_id, {_LEVEL.format('hit__severity')} AS severity_score, "
    f"{_LEVEL.format('hit__priority')} AS priority_score, "
    "CAST(upper(hit__is_pep) = 'YES' AS INTEGER) AS is_pep_binary, "
    f"{sql.fixed('ln(1 + mt202__amount)')} AS amount_log FROM clipped",
))
def risk_levels_and_amount(spark, sf_dir):
    made = _cleaned(spark, sf_dir).transform(features.risk_levels).transform(features.pep_flag)
    made = features.amount_log(made)
    return rounded(made.select(ID, "severity_score", "priority_score", "is_pep_binary", "amount_log"))


def _advanced_sql() -> str:
    made = [
        f"{sql.fixed('hit__score * 0.6 + hit__fuzzy_match_score * 0.4')} AS risk_score_combined",
        f"{sql.fixed('greatest(hit__score, hit__fuzzy_match_score)')} AS risk_score_max",
        f"{sql.fixed('abs(hit__score - hit__fuzzy_match_score)')} AS risk_score_diff",
        *[_shape_sql(c) for c in sql.TEXTS],
        _COMBINED_SQL,
        "CAST(mt103__hits_count_103 > q103 AS INTEGER) AS high_hit_count_103",
        "CAST(mt202__hits_count_202 > q202 AS INTEGER) AS high_hit_count_202",
        "CAST(mt202__amount > q_amount AS INTEGER) AS high_amount",
        "CAST(upper(hit__is_pep) = 'YES' AS INTEGER) AS is_pep_binary",
        f"{_LEVEL.format('hit__severity')} AS severity_score",
        f"{_LEVEL.format('hit__priority')} AS priority_score",
        f"{sql.fixed('ln(1 + mt202__amount)')} AS amount_log",
    ]
    return "SELECT hit__hit_id, " + ", ".join(made) + " FROM clipped CROSS JOIN q"


@query("F13", sql.with_ctes(
    [*sql.CLIPPED, (
        "q",
        "SELECT quantile_cont(mt103__hits_count_103, 0.75) AS q103, "
        "quantile_cont(mt202__hits_count_202, 0.75) AS q202, quantile_cont(mt202__amount, 0.9) AS q_amount "
        "FROM clipped",
    )],
    _advanced_sql(),
))
def advanced_features(spark, sf_dir):
    cleaned = _cleaned(spark, sf_dir)
    made = features.advanced_features(cleaned, ALERTS)
    return rounded(made.select(ID, *[c for c in made.columns if c not in cleaned.columns]))
