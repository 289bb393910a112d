"""Nested alerts: their schema, and one flat row per blocking hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the nested alert.
_MT103 = (
    "mt_type transaction_reference_number sender beneficiary origin country street city state "
    "organization bic_code transaction_type reference dob national_id passport account_number "
    "sanction_list"
).split()
SYNONYM_KEYS = ("city", "country", "name", "organization")


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_BANK = T.StructType(
    [*_strings(["name", "bic"]), T.StructField("address", T.StructType(_strings(["city", "country", "street"])))]
)
_SHORT_BANK = T.StructType(_strings(["name", "bic"]))
MT103_SCHEMA = T.StructType(
    [
        *_strings(_MT103),
        T.StructField("synonyms", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        *_strings(["hits_count_103"]),
    ]
)
MT202_SCHEMA = T.StructType(
    [
        *_strings("mt_type transaction_reference_number related_reference value_date currency".split()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("ordering_institution", _BANK),
        T.StructField("beneficiary_institution", _BANK),
        *_strings(["sender_to_receiver_info"]),
        T.StructField("intermediary_institution", _SHORT_BANK),
        *_strings(["charges", "instruction_code", "hits_count_202"]),
    ]
)
HIT_SCHEMA = T.StructType(
    [
        *_strings("hit_id mt_type tag is_pep severity".split()),
        T.StructField("fuzzy_match_score", T.DoubleType()),
        *_strings("sender Organization beneficiary bic_code account_number country city state".split()),
        T.StructField("score", T.DoubleType()),
        *_strings(["priority", "matching_type", "hit_type", "matching_text"]),
        T.StructField("watchlist_text", T.ArrayType(T.StringType())),
        *_strings(["review_decision", "review_comments"]),
    ]
)
DECISION_SCHEMA = T.StructType(
    [
        *_strings(["decision"]),
        T.StructField("options", T.ArrayType(T.StringType())),
        *_strings(["reviewer_comments", "last_action"]),
    ]
)
ALERT_SCHEMA = T.StructType(
    [
        *_strings(["message_id"]),
        T.StructField(
            "message",
            T.StructType([T.StructField("MT103", MT103_SCHEMA), T.StructField("MT202", MT202_SCHEMA)]),
        ),
        T.StructField("total_hits", T.IntegerType()),
        T.StructField("blocking_hits", T.ArrayType(HIT_SCHEMA)),
        T.StructField("message_decision", DECISION_SCHEMA),
    ]
)


_WHOLE = T.StructType([*ALERT_SCHEMA.fields, T.StructField("_rejected", T.StringType())])


def _parsed(df: DataFrame, column: str) -> DataFrame:
    read = F.from_json(F.col(column), _WHOLE, {"columnNameOfCorruptRecord": "_rejected"})
    return df.select(F.col(column).alias("_text"), read.alias("_alert"))


def parse_alerts(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text -> nested alert columns. Texts that are no alert are left to `rejected_alerts`."""
    return _parsed(df, column).where("_alert IS NOT NULL AND _alert._rejected IS NULL").select("_alert.*").drop("_rejected")


def rejected_alerts(df: DataFrame, column: str = "value") -> DataFrame:
    """The texts that `parse_alerts` leaves out: broken JSON, or values of another type."""
    return _parsed(df, column).where("_alert IS NULL OR _alert._rejected IS NOT NULL").select(F.col("_text").alias(column))


def _flat_fields(source: Column, schema: T.StructType, prefix: str, separator: str) -> list[Column]:
    columns: list[Column] = []
    for f in schema.fields:
        value, name = source.getField(f.name), f"{prefix}__{f.name}"
        if isinstance(f.dataType, T.StructType):
            columns += _flat_fields(value, f.dataType, name, separator)
        elif isinstance(f.dataType, T.MapType):
            columns += [
                F.array_join(F.try_element_at(value, F.lit(k)), separator).alias(f"{name}__{k}")
                for k in SYNONYM_KEYS
            ]
        elif isinstance(f.dataType, T.ArrayType):
            columns.append(F.array_join(value, separator).alias(name))
        else:
            columns.append(value.alias(name))
    return columns


def flatten_alerts(nested: DataFrame, separator: str = " ") -> DataFrame:
    """One row per blocking hit; a message without hits keeps one row of null hit fields."""
    hits = nested.select(
        "message_id", "message", "total_hits", "message_decision", F.explode_outer("blocking_hits").alias("_hit")
    )
    return hits.select(
        "message_id", "total_hits",
        *_flat_fields(F.col("_hit"), HIT_SCHEMA, "hit", separator),
        *_flat_fields(F.col("message.MT103"), MT103_SCHEMA, "mt103", separator),
        *_flat_fields(F.col("message.MT202"), MT202_SCHEMA, "mt202", separator),
        *_flat_fields(F.col("message_decision"), DECISION_SCHEMA, "decision", separator),
    )
