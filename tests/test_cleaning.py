import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.operators import clean, schema
from alertloom.plans.preprocess import preprocess, preprocess_base
from alertloom.spec import ALERTS


def column(df, name="v", order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def keyed(spark, values, kind="string"):
    if kind == "double":
        values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame(list(enumerate(values)), f"k bigint, v {kind}")


def test_text_cleaning(spark):
    values = [None, "", " nan ", "NULL", "None", "nan x", " a b\t", "None.", "x​"]
    assert column(clean.clean_text(keyed(spark, values), ["v"])) == [
        "", "", "", "", "", "nan x", "a b", "None.", "x​",
    ]


@pytest.mark.parametrize("value", [
    "o'brien", "1st", "MT-103a", "hello world", "ÉCOLE d'été", "a_b c2d", "x", "", "ALL CAPS", "tab\tsep", "état-major",
])
def test_title_case_is_that_of_strings(spark, value):
    assert column(clean.normalize_categorical(keyed(spark, ["zz " + value]), ["v"])) == [("zz " + value).strip().title()]


def test_yes_no_and_null_categories(spark):
    values = [None, "yes", "TRUE", "y", "1", "no", "False", "0", "n", "null", " High "]
    assert column(clean.normalize_categorical(keyed(spark, values), ["v"])) == [
        "Nan", "YES", "YES", "YES", "YES", "NO", "NO", "NO", "NO", "Null", "High",
    ]
    assert column(clean.normalize_categorical(keyed(spark, [None]), ["v"], null_token="Unknown")) == ["Unknown"]


def test_numbers_parse_as_in_pandas(spark):
    values = ["", "nan", "1,000", "1e3", "12d", "1.2.3", "-", "+5", ".5", "5.", " 7 ", "abc", "0x10", "-2.5E-1", None]
    want = pd.to_numeric(pd.Series(values), errors="coerce").fillna(0).tolist()
    assert column(clean.coerce_numeric(keyed(spark, values), ["v"])) == want
    assert column(clean.coerce_numeric(keyed(spark, [float("nan"), 2.0, None], "double"), ["v"])) == [0, 2, 0]


def test_outliers_are_clipped_as_in_pandas(spark):
    values = [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 1000, -400, None]
    s = pd.Series(values)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    want = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = column(clean.clip_iqr(keyed(spark, values, "double"), ["v"]))
    assert got[-1] is None
    assert got[:-1] == pytest.approx(want[:-1].tolist())


def test_no_spread_no_clipping(spark):
    assert clean.iqr_fences(keyed(spark, [5.0] * 4, "double"), ["v"]) == {"v": None}
    assert clean.iqr_fences(keyed(spark, [0.0] * 9 + [50.0], "double"), ["v"]) == {"v": None}
    assert clean.iqr_fences(keyed(spark, [None], "double"), ["v"]) == {"v": None}


def test_fitted_fences_apply_to_another_batch(spark):
    fences = clean.iqr_fences(keyed(spark, [1.0, 2, 3, 4], "double"), ["v"])
    assert column(clean.apply_fences(keyed(spark, [100.0], "double"), fences)) == [3.25 + 1.5 * 1.5]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(None, None, None), ("a", None, None), (None, None, 2)], "a string, b string, c int")
    kept = clean.drop_empty_rows(df)
    assert kept.count() == 2
    assert clean.drop_empty_columns(kept).columns == ["a", "c"]


def test_planning_a_wide_renamed_table_ends(spark):
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(72)])
    renamed = wide.select(*[F.col(f"c{i}").alias(f"d{i}") for i in range(72)])
    assert clean.clean_text(clean.drop_empty_rows(renamed), [f"d{i}" for i in range(72)]).count() == 3


def test_numeric_looking_columns(spark):
    rows = [(i, str(i), f"{i}.{i}.{i}", "x" if i % 4 == 0 else "7", "9" if i > 1500 else None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string, c string, late string, none string")
    found = clean.numeric_looking(df, ["k"], ["a", "b", "c", "late", "none"])
    assert found == ["a", "b", "late"]
    coerced = clean.sniff_numeric(df, ["k"], exclude=["k"])
    assert [r["b"] for r in coerced.orderBy("k").limit(2).collect()] == [0.0, 0.0]


def test_alignment_defaults(spark):
    df = spark.createDataFrame([(10, "x"), (5, "y")], "hit__hit_id bigint, hit__city string")
    aligned = schema.align_schema(df, ALERTS.expected, ["hit__hit_id"])
    rows = {r["hit__hit_id"]: r for r in aligned.collect()}
    assert len(aligned.columns) == 72
    assert (rows[5]["message_id"], rows[10]["message_id"]) == (0, 1)
    assert rows[5]["hit__country"] == 0 and rows[5]["mt202__currency"] == ""
    zero = [c for c in ALERTS.expected if schema.default_kind(c) == "zero"]
    assert len(zero) == 12
    assert [c for c in ALERTS.expected if schema.default_kind(c) == "id"] == ["hit__hit_id", "message_id", "mt103__national_id"]
    assert schema.order_columns(aligned, ALERTS.expected).columns == list(ALERTS.expected)


def test_guards_and_checks(spark):
    empty = spark.createDataFrame([], "a string")
    with pytest.raises(ValueError):
        schema.guard_rows(empty, False)
    with pytest.raises(ValueError):
        schema.guard_rows(spark.range(3), True, 4)
    assert schema.guard_rows(spark.range(4), True, 4).count() == 4
    with pytest.raises(ValueError):
        schema.filter_level(empty, ALERTS, "nope")
    with pytest.raises(ValueError):
        schema.validate_targets(empty, ALERTS, "hit")
    assert not schema.validate_strict(empty, ALERTS, False)
    values = keyed(spark, ["1", "", None, "abc", "1e5"])
    assert schema.validate_types(values, ["v"]).collect()[0]["bad_values"] == 1


def test_preprocess_shape_and_values(spark):
    rows = [
        (1, " TEXT ", "yes", "85", None, "123", None),
        (2, None, None, "abc", "Release", "4-5", None),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "hit__hit_id bigint, hit__matching_text string, hit__is_pep string, hit__score string, "
        "decision__last_action string, hit__tag string, hit__state string",
    )
    done = preprocess(df, ALERTS)
    got = {r["hit__hit_id"]: r for r in done.collect()}
    assert set(got) == {1, 2} and done.columns == list(ALERTS.expected)
    assert (got[1]["hit__matching_text"], got[1]["hit__is_pep"], got[1]["hit__score"]) == ("TEXT", "YES", 85.0)
    assert (got[2]["hit__matching_text"], got[2]["hit__is_pep"], got[2]["hit__score"]) == ("", "Nan", 0.0)
    assert (got[1]["hit__tag"], got[2]["hit__tag"]) == (123.0, 0.0)
    assert got[1]["hit__state"] == ""


def test_preprocess_base(spark):
    df = spark.createDataFrame([(None, "abc", None), (" nan ", "2", "x")], "hit__matching_text string, hit__score string, hit__country string")
    got = preprocess_base(df, ALERTS).collect()
    assert [r["hit__matching_text"] for r in got] == ["", ""]
    assert [r["hit__score"] for r in got] == [0.0, 2.0]
    assert [r["hit__country"] for r in got] == ["Unknown", "x"]
