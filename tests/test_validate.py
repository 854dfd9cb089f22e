from conftest import make_survey
from pyspark.sql import functions as F

from tessera.operators import validate as V
from tessera.sources.survey import records


def test_valid_frame_has_no_violations(spark, survey_rows):
    df = make_survey(spark, survey_rows)
    assert V.violations(df).count() == 0
    assert V.is_valid(V.violations(df)).first()["is_valid"]


def test_missing_column_stops_value_checks(spark, survey_rows):
    df = make_survey(spark, survey_rows).drop("Age")
    msgs = [r["message"] for r in V.violations(df).collect()]
    assert msgs == ["Missing column: 'Age'"]


def test_age_out_of_range(spark, survey_rows):
    survey_rows[0]["Age"] = -1.0
    v = V.violations(make_survey(spark, survey_rows)).collect()
    assert [r["message"] for r in v] == ["Row 1: Age value -1.0 is out of range [10.0, 100.0]"]


def test_height_out_of_range(spark, survey_rows):
    survey_rows[1]["Height"] = 3.0
    v = V.violations(make_survey(spark, survey_rows)).collect()
    assert len(v) == 1 and v[0]["column"] == "Height" and v[0]["rule"] == "range"


def test_bad_category(spark, survey_rows):
    survey_rows[2]["Gender"] = "Other"
    v = V.violations(make_survey(spark, survey_rows)).collect()
    assert v[0]["message"] == "Row 3: Gender value 'Other' is not in valid values ['Male', 'Female']"


def test_null_counts_as_violation(spark, survey_rows):
    survey_rows[0]["Weight"] = None
    survey_rows[1]["CALC"] = None
    v = {(r["id"], r["column"]) for r in V.violations(make_survey(spark, survey_rows)).collect()}
    assert v == {("1", "Weight"), ("2", "CALC")}


def test_single_record_valid_and_invalid(spark, survey_rows):
    good = {k: v for k, v in survey_rows[0].items() if k != "Obesity"}
    bad = dict(good, id=9, Age=-1.0)
    out = {r["id"]: r["errors"] for r in V.record_errors(records(spark, [good, bad])).collect()}
    assert out["1"] == []
    assert out["9"] == ["Age value -1.0 is out of range [10.0, 100.0]"]


def test_single_record_missing_and_text_field(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, Age string")
    errs = V.record_errors(df).first()["errors"]
    assert "Age value 'abc' is not numeric" in errs
    assert "Missing field: 'Gender'" in errs


def test_violation_preview_order(spark, survey_rows):
    survey_rows[0]["Gender"] = "x"
    survey_rows[2]["Age"] = 5.0
    p = V.preview(V.violations(make_survey(spark, survey_rows)), 10).collect()
    assert [r["column"] for r in p] == ["Age", "Gender"]


def test_height_guard_raises(spark):
    import pytest
    df = spark.createDataFrame([(0.0,)], "Height double")
    with pytest.raises(Exception):
        df.select(V.height_guard(F.col("Height"))).collect()
