import random

import numpy as np
import pytest
from conftest import make_survey
from pyspark.sql import functions as F

from tessera.operators import clean as C
from tessera.operators import evaluate as N
from tessera.operators import split as L
from tessera.operators.enrich import alerts, bmi_band
from tessera.sources.survey import read_survey_csv, survey_schema


def test_mode_tie_takes_smallest_and_all_null_stays(spark, survey_rows):
    rows = [dict(survey_rows[0], id=i, CAEC=v, CALC=None) for i, v in enumerate(["b", "a", "b", "a", None])]
    df = make_survey(spark, rows)
    modes = C.category_modes(df)
    assert modes["CAEC"] == "a" and modes["CALC"] is None
    out = C.impute_categorical(df, modes=modes)
    assert out.where(F.col("CALC").isNull()).count() == 5


def test_even_count_median_imputation(spark, survey_rows):
    rows = [dict(survey_rows[0], id=i, Weight=w, Age=20.0 + i) for i, w in enumerate([50.0, 70.0, 60.0, 80.0, None])]
    df = make_survey(spark, rows)
    assert C.numeric_medians(df)["Weight"] == 65.0
    assert C.impute_numeric(df).where("id = 4").first()["Weight"] == 65.0


def test_case_standardisation_strips_all_whitespace(spark, survey_rows):
    rows = [dict(survey_rows[0], id=1, FAVC="\tYES \n", MTRANS="rocket")]
    out = C.standardize_case(make_survey(spark, rows)).first()
    assert out["FAVC"] == "yes" and out["MTRANS"] == "rocket"


def test_dedupe_keeps_smallest_id(spark, survey_rows):
    rows = [dict(survey_rows[0], id=7), dict(survey_rows[0], id=3), survey_rows[1]]
    out = C.remove_duplicates(make_survey(spark, rows)).orderBy("id").collect()
    assert [r["id"] for r in out] == ["2", "3"]


def test_csv_source_na_tokens(spark, tmp_path):
    cols = [f.name for f in survey_schema().fields]
    p = tmp_path / "s.csv"
    line = ["1", "Male", "NA", "1.7", "nan", "yes", "yes", "2", "3", "Sometimes", "no", "2", "no", "1", "1",
            "null", "Walking", "Normal_Weight"]
    p.write_text(",".join(cols) + "\n" + ",".join(line) + "\n")
    r = read_survey_csv(spark, str(p)).first()
    assert r["Age"] is None and r["Weight"] is None and r["CALC"] is None and r["Height"] == 1.7


def test_largest_remainder_and_quotas():
    counts = {"a": 10, "b": 7, "c": 3}
    q = L.split_quotas(counts, ["a", "b", "c"])
    n = sum(counts.values())
    assert sum(t for t, _, _ in q.values()) == n - L.ceil_frac(n, 3, 10)
    for c, (t, v, s) in q.items():
        assert t + v + s == counts[c]


def test_stratified_split_sizes(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "B", "C"])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, Obesity string")
    from tessera.spec import SurveySpec
    spec = SurveySpec(categorical_values={"Obesity": ["A", "B", "C"]})
    sp = L.stratified_split(df, spec)
    sizes = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert sizes["train"] == 700 and sizes["val"] + sizes["test"] == 300 and sizes["test"] == 150
    dist = L.drift_check(L.split_distribution(sp, spec)).first()
    assert dist["within_limit"]
    folds = L.stratified_folds(df, 5, spec).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 3


def test_macro_f1_uses_union_of_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "actual string, predicted string")
    cells = N.confusion_counts(df)
    m = N.summary_metrics(cells).first()
    # labels a, b, z: f1 a = 2/3, b = 1, z = 0
    assert m["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3, abs=1e-6)
    assert {(r["actual"], r["predicted"]) for r in N.confusion_matrix(cells).collect()} == {("a", "a"), ("b", "b")}


def test_auc_matches_brute_force_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y"]), round(rng.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, actual string, s double").select(
        "id", "actual", F.col("s").alias("p_x"), (1 - F.col("s")).alias("p_y"))
    from tessera.spec import SurveySpec
    spec = SurveySpec(categorical_values={"Obesity": ["x", "y"]})
    got = {r["class"]: r["auc"] for r in N.auc(df, spec).collect()}
    pos = [s for _, a, s in rows if a == "x"]
    neg = [s for _, a, s in rows if a != "x"]
    brute = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg])
    assert got["x"] == pytest.approx(brute, abs=1e-6)


def test_bmi_band_is_right_closed(spark):
    df = spark.createDataFrame([(18.5,), (24.95,), (29.9,), (35.0,)], "b double")
    assert [r[0] for r in df.select(bmi_band(F.col("b"))).collect()] == ["Abaixo do Peso", "Sobrepeso", "Sobrepeso",
                                                                          "Obesidade"]


def test_alerts_calorie_sedentary_preempts_sedentary(spark):
    df = spark.createDataFrame([("yes", "yes", 0.5, "yes", 1.0), (None, None, 0.5, "no", None)],
                               "family_history string, SMOKE string, FAF double, FAVC string, CH2O double")
    got = [r[0] for r in df.select(alerts(df)).collect()]
    assert got == [["family_history", "smoking", "calorie_sedentary", "low_water"], ["low_activity"]]


def test_form_decoding_and_activity_days(spark):
    from tessera.operators.enrich import decode_form
    df = spark.createDataFrame(
        [("Feminino", "Às vezes", "Não", "Caminhada", "Sempre", "Mais de 3 litros", "0 a 2 horas", 4, "Sim", "Não",
          "Sim", "x")],
        "Gender string, CAEC string, CALC string, MTRANS string, FCVC string, CH2O string, TUE string, FAF int, "
        "family_history string, FAVC string, SMOKE string, SCC string")
    r = decode_form(df).first()
    assert (r["Gender"], r["CAEC"], r["CALC"], r["MTRANS"]) == ("Female", "Sometimes", "no", "Walking")
    assert (r["FCVC"], r["CH2O"], r["TUE"], r["FAF"]) == (3.0, 3.0, 0.0, 2.0)
    assert (r["family_history"], r["FAVC"], r["SMOKE"], r["SCC"]) == ("yes", "no", "yes", "no")
    days = spark.createDataFrame([(d,) for d in range(8)], "d int")
    from tessera.operators.enrich import activity_days_to_faf
    assert [x[0] for x in days.select(activity_days_to_faf(F.col("d"))).collect()] == [0.0, 1.0, 1.0, 2.0, 2.0,
                                                                                          3.0, 3.0, 3.0]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_duplicates_of_odd_rows_without_moving_the_others(spark, monkeypatch, limit):
    """The hashes of repeated rows are broadcast, or joined where there are too many; rows without a copy are
    not sorted or grouped."""
    monkeypatch.setattr(C, "BROADCAST_HASHES", limit)
    base = dict(Gender="Male", Age=25.0, Height=1.75, Weight=None, family_history=None, FAVC="yes", FCVC=0.0, NCP=3.0, CAEC=None,
                SMOKE="no", CH2O=2.0, SCC="no", FAF=1.0, TUE=1.0, CALC="no", MTRANS="Walking", Obesity=None)
    rows = [dict(base, id="5"), dict(base, id="31"), dict(base, id=None, FCVC=-0.0), dict(base, id=None, Age=None), dict(base, id=None, Age=None),
            dict(base, id="7", FAVC=None, family_history="yes"), dict(base, id="8", FAVC="yes", family_history=None, TUE=2.0), dict(base, id="9", CALC="NO")]
    out = C.remove_duplicates(make_survey(spark, rows))
    assert out.columns == ["id", *C.OBESITY.columns]
    assert sorted((str(r.id), r.Age, r.FCVC, r.CALC) for r in out.collect()) == [
        ("31", 25.0, 0.0, "no"), ("7", 25.0, 0.0, "no"), ("8", 25.0, 0.0, "no"), ("9", 25.0, 0.0, "NO"), ("None", None, 0.0, "no")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan


def test_duplicates_of_many_rows(spark):
    """Against a grouping of all rows by their values; one row is a third of the table."""
    df = spark.range(3000).selectExpr("CAST(id * 7 % 3001 AS STRING) AS id", *[
        f"CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN id % 11 = 0 THEN NULL ELSE id % 500 END AS {'DOUBLE' if c in C.OBESITY.numeric_ranges else 'STRING'}) AS {c}"
        for c in C.OBESITY.columns])
    cols = list(C.OBESITY.columns)
    want = df.groupBy(*cols).agg(F.min("id").alias("id")).select("id", *cols)
    got = C.remove_duplicates(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_repeated_rows_move_once(spark, monkeypatch):
    """With more hashes of repeated rows than are broadcast, one shuffle moves the rows; the copies of hot
    rows, a third of the table, are combined before they move."""
    monkeypatch.setattr(C, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(C, "HOT_COPIES", 100)
    df = spark.range(3000).selectExpr("CAST(CASE WHEN id % 13 > 0 THEN id * 7 % 3001 END AS STRING) AS id", *[
        f"CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN id % 11 = 0 THEN NULL ELSE id % 500 END AS {'DOUBLE' if c in C.OBESITY.numeric_ranges else 'STRING'}) AS {c}"
        for c in C.OBESITY.columns])
    cols = list(C.OBESITY.columns)
    want = df.groupBy(*cols).agg(F.min("id").alias("id")).select("id", *cols)
    got = C.remove_duplicates(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    moved = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert moved.count("Exchange hashpartitioning") == 2  # the usual rows, and the combined hot ones


def test_standard_case_compares_before_it_searches(spark):
    values = ["no", "Sometimes", "Public_Transportation"]
    df = spark.createDataFrame([(x,) for x in ["no", "Sometimes", " SOMETIMES\t", "\n\x0b\f\rNo ", "public_transportation", "no ", "never", "", None]], "c string")
    out = df.select("c", C.canonical_case("c", values).alias("x"))
    assert [r.x for r in out.collect()] == ["no", "Sometimes", "Sometimes", "no", "Public_Transportation", "no ", "never", "", None]
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
