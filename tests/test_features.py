import math

import pytest
from conftest import make_survey

from tessera.operators import features as E
from tessera.spec import OBESITY as S


def base_rows():
    rows = []
    mtrans = ["Automobile", "Bike", "Motorbike", "Public_Transportation", "Walking"]
    caec = ["no", "Sometimes", "Frequently", "Always", "Sometimes"]
    for i in range(5):
        rows.append(dict(id=i, Gender="Male" if i % 2 else "Female", Age=20.0 + 5 * i, Height=1.6 + 0.05 * i,
                         Weight=60.0 + 5 * i, family_history="yes", FAVC="yes" if i < 3 else "no", FCVC=2.0,
                         NCP=3.0, CAEC=caec[i], SMOKE="no", CH2O=2.0, SCC="no", FAF=float(i % 3), TUE=1.0,
                         CALC="no", MTRANS=mtrans[i], Obesity="Normal_Weight"))
    return rows


def test_bmi_exact(spark, survey_rows):
    r = dict(survey_rows[0], Height=1.80, Weight=81.0)
    df = make_survey(spark, [r])
    assert df.select(E.bmi().alias("b")).first()["b"] == pytest.approx(25.0)
    # one row: zero variance → standard scaling divides by 1 → 0.0
    m = E.SurveyFeatures().fit(df)
    f = m.feature_frame(df).first()
    assert f["BMI"] == 0.0 and f["FCVC"] == 0.0


def test_shape_and_names(spark):
    df = make_survey(spark, base_rows())
    m = E.SurveyFeatures().fit(df)
    f = m.feature_frame(df, keep=())
    assert f.columns == S.feature_names and len(f.columns) == 24 and f.count() == 5
    vec = m.transform(df).select("features").first()[0]
    assert len(vec) == 24


def test_onehot_sum_is_one_and_unknown_is_zero(spark):
    rows = base_rows()
    df = make_survey(spark, rows)
    m = E.SurveyFeatures().fit(df)
    ohe = [f"MTRANS_{c}" for c in S.onehot_categories]
    sums = [sum(r[c] for c in ohe) for r in m.feature_frame(df).collect()]
    assert sums == [1.0] * 5
    unk = make_survey(spark, [dict(rows[0], MTRANS="Rocket")])
    assert sum(m.feature_frame(unk).first()[c] for c in ohe) == 0.0


def test_ordinal_codes(spark):
    df = make_survey(spark, base_rows())
    got = [r["CAEC"] for r in E.SurveyFeatures().fit(df).feature_frame(df).orderBy("id").collect()]
    assert got == [0.0, 1.0, 2.0, 3.0, 1.0]


def test_unmapped_ordinal_fails(spark):
    df = make_survey(spark, [dict(base_rows()[0], CAEC="sometimes")])
    m = E.SurveyFeatures().fit(make_survey(spark, base_rows()))
    with pytest.raises(Exception):
        m.feature_frame(df).collect()


def test_scaler_statistics_come_from_fit_frame_only(spark):
    train = make_survey(spark, [dict(r, Age=25.0 + 0.1 * i) for i, r in enumerate(base_rows())])
    test = make_survey(spark, [dict(r, Age=60.0 + 0.1 * i) for i, r in enumerate(base_rows())])
    m = E.SurveyFeatures().fit(train)
    mean_age = dict(zip(m.getOrDefault("standardCols"), m.getOrDefault("means")))["Age"]
    assert mean_age == pytest.approx(25.2)
    ages = [r["Age"] for r in m.feature_frame(test).collect()]
    assert min(ages) > 10  # far above the training mean, not re-centred


def test_population_std_and_minmax(spark):
    df = make_survey(spark, base_rows())
    m = E.SurveyFeatures().fit(df)
    ages = [20.0 + 5 * i for i in range(5)]
    mu = sum(ages) / 5
    sd = math.sqrt(sum((a - mu) ** 2 for a in ages) / 5)
    got = sorted(r["Age"] for r in m.feature_frame(df).collect())
    assert got == pytest.approx([(a - mu) / sd for a in ages])
    faf = sorted(r["FAF"] for r in m.feature_frame(df).collect())
    assert faf[0] == 0.0 and faf[-1] == 1.0


def test_inverse_round_trip(spark):
    df = make_survey(spark, base_rows())
    m = E.SurveyFeatures().fit(df)
    back = m.inverse(m.feature_frame(df)).orderBy("id").collect()
    assert [r["Age"] for r in back] == pytest.approx([20.0 + 5 * i for i in range(5)])


def test_scores(spark):
    df = make_survey(spark, base_rows())
    r = df.where("id = 0").select(E.eating_score().alias("e"), E.lifestyle_score().alias("l"),
                                  E.high_calorie_sedentary().alias("h")).first()
    assert r["e"] == pytest.approx((2 + 2 + 3 + 0) / 12)
    assert r["l"] == pytest.approx((0 - 1 - 0 - 0 + 7) / 10)
    assert r["h"] == 1


def test_model_persistence(spark, tmp_path):
    df = make_survey(spark, base_rows())
    m = E.SurveyFeatures().fit(df)
    p = str(tmp_path / "fe")
    m.write().overwrite().save(p)
    m2 = E.SurveyFeaturesModel.load(p)
    assert m2.getOrDefault("means") == m.getOrDefault("means")
