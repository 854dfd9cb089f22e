"""Registered remaining summary (A10–A25) and filter/format (P*) queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import filters as P
from ..functions.stats import moments, rounded_mean
from ..operators import summary as A
from ..spec import OBESITY, SEVERE_CLASSES
from . import bases
from . import oracle as O
from .catalog_features import FEAT_ALL
from .registry import register, survey_select

S = OBESITY
FILTERS = {"gender": ["Female", "Other"], "age_min": 20, "age_max": 40,
           "obesity_classes": ["Obesity_Type_I", "Obesity_Type_II", "Unknown_Class"]}
NO_FILTERS = {"gender": [], "age_min": None, "age_max": None, "obesity_classes": ["Not_A_Class"]}
_SCORES = ["BMI", "eating_score", "lifestyle_score"]


def _feat_unscaled(spark, sf):
    return E.summary_encoding(bases.base_clean(spark, sf))


def _describe5_sql(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT {O.q(c)} AS \"column\", CAST(round(CAST(avg({c}) AS DECIMAL(28,10)), 4) AS DOUBLE) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, "
        f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM {src}"
        for c in cols)


@register("a10_score_summaries", O.with_clean(*FEAT_ALL) + "\n" + _describe5_sql("enc", _SCORES))
def a10_score_summaries(spark, sf):
    """A10: mean, median, sample std, min, max of BMI and the two scores."""
    return A.describe(_feat_unscaled(spark, sf), _SCORES, quartiles=False)


@register("a11_flag_share", O.with_clean(*FEAT_ALL) + "\nSELECT CAST(coalesce(sum(high_calorie_sedentary), 0) AS BIGINT) "
          "AS n_flagged, count(*) AS n_rows, " + O.pct("coalesce(sum(high_calorie_sedentary), 0)", "count(*)", 2)
          + " AS pct_flagged FROM enc")
def a11_flag_share(spark, sf):
    return A.flag_share(_feat_unscaled(spark, sf))


@register("a12_crosstab_flag", O.with_clean(*FEAT_ALL, "ct AS (SELECT Obesity AS class_en, count(*) AS n, "
          "count(*) FILTER (WHERE high_calorie_sedentary = 0) AS z, count(*) FILTER (WHERE high_calorie_sedentary = 1) AS o "
          "FROM enc GROUP BY Obesity)")
          + f"\nSELECT d.class_en, d.severity, {O.pct('ct.z', 'ct.n', 1)} AS pct_0, {O.pct('ct.o', 'ct.n', 1)} AS pct_1 "
          "FROM class_dim d JOIN ct ON d.class_en = ct.class_en")
def a12_crosstab_flag(spark, sf):
    """Class × high-calorie-sedentary flag, % within each class."""
    return A.crosstab_pct(_feat_unscaled(spark, sf), "high_calorie_sedentary", [0, 1])


@register("a13_mean_target_by_caec", O.with_clean(O.exploratory_encoding_sql())
          + "\nSELECT CAEC, count(*) AS n, round(avg(Obesity_Ordinal), 4) AS mean_target FROM xenc "
          "WHERE CAEC IS NOT NULL GROUP BY CAEC")
def a13_mean_target_by_caec(spark, sf):
    """Mean target ordinal per CAEC level present."""
    x = E.exploratory_encoding(bases.base_clean(spark, sf))
    return A.mean_target_by_level(x, "CAEC", "Obesity_Ordinal")


_BIN = ["Gender", "FAVC", "SMOKE", "SCC", "family_history"]


@register("a15_binary_distribution", O.with_clean(*FEAT_ALL) + "\n" + " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", {v} AS code, count(*) FILTER (WHERE {c} = {v}) AS count, "
    + O.pct(f"count(*) FILTER (WHERE {c} = {v})", "count(*)", 2) + " AS percentage FROM enc"
    for c in _BIN for v in (0, 1)))
def a15_binary_distribution(spark, sf):
    return A.binary_distribution(_feat_unscaled(spark, sf), _BIN)


def _severe_sql(src: str, col: str) -> str:
    return (f"\nSELECT CAST({col} AS VARCHAR) AS \"group\", count(*) AS n, "
            f"count(*) FILTER (WHERE Obesity IN {O.in_list(SEVERE_CLASSES)}) AS n_severe, "
            + O.pct(f"count(*) FILTER (WHERE Obesity IN {O.in_list(SEVERE_CLASSES)})", "count(*)", 1)
            + f" AS severe_pct FROM {src} WHERE Obesity IN {O.in_list(S.class_order)} AND {col} IS NOT NULL GROUP BY {col}")


@register("a17_severe_by_family_history", O.with_analytics() + _severe_sql("base_analytics", "family_history"))
def a17_severe_by_family_history(spark, sf):
    """Share of obesity types I–III with and without family history."""
    return A.severe_share(bases.base_analytics(spark, sf), "family_history")


@register("a17_severe_ratio", O.with_analytics(
    "sh AS (SELECT family_history AS g, CAST(count(*) FILTER (WHERE Obesity IN " + O.in_list(SEVERE_CLASSES)
    + ") AS DOUBLE) / count(*) AS r FROM base_analytics WHERE family_history IS NOT NULL GROUP BY family_history)")
    + "\nSELECT round((SELECT r FROM sh WHERE g = 'yes') / NULLIF((SELECT r FROM sh WHERE g = 'no'), 0), 1) AS ratio")
def a17_severe_ratio(spark, sf):
    return A.severe_ratio(A.severe_share(bases.base_analytics(spark, sf), "family_history"), "yes", "no")


@register("a18_severe_by_flag", O.with_clean(*FEAT_ALL) + _severe_sql("enc", "high_calorie_sedentary"))
def a18_severe_by_flag(spark, sf):
    """Share of obesity types I–III with and without the calorie+sedentary flag."""
    return A.severe_share(_feat_unscaled(spark, sf), "high_calorie_sedentary")


@register("a19_mean_bmi_by_class", O.with_clean(*FEAT_ALL)
          + "\nSELECT d.class_en, d.severity, round(avg(e.BMI), 1) AS mean_bmi FROM enc e JOIN class_dim d "
          "ON e.Obesity = d.class_en GROUP BY d.class_en, d.severity")
def a19_mean_bmi_by_class(spark, sf):
    return A.mean_by_class(_feat_unscaled(spark, sf), "BMI")


def _filter_sql(src: str, filters: dict) -> str:
    conds = []
    g = [x for x in filters.get("gender") or [] if x in S.categorical_values["Gender"]]
    if g:
        conds.append(f"Gender IN {O.in_list(g)}")
    if filters.get("age_min") is not None:
        conds.append(f"Age >= {float(filters['age_min'])}")
    if filters.get("age_max") is not None:
        conds.append(f"Age <= {float(filters['age_max'])}")
    c = [x for x in filters.get("obesity_classes") or [] if x in S.class_order]
    if c:
        conds.append(f"Obesity IN {O.in_list(c)}")
    return f"SELECT * FROM {src}" + (" WHERE " + " AND ".join(conds) if conds else "")


def _pt_select(src: str) -> str:
    lab = "CASE " + " ".join(f"WHEN Obesity = {O.q(k)} THEN {O.q(v)}" for k, v in S.class_labels.items()) + " END"
    cols = ", ".join((f"{lab} AS Obesity" if c == S.target else
                      f"round({c}, 6) AS {c}" if c in S.numeric_ranges else c) for c in S.columns)
    return f"SELECT id, {cols} FROM {src}"


@register("p6_filtered_data", O.with_analytics(f"flt AS ({_filter_sql('base_analytics', FILTERS)})")
          + "\n" + _pt_select("flt"))
def p6_filtered_data(spark, sf):
    """P6/P6a–c/P3: gender, inclusive age bounds and class filters (invalid members ignored),
    target shown with its Portuguese label."""
    return survey_select(P.get_filtered_data(bases.base_analytics(spark, sf), FILTERS))


@register("p6_filtered_no_filter", O.with_analytics(f"flt AS ({_filter_sql('base_analytics', NO_FILTERS)})")
          + "\nSELECT count(*) AS n_rows FROM flt")
def p6_filtered_no_filter(spark, sf):
    """P6 edge: empty lists and an all-invalid class list mean no filter."""
    return P.get_filtered_data(bases.base_analytics(spark, sf), NO_FILTERS).agg(F.count("*").alias("n_rows"))


_A1 = ("cnt AS (SELECT Obesity AS class_en, count(*) AS n FROM base_analytics GROUP BY Obesity)",
       "tot AS (SELECT sum(n) AS total FROM cnt)",
       "dist AS (SELECT d.class_en, d.class_pt, d.severity, coalesce(c.n, 0) AS count, "
       + O.pct("coalesce(c.n, 0)", "t.total", 2) + " AS percentage FROM class_dim d LEFT JOIN cnt c "
       "ON d.class_en = c.class_en CROSS JOIN tot t)")


@register("a20_kpis", O.with_analytics(*_A1, f"flt AS ({_filter_sql('base_analytics', FILTERS)})",
                                       "vis AS (SELECT * FROM dist WHERE class_en IN "
                                       + O.in_list(P.visible_classes(FILTERS)) + ")")
          + "\nSELECT (SELECT count(*) FROM flt) AS n_rows, (SELECT count(*) FROM vis WHERE count > 0) AS n_classes, "
          "CASE WHEN (SELECT sum(count) FROM vis) > 0 THEN (SELECT class_pt FROM vis ORDER BY count DESC, severity LIMIT 1) "
          "ELSE '—' END AS top_class, "
          "coalesce(round((SELECT CAST(max(count) AS DOUBLE) / NULLIF(sum(count), 0) * 100 FROM vis), 1), 0.0) AS top_share")
def a20_kpis(spark, sf):
    """Filtered rows, and of the unfiltered distribution's visible classes: how many have rows,
    which is the largest and its share among them."""
    base = bases.base_analytics(spark, sf)
    return A.kpis(P.filter_spec(base, FILTERS), A.class_distribution(base), P.visible_classes(FILTERS))


_A4 = ("h AS (SELECT Obesity AS class_en, count(*) FILTER (WHERE family_history = 'yes') AS y, "
       "count(*) FILTER (WHERE family_history = 'no') AS n FROM base_analytics GROUP BY Obesity)",
       "ht AS (SELECT sum(y) AS ty, sum(n) AS tn FROM h)",
       f"a4 AS (SELECT d.class_en, d.class_pt, d.severity, {O.pct('coalesce(h.y, 0)', 'ht.ty', 2)} AS with_history_pct, "
       f"{O.pct('coalesce(h.n, 0)', 'ht.tn', 2)} AS without_history_pct FROM class_dim d LEFT JOIN h "
       "ON d.class_en = h.class_en CROSS JOIN ht)")


@register("a21_share_renormalized", O.with_analytics(*_A4, "v AS (SELECT * FROM a4 WHERE class_en IN "
                                                     + O.in_list(P.visible_classes(FILTERS)) + ")")
          + f"\nSELECT class_pt, severity, {O.pct('with_history_pct', '(SELECT sum(with_history_pct) FROM v)', 1)} "
          f"AS with_history_pct, {O.pct('without_history_pct', '(SELECT sum(without_history_pct) FROM v)', 1)} "
          "AS without_history_pct FROM v")
def a21_share_renormalized(spark, sf):
    """The family-history shares of the visible classes re-expressed to sum to 100."""
    a4 = A.family_history_impact(bases.base_analytics(spark, sf))
    dim_names = {S.class_labels[c] for c in P.visible_classes(FILTERS)}
    vis = a4.where(F.col("class_pt").isin(sorted(dim_names)))
    return A.renormalize(vis, ["with_history_pct", "without_history_pct"])


@register("a22_family_history_long", O.with_analytics(*_A4)
          + "\nSELECT class_pt, severity, 'with_history_pct' AS \"group\", with_history_pct AS pct FROM a4 "
          "UNION ALL SELECT class_pt, severity, 'without_history_pct', without_history_pct FROM a4")
def a22_family_history_long(spark, sf):
    """Wide → long of the A4 table."""
    a4 = A.family_history_impact(bases.base_analytics(spark, sf))
    return A.wide_to_long(a4, ["class_pt", "severity"], ["with_history_pct", "without_history_pct"])


_SC = [*S.standard_cols, *S.minmax_cols]


def _a25_sql() -> str:
    parts = []
    for c in _SC:
        parts.append(f"SELECT 'before' AS stage, {O.q(c)} AS \"column\", CAST(round(CAST(avg({c}) AS DECIMAL(28,10)), 4) AS DOUBLE) AS mean, "
                     f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM enc")
        x = O.scaled_sql(c)
        parts.append(f"SELECT 'after', {O.q(c)}, CAST(round(CAST(avg({x}) AS DECIMAL(28,10)), 4) AS DOUBLE), round(stddev_samp({x}), 4), round(min({x}), 4), "
                     f"round(max({x}), 4) FROM enc CROSS JOIN fstats")
    return O.with_clean(*FEAT_ALL) + "\n" + " UNION ALL ".join(parts)


@register("a25_scaling_before_after", _a25_sql())
def a25_scaling_before_after(spark, sf):
    """Mean, sample std, min, max of the scaled columns before and after scaling."""
    base = bases.base_clean(spark, sf)
    model = E.SurveyFeatures().fit(base)
    before = E.summary_encoding(base).select(*_SC)
    after = model.feature_frame(base).select(*_SC)

    def summ(df, stage):
        m = moments(df, _SC)
        return m.select(F.lit(stage).alias("stage"), "column", rounded_mean("mean", 4).alias("mean"),
                        *[F.round(c, 4).alias(c) for c in ("std", "min", "max")])
    return summ(before, "before").unionByName(summ(after, "after"))


@register("p13_display_formats", O.with_analytics(*_A1)
          + "\nSELECT class_en, replace(format('{:,}', count), ',', '.') AS count_text, "
          "CASE WHEN percentage - 10 >= 0 THEN 'positive' ELSE 'negative' END AS vs_ten_pct, "
          "replace(class_en, '_', ' ') AS class_text, printf('%.1f', percentage) || '%' AS percent_text FROM dist")
def p13_display_formats(spark, sf):
    """Thousands separator, sign label, underscores to spaces on the A1 table."""
    d = A.class_distribution(bases.base_analytics(spark, sf))
    return d.select("class_en", P.thousands(F.col("count")).alias("count_text"),
                    P.sign_label(F.col("percentage") - 10).alias("vs_ten_pct"),
                    P.underscores_to_spaces(F.col("class_en")).alias("class_text"),
                    P.percent1(F.col("percentage")).alias("percent_text"))


@register("p5_labels_back", O.with_analytics() + "\nSELECT Obesity, count(*) AS n FROM base_analytics GROUP BY Obesity")
def p5_labels_back(spark, sf):
    """P5 after P3: Portuguese labels mapped back to the dataset's values, counted per class."""
    shown = P.get_filtered_data(bases.base_analytics(spark, sf), {})
    return P.translate_back(shown, S.target, S.class_labels).groupBy(S.target).agg(F.count("*").alias("n"))
