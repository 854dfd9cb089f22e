"""Registered feature-engineering (E*) and correlation (K*) queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import round_columns
from ..operators import correlate as K
from ..operators import features as E
from ..operators import validate as V
from ..spec import FEATURE_INTERPRETATIONS_PT, OBESITY
from . import bases
from . import oracle as O
from .registry import register

S = OBESITY
FEAT = (O.FEAT_BASE, O.ENC, O.FSTATS)
FEAT_ALL = (O.ALL_ROWS, O.ENC, O.FSTATS)  # summaries: every cleaned row


def fitted(spark, sf):
    base = bases.feature_base(spark, sf)
    return base, E.SurveyFeatures().fit(base)


def unscaled(base):
    enc = E.encoded_columns(S)
    return base.select("id", S.target, *[e.alias(n) for n, e in enc.items()])


@register("e11_features", O.with_clean(*FEAT) + "\n" + O.FEATURES_SELECT)
def e11_features(spark, sf):
    base, model = fitted(spark, sf)
    return round_columns(model.feature_frame(base), S.feature_names, 6, keep=("id",))


_SCORES = ["BMI", "eating_score", "lifestyle_score", "high_calorie_sedentary"]


@register("e1_e4_scores", O.with_clean(*FEAT) + "\nSELECT id, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _SCORES) + " FROM enc")
def e1_e4_scores(spark, sf):
    u = unscaled(bases.feature_base(spark, sf))
    return u.select("id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _SCORES])


_PARAMS_SQL = " UNION ALL ".join(
    [f"SELECT {O.q(c)} AS \"column\", 'standard' AS scaler, round(mean_{c}, 6) AS center, round(std_{c}, 6) AS scale FROM fstats"
     for c in S.standard_cols]
    + [f"SELECT {O.q(c)}, 'minmax', round(min_{c}, 6), round(max_{c} - min_{c}, 6) FROM fstats" for c in S.minmax_cols])


@register("e8_e9_scaler_params", O.with_clean(*FEAT) + "\n" + _PARAMS_SQL)
def e8_e9_scaler_params(spark, sf):
    """The 18 learned numbers — one aggregate job in ``fit``."""
    _, model = fitted(spark, sf)
    rows = [(c, k, round(a, 6), round(b, 6)) for c, k, a, b in model.scaler_table()]
    return spark.createDataFrame(rows, "column string, scaler string, center double, scale double")


_SCALED = [*S.standard_cols, *S.minmax_cols]


@register("e13_inverse_roundtrip", O.with_clean(*FEAT) + "\nSELECT " + ", ".join(
    f"round(max(abs(({O.scaled_sql(c)}) * "
    + (f"(CASE WHEN coalesce(fstats.std_{c}, 0) = 0 THEN 1.0 ELSE fstats.std_{c} END) + fstats.mean_{c}"
       if c in S.standard_cols else
       f"(CASE WHEN coalesce(fstats.max_{c} - fstats.min_{c}, 0) = 0 THEN 1.0 ELSE fstats.max_{c} - fstats.min_{c} END) + fstats.min_{c}")
    + f" - enc.{c})), 6) AS err_{c}" for c in _SCALED) + " FROM enc CROSS JOIN fstats")
def e13_inverse_roundtrip(spark, sf):
    """Largest |inverse(transform(x)) − x| per scaled column."""
    base, model = fitted(spark, sf)
    scaled, raw = model.scaled_columns(), E.encoded_columns(S)
    both = base.select(*[scaled[c].alias(c) for c in _SCALED], *[raw[c].alias(f"raw_{c}") for c in _SCALED])
    back = model.inverse(both)
    return back.agg(*[F.round(F.max(F.abs(F.col(c) - F.col(f"raw_{c}"))), 6).alias(f"err_{c}") for c in _SCALED])


_AENC_COLS = [*S.correlation_features, "Obesity_encoded"]


@register("e14_correlation_encoding", O.with_analytics(O.analytics_encoding_sql())
          + "\nSELECT id, " + ", ".join(_AENC_COLS) + " FROM aenc")
def e14_correlation_encoding(spark, sf):
    return E.correlation_encoding(bases.base_analytics(spark, sf))


_XENC_COLS = [*S.numeric_cols, "Gender", "family_history", "FAVC", "SMOKE", "SCC", "CAEC", "CALC", "MTRANS",
              "Obesity_Ordinal"]


@register("e16_exploratory_encoding", O.with_clean(O.exploratory_encoding_sql())
          + "\nSELECT id, " + ", ".join(_XENC_COLS) + " FROM xenc")
def e16_exploratory_encoding(spark, sf):
    return E.exploratory_encoding(bases.base_clean(spark, sf)).select("id", *_XENC_COLS)


def _alt_sql(scoring: bool = False) -> str:
    from ..spec import ALT_DEFAULTS, MTRANS_ALPHABETICAL
    cols = [f"CAST({c} AS DOUBLE) AS {c}" for c in S.numeric_cols]
    cols.append("CAST(CASE WHEN Gender = 'Male' THEN 1 ELSE 0 END AS DOUBLE) AS Gender")
    cols += [f"CAST(CASE WHEN {c} = 'yes' THEN 1 ELSE 0 END AS DOUBLE) AS {c}"
             for c in ("family_history", "FAVC", "SMOKE", "SCC")]
    fill = (lambda c, x: f"coalesce({x}, {ALT_DEFAULTS[c]}.0)") if scoring else (lambda c, x: x)
    cols += [f"{fill(c, O.ordinal_sql(c))} AS {c}" for c in S.ordinal_cols]
    mw = " ".join(f"WHEN MTRANS = {O.q(k)} THEN {v}" for k, v in MTRANS_ALPHABETICAL.items())
    cols.append(fill("MTRANS", f"CAST(CASE {mw} END AS DOUBLE)") + " AS MTRANS")
    return "SELECT id, Obesity, " + ", ".join(cols) + " FROM base_clean"


@register("e17_alternative_encoding", O.with_clean() + "\n" + _alt_sql())
def e17_alternative_encoding(spark, sf):
    """E17 in training: unknown categories are NULL."""
    return E.alternative_encoding(bases.base_clean(spark, sf))


@register("e17_scoring_encoding", O.with_clean() + "\n" + _alt_sql(scoring=True))
def e17_scoring_encoding(spark, sf):
    """E17 in scoring: unknown categories get the defaults."""
    return E.alternative_encoding(bases.base_clean(spark, sf), scoring=True)


@register("e18_feature_telemetry", O.with_clean(*FEAT) + "\nSELECT " + ", ".join(
    f"round(avg({s}), 6) AS {s}_mean, round(min({s}), 6) AS {s}_min, round(max({s}), 6) AS {s}_max"
    for s in ("BMI", "eating_score", "lifestyle_score"))
    + ", CAST(coalesce(sum(high_calorie_sedentary), 0) AS BIGINT) AS n_flagged, "
    "round(avg(high_calorie_sedentary) * 100.0, 2) AS pct_flagged FROM enc")
def e18_feature_telemetry(spark, sf):
    return E.telemetry(unscaled(bases.feature_base(spark, sf)))


_OHE = [f"{S.onehot_col}_{c}" for c in S.onehot_categories]


@register("v10_feature_invariants", O.with_clean(*FEAT) + "\nSELECT round(coalesce(max(abs(BMI - Weight / (Height * Height))), 0.0), 9) "
          "AS max_bmi_error, coalesce(max(abs(BMI - Weight / (Height * Height))), 0.0) < 0.001 AS bmi_ok, "
          f"count(*) FILTER (WHERE {' + '.join(_OHE)} <> 1) AS onehot_violations, "
          f"coalesce(bool_and({' + '.join(_OHE)} = 1), true) AS onehot_ok FROM enc")
def v10_feature_invariants(spark, sf):
    return V.feature_invariants(unscaled(bases.feature_base(spark, sf)))


# --------------------------------------------------------------------------- correlation
def _sp_select(places=4):
    return (f"\nSELECT feature, round(rho, {places}) AS correlation, round(abs(rho), {places}) AS abs_correlation, "
            "CAST(n AS BIGINT) AS n FROM sp")


def k1_frame(spark, sf):
    enc = E.correlation_encoding(bases.base_analytics(spark, sf))
    return K.spearman_vs_target(enc, S.correlation_features, "Obesity_encoded")


@register("k1_spearman", O.with_analytics(O.analytics_encoding_sql(), O.spearman_sql("aenc", S.correlation_features,
                                                                                       "Obesity_encoded")) + _sp_select())
def k1_spearman(spark, sf):
    """K1 (+W1): 15 features vs the ordinal target, listwise NULL deletion, average ranks."""
    return k1_frame(spark, sf)


@register("k6_top_risk_factors", O.with_analytics(
    O.analytics_encoding_sql(), O.spearman_sql("aenc", S.correlation_features, "Obesity_encoded"),
    "spr AS (SELECT feature, round(rho, 4) AS correlation, round(abs(rho), 4) AS abs_correlation FROM sp)",
    "top AS (SELECT * FROM spr ORDER BY abs_correlation DESC, feature LIMIT 5)",
    "txt AS (SELECT * FROM (VALUES " + ", ".join(f"({O.q(k)}, {O.q(v)})" for k, v in
                                                  FEATURE_INTERPRETATIONS_PT.items())
    + ") AS t(feature, interpretation_pt))")
    + "\nSELECT top.feature, top.correlation, CASE WHEN top.correlation >= 0 THEN 'positivo' ELSE 'negativo' END AS direction, "
    "coalesce(txt.interpretation_pt, 'Feature ''' || top.feature || ''' apresenta correlação ' || "
    "CASE WHEN top.correlation >= 0 THEN 'positivo' ELSE 'negativo' END || ' com obesidade') AS interpretation_pt "
    "FROM top LEFT JOIN txt ON top.feature = txt.feature")
def k6_top_risk_factors(spark, sf):
    return K.top_risk_factors(k1_frame(spark, sf), 5)


@register("k3_spearman_bmi", O.with_clean(*FEAT_ALL, "kb AS (SELECT BMI, CASE " + " ".join(
    f"WHEN Obesity = {O.q(c)} THEN {i}" for i, c in enumerate(S.class_order)) + " END AS sev FROM enc)",
    O.spearman_sql("kb", ["BMI"], "sev")) + _sp_select())
def k3_spearman_bmi(spark, sf):
    """K3: single pair — BMI vs target ordinal over all cleaned rows."""
    u = E.summary_encoding(bases.base_clean(spark, sf))
    sev = E.lookup_case(S.target, {c: i for i, c in enumerate(S.class_order)}).cast("double")
    return K.spearman_vs_target(u.select("BMI", sev.alias("sev")), ["BMI"], "sev")


_K4 = [*S.numeric_cols, "BMI"]


@register("k4_numeric_vs_target", O.with_analytics("kb AS (SELECT " + ", ".join(S.numeric_cols)
    + ", Weight / (Height * Height) AS BMI, CASE " + " ".join(
        f"WHEN Obesity = {O.q(c)} THEN {i}" for i, c in enumerate(S.class_order)) + " END AS sev FROM base_analytics)",
    O.spearman_sql("kb", _K4, "sev"))
    + "\nSELECT feature, CASE WHEN n < 3 OR rho IS NULL OR isnan(rho) THEN 0.0 ELSE round(rho, 4) END AS correlation "
    "FROM sp")
def k4_numeric_vs_target(spark, sf):
    """K4: numeric columns (+BMI) vs target over the analytics base, whose NULLs are deleted pair by
    pair; fewer than 3 pairs or undefined ρ → 0.0."""
    base = bases.base_analytics(spark, sf)
    sev = E.lookup_case(S.target, {c: i for i, c in enumerate(S.class_order)}).cast("double")
    u = base.select(*S.numeric_cols, E.bmi().alias("BMI"), sev.alias("sev"))
    r = K.spearman_vs_target(u, _K4, "sev")
    return r.select("feature", F.when((F.col("n") < 3) | F.col("correlation").isNull() | F.isnan("correlation"), 0.0)
                    .otherwise(F.col("correlation")).alias("correlation"))


_K5_BEFORE = [c for c in _XENC_COLS if c != "Obesity_Ordinal"]
# FIXED VALUES: the transformed features that are compared; the one-hot transport columns are left out
_K5_AFTER = ["Age", "Height", "Weight", "BMI", "FCVC", "NCP", "CH2O", "FAF", "TUE", "eating_score", "lifestyle_score",
             "high_calorie_sedentary", "Gender", "FAVC", "SMOKE", "SCC", "family_history", "CAEC", "CALC"]


def _k5_sql() -> str:
    before = ("kx AS (SELECT x.* EXCLUDE (id) FROM xenc x)")
    after = ("ka AS (SELECT " + ", ".join(f"e.{c}" for c in _K5_AFTER) + ", CASE " + " ".join(
        f"WHEN e.Obesity = {O.q(c)} THEN {i}" for i, c in enumerate(S.class_order)) + " END AS Obesity_Ordinal FROM enc e)")
    sp_b = O.spearman_sql("kx", _K5_BEFORE, "Obesity_Ordinal").replace("sp_long", "spb_long").replace(
        "sp_rank", "spb_rank").replace("sp AS", "spb AS")
    sp_a = O.spearman_sql("ka", _K5_AFTER, "Obesity_Ordinal").replace("sp_long", "spa_long").replace(
        "sp_rank", "spa_rank").replace("sp AS", "spa AS")
    return (O.with_clean(*FEAT, O.exploratory_encoding_sql("feat_base"), before, after, sp_b, sp_a)
            + "\nSELECT coalesce(a.feature, b.feature) AS feature, round(b.rho, 4) AS rho_before, "
            "round(a.rho, 4) AS rho_after FROM spa a FULL OUTER JOIN spb b ON a.feature = b.feature")


@register("k5_fe_comparison", _k5_sql())
def k5_fe_comparison(spark, sf):
    """K5: ρ with the target of the 16 encoded inputs and of the 19 transformed features. Unscaled
    values stand for the scaled ones, which have the same ranks. Both lists come from one projection
    and are ranked in one call."""
    base = bases.feature_base(spark, sf)
    raw, new = E.exploratory_columns(), E.encoded_columns(S)
    both = base.select(*[raw[c].alias(f"before_{c}") for c in _K5_BEFORE], *[new[c].alias(f"after_{c}") for c in _K5_AFTER],
                       raw["Obesity_Ordinal"].alias("Obesity_Ordinal"))
    names = [c for c in both.columns if c != "Obesity_Ordinal"]
    rho = K.spearman_vs_target(both, names, "Obesity_Ordinal").select(
        F.regexp_replace("feature", "^(before|after)_", "").alias("name"), F.col("feature").startswith("before_").alias("is_before"),
        "correlation")
    return rho.groupBy(F.col("name").alias("feature")).agg(
        F.max(F.when(F.col("is_before"), F.col("correlation"))).alias("rho_before"),
        F.max(F.when(~F.col("is_before"), F.col("correlation"))).alias("rho_after"))


@register("t4_correlations_ascending", O.with_analytics(
    O.analytics_encoding_sql(), O.spearman_sql("aenc", S.correlation_features, "Obesity_encoded"),
    "r AS (SELECT feature, round(rho, 4) AS correlation FROM sp)")
    + "\nSELECT CAST(row_number() OVER (ORDER BY correlation, feature) AS INTEGER) AS position, feature, correlation, "
    "printf('%+.3f', correlation) AS correlation_text FROM r")
def t4_correlations_ascending(spark, sf):
    """T4 + P13: the K1 table in ascending signed order (one row per feature) with the chart's labels."""
    from pyspark.sql import Window
    from ..operators.filters import signed3
    order = Window.orderBy("correlation", "feature")
    return k1_frame(spark, sf).select(F.row_number().over(order).alias("position"), "feature", "correlation",
                                      signed3(F.col("correlation")).alias("correlation_text"))


def _k2_sql() -> str:
    from itertools import combinations
    cols = _XENC_COLS
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(
            f"SELECT {O.q(a)} AS a, {O.q(b)} AS b, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho "
            f"FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM xenc WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t")
    diag = " UNION ALL ".join(f"SELECT {O.q(c)}, {O.q(c)}, 1.0" for c in cols)
    return (O.with_clean(O.exploratory_encoding_sql(), "pairs AS (" + " UNION ALL ".join(parts) + ")")
            + "\nSELECT a, b, round(rho, 4) AS rho FROM pairs UNION ALL SELECT b, a, round(rho, 4) FROM pairs "
            f"UNION ALL SELECT * FROM ({diag}) d")


@register("k2_spearman_matrix", _k2_sql())
def k2_spearman_matrix(spark, sf):
    """K2: 17×17 Spearman matrix with pairwise NULL deletion (long format)."""
    x = E.exploratory_encoding(bases.base_clean(spark, sf))
    return K.spearman_matrix(x, _XENC_COLS)


_W1 = ["Age", "Weight", "FAF"]


@register("w1_average_ranks", O.with_clean(
    "wl AS (" + " UNION ALL ".join(f"SELECT {O.q(c)} AS \"column\", {c} AS value FROM base_clean WHERE {c} IS NOT NULL"
                                   for c in _W1) + ")",
    "wc AS (SELECT \"column\", value, count(*) AS cnt FROM wl GROUP BY \"column\", value)")
    + "\nSELECT \"column\", round(value, 6) AS value, cnt, coalesce(sum(cnt) OVER (PARTITION BY \"column\" ORDER BY value "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1) / 2.0 AS rank FROM wc")
def w1_average_ranks(spark, sf):
    """Tie-averaged rank of every distinct value (distributed prefix sums over the
    distinct-value table; no window spans a whole column)."""
    from ..functions.stats import average_ranks, to_long
    long = to_long(bases.base_clean(spark, sf), _W1)
    r = average_ranks(long, ["column"], "v")
    return r.select("column", F.round("v", 6).alias("value"), "cnt", "rank")
