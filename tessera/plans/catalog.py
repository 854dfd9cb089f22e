"""Registered queries: one per operator ID, each with its oracle SQL where SQL can say it.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
survey view derived from ``lineitem``; those that need statistics, ranks or quantiles
run the jobs for them when called. Doubles are rounded in the query
(and identically in the oracle) so both engines' last-digit noise cannot differ.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import summary as A
from ..operators import validate as V
from ..spec import OBESITY
from . import bases
from . import oracle as O
from .registry import register, sql_survey_select, survey_select

S = OBESITY


# --------------------------------------------------------------------------- sources
@register("s0_survey_raw", O.with_raw() + "\n" + sql_survey_select("survey_raw"))
def s0_survey_raw(spark, sf):
    return survey_select(bases.raw(spark, sf))


# --------------------------------------------------------------------------- cleaning
@register("c1_remove_duplicates", O.with_dedup() + "\n" + sql_survey_select("dedup"))
def c1_remove_duplicates(spark, sf):
    return survey_select(C.remove_duplicates(bases.raw(spark, sf)))


_MED_SQL = " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median, "
    f"count(*) - count({c}) AS n_missing FROM dedup" for c in S.numeric_cols)


@register("c2_numeric_medians", O.with_dedup() + f"\nSELECT * FROM ({_MED_SQL}) t")
def c2_numeric_medians(spark, sf):
    from ..functions.stats import exact_quantiles
    d = bases.deduplicated(spark, sf)
    med = exact_quantiles(d, S.numeric_cols, [0.5]).select("column", F.round("value", 6).alias("median"))
    nulls = C.null_counts(d, S.numeric_cols).unpivot([], S.numeric_cols, "column", "n_missing")
    return med.join(nulls, "column", "right").select("column", "median", F.col("n_missing").cast("long"))


_MODE_SQL = " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", (SELECT v FROM mode_{c}) AS mode, "
    f"(SELECT count(*) - count({c}) FROM imp) AS n_missing" for c in S.categorical_cols)


@register("c3_category_modes", O.with_dedup(*O.CLEAN.split(",\nimp2")[0:1]) + f"\nSELECT * FROM ({_MODE_SQL}) t")
def c3_category_modes(spark, sf):
    d = bases.deduplicated(spark, sf)
    modes = C.category_modes(d, only_missing=False)
    nulls = C.null_counts(d, S.categorical_cols).first().asDict()
    rows = [(c, modes.get(c), int(nulls[c])) for c in S.categorical_cols]
    return spark.createDataFrame(rows, "column string, mode string, n_missing long")


_C7 = " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", CAST(sum(CASE WHEN {O.canonical(c, v)} IS NOT DISTINCT FROM {c} THEN 0 ELSE 1 END) "
    f"AS BIGINT) AS changed FROM imp2" for c, v in S.categorical_values.items())


@register("c4_standardize_case", O.with_dedup(O.CLEAN) + f"\nSELECT * FROM ({_C7}) t")
def c4_standardize_case(spark, sf):
    """C4+C7: how many values case standardisation changes per column (after imputation)."""
    d = bases.deduplicated(spark, sf)
    d = C.impute_categorical(C.impute_numeric(d))
    return C.normalized_counts(d)


@register("c5_clean", O.with_dedup(O.CLEAN) + "\n" + sql_survey_select("base_clean"))
def c5_clean(spark, sf):
    return survey_select(bases.base_clean(spark, sf))


_C6_ITEMS = ["SELECT 'duplicates_removed' AS item, (SELECT count(*) FROM survey_raw) - (SELECT count(*) FROM dedup) AS value",
             "SELECT 'rows_before', (SELECT count(*) FROM survey_raw)",
             "SELECT 'cols_before', CAST(18 AS BIGINT)",
             "SELECT 'rows_after', (SELECT count(*) FROM base_clean)",
             "SELECT 'cols_after', CAST(18 AS BIGINT)"] + [
    f"SELECT 'missing:{c}', (SELECT count(*) - count({c}) FROM survey_raw)" for c in S.columns]


@register("c6_cleaning_report", O.with_dedup(O.CLEAN) + "\nSELECT item, CAST(value AS BIGINT) AS value FROM ("
          + " UNION ALL ".join(_C6_ITEMS) + ") t WHERE item NOT LIKE 'missing:%' OR value > 0")
def c6_cleaning_report(spark, sf):
    raw = bases.raw(spark, sf)
    return C.cleaning_report(raw, bases.base_clean(spark, sf), bases.deduplicated(spark, sf))


@register("c8_remaining_nulls", O.with_dedup(O.CLEAN) + "\nSELECT CAST("
          + " + ".join(f"(count(*) - count({c}))" for c in S.columns) + " AS BIGINT) AS remaining_nulls FROM base_clean")
def c8_remaining_nulls(spark, sf):
    return C.remaining_nulls(bases.base_clean(spark, sf))


@register("c9_known_classes", O.with_analytics() + "\n" + sql_survey_select("base_analytics"))
def c9_known_classes(spark, sf):
    return survey_select(bases.base_analytics(spark, sf))


# --------------------------------------------------------------------------- validation
def _viol_sql() -> str:
    parts = []
    for i, (c, (lo, hi, lo_t, hi_t)) in enumerate(S.numeric_ranges.items()):
        parts.append(
            f"SELECT id, {O.q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value, 'range' AS rule, {i} AS rule_ord, "
            f"'Row ' || CAST(id AS VARCHAR) || ': {c} value ' || coalesce(CAST({c} AS VARCHAR), 'nan') || "
            f"' is out of range [{lo_t}, {hi_t}]' AS message FROM survey_raw "
            f"WHERE NOT coalesce({c} BETWEEN {lo} AND {hi}, false)")
    base = len(S.numeric_ranges)
    for j, (c, vals) in enumerate(S.categorical_values.items()):
        shown = O.q(" is not in valid values " + V.py_list_text(vals))
        parts.append(
            f"SELECT id, {O.q(c)}, {c}, 'domain', {base + j}, "
            f"'Row ' || CAST(id AS VARCHAR) || ': {c} value ''' || coalesce({c}, 'nan') || '''' || {shown} "
            f"FROM survey_raw WHERE NOT coalesce({c} IN {O.in_list(vals)}, false)")
    return " UNION ALL ".join(parts)


VIOL_CTE = f"viol AS ({_viol_sql()})"


@register("v4_violations", O.with_raw(VIOL_CTE) + "\nSELECT id, \"column\", value, rule, rule_ord, message FROM viol")
def v4_violations(spark, sf):
    return V.violations(bases.raw(spark, sf))


@register("v5_is_valid", O.with_raw(VIOL_CTE) + "\nSELECT count(*) = 0 AS is_valid, count(*) AS n_errors FROM viol")
def v5_is_valid(spark, sf):
    return V.is_valid(V.violations(bases.raw(spark, sf)))


@register("v7_error_preview", O.with_raw(VIOL_CTE) + "\nSELECT id, \"column\", value, rule, rule_ord, message FROM viol "
          "ORDER BY rule_ord, id LIMIT 10")
def v7_error_preview(spark, sf):
    return V.preview(V.violations(bases.raw(spark, sf)))


@register("v8_violation_counts", O.with_raw(VIOL_CTE) + "\nSELECT \"column\", rule, count(*) AS n FROM viol GROUP BY \"column\", rule")
def v8_violation_counts(spark, sf):
    return V.counts_by_rule(V.violations(bases.raw(spark, sf)))


def _v6_sql() -> str:
    msgs = [f"CASE WHEN {c} IS NULL THEN {O.q(f'Missing field: {chr(39)}{c}{chr(39)}')} END" for c in S.input_cols]
    for c, (lo, hi, lo_t, hi_t) in S.numeric_ranges.items():
        msgs.append(f"CASE WHEN {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}) THEN "
                    f"'{c} value ' || CAST({c} AS VARCHAR) || ' is out of range [{lo_t}, {hi_t}]' END")
    for c, vals in S.categorical_values.items():
        if c == S.target:
            continue
        msgs.append(f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN {O.in_list(vals)} THEN "
                    f"'{c} value ''' || {c} || '''' || {O.q(' is not in valid values ' + V.py_list_text(vals))} END")
    arr = "list_filter([" + ", ".join(msgs) + "], lambda m: m IS NOT NULL)"
    return (O.with_raw() + f",\nchecked AS (SELECT id, {arr} AS errors FROM survey_raw)\n"
            "SELECT id, CAST(len(errors) AS INTEGER) AS n_errors, array_to_string(errors, ' | ') AS errors "
            "FROM checked WHERE len(errors) > 0")


@register("v6_record_errors", _v6_sql())
def v6_record_errors(spark, sf):
    """V6 on every raw row taken as a scoring record: rejected rows and their messages."""
    checked = V.record_errors(bases.raw(spark, sf).drop(S.target))
    return checked.where(F.size("errors") > 0).select(
        "id", F.size("errors").alias("n_errors"), F.array_join("errors", " | ").alias("errors"))


# --------------------------------------------------------------------------- summaries
@register("a1_class_distribution", O.with_analytics(
    "cnt AS (SELECT Obesity AS class_en, count(*) AS n FROM base_analytics GROUP BY Obesity)",
    "tot AS (SELECT coalesce(sum(n), 0) AS total FROM cnt)")
    + "\nSELECT d.class_en, d.class_pt, d.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS count, "
    + O.pct("coalesce(c.n, 0)", "t.total", 2) + " AS percentage "
    "FROM class_dim d LEFT JOIN cnt c ON d.class_en = c.class_en CROSS JOIN tot t")
def a1_class_distribution(spark, sf):
    return A.class_distribution(bases.base_analytics(spark, sf))


@register("a2_age_by_class", O.with_analytics()
          + "\nSELECT d.class_pt, d.severity, round(avg(b.Age), 1) AS mean_age, "
          "round(quantile_cont(b.Age, 0.5), 1) AS median_age FROM base_analytics b "
          "JOIN class_dim d ON b.Obesity = d.class_en GROUP BY d.class_pt, d.severity")
def a2_age_by_class(spark, sf):
    return A.age_by_class(bases.base_analytics(spark, sf))


@register("a3_gender_by_class", O.with_analytics(
    "gc AS (SELECT Obesity AS class_en, count(*) AS n, count(*) FILTER (WHERE Gender = 'Male') AS m, "
    "count(*) FILTER (WHERE Gender = 'Female') AS f FROM base_analytics WHERE Gender IS NOT NULL GROUP BY Obesity)")
    + f"\nSELECT d.class_pt, d.severity, {O.pct('gc.m', 'gc.n', 1)} AS Male_pct, {O.pct('gc.f', 'gc.n', 1)} AS Female_pct "
    "FROM class_dim d JOIN gc ON d.class_en = gc.class_en")
def a3_gender_by_class(spark, sf):
    return A.gender_by_class(bases.base_analytics(spark, sf))


@register("a4_family_history_impact", O.with_analytics(
    "h AS (SELECT Obesity AS class_en, count(*) FILTER (WHERE family_history = 'yes') AS y, "
    "count(*) FILTER (WHERE family_history = 'no') AS n FROM base_analytics GROUP BY Obesity)",
    "t AS (SELECT sum(y) AS ty, sum(n) AS tn FROM h)")
    + f"\nSELECT d.class_pt, d.severity, {O.pct('coalesce(h.y, 0)', 't.ty', 2)} AS with_history_pct, "
    f"{O.pct('coalesce(h.n, 0)', 't.tn', 2)} AS without_history_pct "
    "FROM class_dim d LEFT JOIN h ON d.class_en = h.class_en CROSS JOIN t")
def a4_family_history_impact(spark, sf):
    return A.family_history_impact(bases.base_analytics(spark, sf))


def _describe_sql(src: str, cols, quartiles=True) -> str:
    parts = []
    for c in cols:
        qs = (f", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q2, "
              f"round(quantile_cont({c}, 0.75), 4) AS q3") if quartiles else ""
        parts.append(f"SELECT {O.q(c)} AS \"column\", CAST(round(CAST(avg({c}) AS DECIMAL(28,10)), 4) AS DOUBLE) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, "
                     f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max{qs} FROM {src}")
    return " UNION ALL ".join(parts)


@register("a7_describe_numeric", O.with_clean() + "\n" + _describe_sql("base_clean", S.numeric_cols))
def a7_describe_numeric(spark, sf):
    """A5+A6+A7: describe + quartiles of the numeric columns of the cleaned base."""
    return A.describe(bases.base_clean(spark, sf), S.numeric_cols)


_CAT_IN = [c for c in S.categorical_cols if c != S.target]


@register("a8_frequency_tables", O.with_clean(
    "lng AS (" + " UNION ALL ".join(f"SELECT {O.q(c)} AS \"column\", {c} AS value FROM base_clean" for c in _CAT_IN) + ")",
    "cnt AS (SELECT \"column\", value, count(*) AS count FROM lng WHERE value IS NOT NULL GROUP BY \"column\", value)")
    + "\nSELECT \"column\", value, count, " + O.pct("count", "sum(count) OVER (PARTITION BY \"column\")", 2)
    + " AS percentage FROM cnt")
def a8_frequency_tables(spark, sf):
    return A.frequency_table(bases.base_clean(spark, sf), _CAT_IN)


_A1_CLEAN = ("cnt AS (SELECT Obesity AS class_en, count(*) AS n FROM base_clean GROUP BY Obesity)",
             "dist AS (SELECT d.class_en, d.severity, coalesce(c.n, 0) AS n FROM class_dim d LEFT JOIN cnt c "
             "ON d.class_en = c.class_en)")


@register("a9_class_imbalance", O.with_clean(*_A1_CLEAN)
          + "\nSELECT (SELECT class_en FROM dist ORDER BY n DESC, severity LIMIT 1) AS most_frequent, "
          "(SELECT class_en FROM dist ORDER BY n ASC, severity LIMIT 1) AS least_frequent, "
          "(SELECT max(n) FROM dist) AS max_count, (SELECT min(n) FROM dist) AS min_count, "
          "round(CAST((SELECT max(n) FROM dist) AS DOUBLE) / NULLIF((SELECT min(n) FROM dist), 0), 2) AS ratio")
def a9_class_imbalance(spark, sf):
    return A.class_imbalance(A.class_distribution(bases.base_clean(spark, sf)))


@register("a14_top_pairs", O.with_clean() + "\nSELECT CAEC, CALC, count(*) AS count FROM base_clean "
          "GROUP BY CAEC, CALC ORDER BY count DESC, CAEC NULLS FIRST, CALC NULLS FIRST LIMIT 10")
def a14_top_pairs(spark, sf):
    return A.top_pairs(bases.base_clean(spark, sf), "CAEC", "CALC", 10)


@register("a16_distinct_counts", O.with_clean() + "\n" + " UNION ALL ".join(
    f"SELECT {O.q(c)} AS \"column\", count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct FROM base_clean" for c in S.columns))
def a16_distinct_counts(spark, sf):
    return A.distinct_counts(bases.base_clean(spark, sf), S.columns)


@register("a23_histogram_age", O.with_clean(
    "r AS (SELECT min(Age) AS lo, max(Age) AS hi FROM base_clean)",
    "hb AS (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((Age - r.lo) / ((r.hi - r.lo) / 20)), 19) END AS INTEGER) AS bin "
    "FROM base_clean, r WHERE Age IS NOT NULL)",
    "hc AS (SELECT bin, count(*) AS n FROM hb GROUP BY bin)",
    "grid AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 20) t(i))")
    + "\nSELECT 'Age' AS \"column\", grid.bin, round(r.lo + grid.bin * (r.hi - r.lo) / 20, 6) AS bin_lo, "
    "round(r.lo + (grid.bin + 1) * (r.hi - r.lo) / 20, 6) AS bin_hi, CAST(coalesce(hc.n, 0) AS BIGINT) AS count "
    "FROM grid CROSS JOIN r LEFT JOIN hc ON grid.bin = hc.bin")
def a23_histogram_age(spark, sf):
    return A.histogram(bases.base_clean(spark, sf), "Age", 20)


def _box_sql(col: str) -> str:
    return O.with_clean(
        f"qs AS (SELECT Obesity AS class_en, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med, "
        f"quantile_cont({col}, 0.75) AS q3 FROM base_clean WHERE Obesity IS NOT NULL GROUP BY Obesity)",
        f"j AS (SELECT b.Obesity AS class_en, b.{col} AS v, qs.q1, qs.med, qs.q3, "
        f"b.{col} BETWEEN qs.q1 - 1.5 * (qs.q3 - qs.q1) AND qs.q3 + 1.5 * (qs.q3 - qs.q1) AS inside "
        f"FROM base_clean b JOIN qs ON b.Obesity = qs.class_en)",
        "a AS (SELECT class_en, q1, med, q3, min(CASE WHEN inside THEN v END) AS wlo, max(CASE WHEN inside THEN v END) AS whi, "
        "count(*) FILTER (WHERE v IS NOT NULL AND NOT inside) AS n_out FROM j GROUP BY class_en, q1, med, q3)") + \
        "\nSELECT d.class_en, d.severity, round(a.q1, 4) AS q1, round(a.med, 4) AS median, round(a.q3, 4) AS q3, " \
        "round(a.wlo, 4) AS whisker_lo, round(a.whi, 4) AS whisker_hi, a.n_out AS n_outliers " \
        "FROM class_dim d JOIN a ON d.class_en = a.class_en"


@register("a24_box_weight", _box_sql("Weight"))
def a24_box_weight(spark, sf):
    return A.box_summary(bases.base_clean(spark, sf), "Weight")


@register("a26_shape", O.with_clean() + "\nSELECT count(*) AS n_rows, 18 AS n_cols FROM base_clean")
def a26_shape(spark, sf):
    return A.shape(bases.base_clean(spark, sf))


@register("a26_head", O.with_clean() + "\n" + sql_survey_select("base_clean") + " ORDER BY id LIMIT 5")
def a26_head(spark, sf):
    return A.head(survey_select(bases.base_clean(spark, sf)))


@register("s1_csv_roundtrip", O.with_raw() + "\n" + sql_survey_select("survey_raw"))
def s1_csv_roundtrip(spark, sf):
    """The survey view written as header CSV in the shared folder and read back with the
    CSV source (schema given, every pandas NA token → NULL, NaN → NULL)."""
    import uuid

    from ..session import shared_dir
    from ..sources.survey import read_survey_csv
    path = f"{shared_dir(spark)}/tessera/csv-{uuid.uuid4().hex[:8]}"
    (bases.raw(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path))
    return survey_select(read_survey_csv(spark, path))
