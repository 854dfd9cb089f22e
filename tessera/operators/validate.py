"""Schema, range and domain validation as DataFrames of violations.

Violations are produced in one scan: every row builds an array of candidate
(column, value, rule, message) structs, keeps the failing ones and explodes them —
no per-column scans, no unions, nothing collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import in_domain, in_range
from ..spec import OBESITY, SurveySpec

VIOLATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("rule_ord", T.IntegerType()), T.StructField("message", T.StringType()),
])


def missing_columns(df: DataFrame, spec: SurveySpec = OBESITY, required=None) -> list:
    """V1: required columns absent from the frame, in the spec's order (schema only, no job)."""
    required = spec.columns if required is None else required
    return [c for c in required if c not in df.columns]


def py_list_text(values) -> str:
    """The printed form of a Python list of strings, as used in the messages."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _text(c: str, quoted: bool) -> Column:
    shown = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return F.concat(F.lit("'"), shown, F.lit("'")) if quoted else shown


def violation_checks(spec: SurveySpec = OBESITY):
    """(column, rule, ordinal, is_bad, message) for every range and domain rule."""
    checks = []
    ordinal = 0
    for c, (lo, hi, lo_txt, hi_txt) in spec.numeric_ranges.items():
        msg = [F.lit(f"{c} value "), _text(c, False), F.lit(f" is out of range [{lo_txt}, {hi_txt}]")]
        checks.append((c, "range", ordinal, ~in_range(c, lo, hi), msg))
        ordinal += 1
    for c, vals in spec.categorical_values.items():
        msg = [F.lit(f"{c} value "), _text(c, True), F.lit(f" is not in valid values {py_list_text(vals)}")]
        checks.append((c, "domain", ordinal, ~in_domain(c, vals), msg))
        ordinal += 1
    return checks


def violations(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """V2–V4: one row per bad cell — ``id, column, value, rule, rule_ord, message``.

    V1 first: if any required column is missing, the result holds only the
    ``Missing column`` rows (value checks are skipped, as in the reference).
    """
    missing = missing_columns(df, spec)
    spark = df.sparkSession
    if missing:
        rows = [(None, c, None, "missing_column", -1, f"Missing column: '{c}'") for c in missing]
        return spark.createDataFrame(rows, VIOLATION_SCHEMA)
    items = []
    for c, rule, ordinal, bad, msg in violation_checks(spec):
        message = F.concat(F.lit("Row "), F.col(spec.id_col).cast("string"), F.lit(": "), *msg)
        # CASE WHEN builds the struct (and its message) only for a failing cell
        items.append(F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                                          F.lit(rule).alias("rule"), F.lit(ordinal).alias("rule_ord"),
                                          message.alias("message"))))
    cells = F.filter(F.array(*items), lambda x: x.isNotNull())
    return (df.select(F.col(spec.id_col).alias("id"), F.explode(cells).alias("x"))
            .select("id", "x.column", "x.value", "x.rule", "x.rule_ord", "x.message"))


def is_valid(viol: DataFrame) -> DataFrame:
    """V5: one row ``(is_valid, n_errors)``."""
    return viol.agg((F.count("*") == 0).alias("is_valid"), F.count("*").alias("n_errors"))


def preview(viol: DataFrame, n: int = 10) -> DataFrame:
    """V7: the first ``n`` errors in reference order (column-major, then row id)."""
    return viol.orderBy("rule_ord", "id").limit(n)


def counts_by_rule(viol: DataFrame) -> DataFrame:
    """V8: violations per (column, rule)."""
    return viol.groupBy("column", "rule").agg(F.count("*").alias("n"))


def record_errors(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """V6: per-record validation of scoring input (no target), as an ``errors`` array column.

    Order of messages: missing fields, then range checks, then domain checks. A NULL
    field is reported once as missing. A text-typed numeric field that does not parse
    gives "is not numeric". Works unchanged on streaming frames (row-local).
    """
    types = dict(df.dtypes)
    msgs = []
    absent = [c for c in spec.input_cols if c not in df.columns]
    for c in spec.input_cols:
        if c in absent:
            msgs.append(F.lit(f"Missing field: '{c}'"))
        else:
            msgs.append(F.when(F.col(c).isNull(), F.lit(f"Missing field: '{c}'")))
    for c, (lo, hi, lo_txt, hi_txt) in spec.numeric_ranges.items():
        if c in absent:
            continue
        if types[c] == "string":
            num = F.expr(f"try_cast(`{c}` AS DOUBLE)")
            msgs.append(F.when(F.col(c).isNotNull() & num.isNull(),
                               F.concat(F.lit(f"{c} value '"), F.col(c), F.lit("' is not numeric"))))
        else:
            num = F.col(c).cast("double")
        msgs.append(F.when(num.isNotNull() & ~num.between(lo, hi),
                           F.concat(F.lit(f"{c} value "), num.cast("string"),
                                    F.lit(f" is out of range [{lo_txt}, {hi_txt}]"))))
    for c, vals in spec.categorical_values.items():
        if c == spec.target or c in absent:
            continue
        msgs.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(vals),
                           F.concat(F.lit(f"{c} value '"), F.col(c),
                                    F.lit(f"' is not in valid values {py_list_text(vals)}"))))
    return df.withColumn("errors", F.filter(F.array(*msgs), lambda m: m.isNotNull()))


def split_valid(df: DataFrame, spec: SurveySpec = OBESITY):
    """V6 routing: (valid rows, rejected rows with their errors)."""
    checked = record_errors(df, spec)
    ok = F.size("errors") == 0
    return checked.where(ok).drop("errors"), checked.where(~ok)


def height_guard(height: Column) -> Column:
    """V9: fail the job if a height is ≤ 0 (NULL does not trigger) — evaluated inline."""
    return F.when(height <= 0, F.raise_error(F.lit("Height contains values <= 0; BMI cannot be computed"))) \
        .otherwise(height)


def feature_invariants(features: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """BMI error against Weight/Height² and the one-hot sum rule, in one aggregate.

    ``features`` must carry the unscaled ``BMI``, ``Weight``, ``Height`` and the one-hot columns.
    """
    ohe = [f"{spec.onehot_col}_{c}" for c in spec.onehot_categories]
    onehot_sum = sum((F.col(c) for c in ohe), F.lit(0))
    bmi_err = F.abs(F.col("BMI") - F.col("Weight") / (F.col("Height") * F.col("Height")))
    return features.agg(
        F.round(F.coalesce(F.max(bmi_err), F.lit(0.0)), 9).alias("max_bmi_error"),
        (F.coalesce(F.max(bmi_err), F.lit(0.0)) < 0.001).alias("bmi_ok"),
        F.count_if(onehot_sum != 1).alias("onehot_violations"),
        F.coalesce(F.bool_and(onehot_sum == 1), F.lit(True)).alias("onehot_ok"),
    )
