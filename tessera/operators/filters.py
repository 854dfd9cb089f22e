"""Projections, spec-driven filters, label translation and display formatting.

All are single-pass row expressions (filters reach the Parquet scan when the
columns come straight from it); label translation uses literal maps or the
broadcast ≤7-row class dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import format_fixed, lookup_case
from ..spec import OBESITY, SurveySpec


def filter_spec(df: DataFrame, filters: dict, spec: SurveySpec = OBESITY) -> DataFrame:
    """Gender list, inclusive age bounds, class list. A list that is empty or has no
    valid member means "no filter"; invalid members are ignored; NULL ages fail the bounds."""
    out = df
    genders = [g for g in (filters.get("gender") or []) if g in spec.categorical_values["Gender"]]
    if genders:
        out = out.where(F.col("Gender").isin(genders))
    if filters.get("age_min") is not None:
        out = out.where(F.col("Age") >= float(filters["age_min"]))
    if filters.get("age_max") is not None:
        out = out.where(F.col("Age") <= float(filters["age_max"]))
    classes = [c for c in (filters.get("obesity_classes") or []) if c in spec.class_order]
    if classes:
        out = out.where(F.col(spec.target).isin(classes))
    return out


def visible_classes(filters: dict, spec: SurveySpec = OBESITY) -> list:
    classes = [c for c in (filters.get("obesity_classes") or []) if c in spec.class_order]
    return classes or spec.class_order


def get_filtered_data(df: DataFrame, filters: dict, spec: SurveySpec = OBESITY) -> DataFrame:
    """P6 + P3: filtered rows with the target replaced by its Portuguese label (unmapped → NULL)."""
    return filter_spec(df, filters, spec).withColumn(spec.target, lookup_case(spec.target, spec.class_labels))


def translate_back(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """P5: inverse lookup (e.g. Portuguese label → dataset value)."""
    return df.withColumn(col, lookup_case(col, {v: k for k, v in mapping.items()}))


def sign_label(x: Column) -> Column:
    """≥ 0 → positive."""
    return F.when(x >= 0, "positive").when(x.isNotNull(), "negative")


def thousands(n: Column, sep: str = ".") -> Column:
    """Integer with a thousands separator (``1.234.567``)."""
    return F.translate(F.format_number(n.cast("long"), 0), ",", sep)


def signed3(x: Column) -> Column:
    """``%+.3f``."""
    return format_fixed(x, 3, plus=True)


def percent1(x: Column) -> Column:
    """``%.1f%``."""
    return F.concat(format_fixed(x, 1), F.lit("%"))


def underscores_to_spaces(c: Column) -> Column:
    """P14."""
    return F.translate(c, "_", " ")
