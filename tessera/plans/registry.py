"""Query registry: name → (callable(spark, sf_dir) → DataFrame, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import OBESITY

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def survey_select(df: DataFrame, spec=OBESITY) -> DataFrame:
    return df.select(spec.id_col, *[F.round(c, 6).alias(c) if c in spec.numeric_ranges else F.col(c)
                                    for c in spec.columns])


def sql_survey_select(src: str, spec=OBESITY) -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in spec.numeric_ranges else c for c in spec.columns)
    return f"SELECT id, {cols} FROM {src}"


def all_queries() -> dict:
    # importing the catalog modules fills the registry
    from . import catalog, catalog_eval, catalog_features, catalog_model, catalog_more, catalog_stream  # noqa: F401
    return REGISTRY
