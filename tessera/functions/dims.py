"""Small dimension tables built from the spec's fixed lookups.

Their size is bounded by the spec (7 classes, 16 features, ...), so joining them
with an explicit ``broadcast`` hint is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import spec as S
from ..spec import OBESITY, SurveySpec


def class_dim(spark: SparkSession, spec: SurveySpec = OBESITY) -> DataFrame:
    """``class_en, class_pt, severity`` in canonical order (7 rows)."""
    rows = [(c, spec.class_labels.get(c), i) for i, c in enumerate(spec.class_order)]
    schema = "class_en string, class_pt string, severity int"
    return F.broadcast(spark.createDataFrame(rows, schema))


def class_info_dim(spark: SparkSession, spec: SurveySpec = OBESITY) -> DataFrame:
    """Class dimension with display and clinical attributes."""
    rows = []
    for i, c in enumerate(spec.class_order):
        icon, color = S.CLASS_DISPLAY.get(c, S.DISPLAY_DEFAULT)
        desc, risks, recs = S.CLINICAL_INFO.get(c, (None, [], []))
        rows.append((c, spec.class_labels.get(c), i, icon, color, S.RISK_LEVELS.get(c, S.RISK_DEFAULT),
                     desc, risks, recs))
    schema = T.StructType([
        T.StructField("class_en", T.StringType()), T.StructField("class_pt", T.StringType()),
        T.StructField("severity", T.IntegerType()), T.StructField("icon", T.StringType()),
        T.StructField("color", T.StringType()), T.StructField("risk_level", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("risks", T.ArrayType(T.StringType())),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
    ])
    return F.broadcast(spark.createDataFrame(rows, schema))


def feature_text_dim(spark: SparkSession) -> DataFrame:
    rows = list(S.FEATURE_INTERPRETATIONS_PT.items())
    return F.broadcast(spark.createDataFrame(rows, "feature string, interpretation_pt string"))
