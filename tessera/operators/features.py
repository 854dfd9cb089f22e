"""Survey feature engineering as a Spark ML Estimator/Model pair.

``SurveyFeatures.fit`` learns the scaler statistics in **one** aggregate job
(mean / population std for the standard-scaled columns, min / max for the
min-max columns). ``SurveyFeaturesModel.transform`` is a single projection of
native expressions ending in ``array_to_vector`` — no Python UDF, no
VectorAssembler pass. Scores are computed on the raw inputs, before encoding
and scaling, as in the reference.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag, lookup_case
from ..spec import EATING_SCORE_MAX, LIFESTYLE_CLIP, MTRANS_ACTIVITY, MTRANS_ALPHABETICAL, ALT_DEFAULTS, OBESITY, SurveySpec
from .validate import height_guard


# ----------------------------------------------------------------- row-level expressions
def bmi(spec: SurveySpec = OBESITY, guard: bool = True) -> Column:
    """E1 (+V9): Weight / Height²; a Height ≤ 0 fails the job."""
    h = height_guard(F.col("Height")) if guard else F.col("Height")
    return F.col("Weight") / (h * h)


def is_yes(c: str, positive: str = "yes") -> Column:
    """Case-insensitive equality, NULL → False (no trimming, as in the reference)."""
    return F.coalesce(F.lower(F.col(c)) == F.lit(positive), F.lit(False))


def ordinal(c: str, spec: SurveySpec = OBESITY) -> Column:
    """Case-sensitive frequency ordinal; unmapped → NULL."""
    return lookup_case(c, spec.frequency_ordinal).cast("double")


def eating_score(spec: SurveySpec = OBESITY) -> Column:
    """(2·FAVC + FCVC + NCP + CAEC) / 12."""
    raw = is_yes("FAVC").cast("double") * 2.0 + F.col("FCVC") + F.col("NCP") + ordinal("CAEC", spec)
    return raw / EATING_SCORE_MAX


def lifestyle_score(spec: SurveySpec = OBESITY) -> Column:
    """FAF − TUE − 0.5·CALC − 2·SMOKE, clipped to [−7, 3], mapped to [0, 1]."""
    lo, hi = LIFESTYLE_CLIP
    raw = F.col("FAF") - F.col("TUE") - ordinal("CALC", spec) * 0.5 - is_yes("SMOKE").cast("double") * 2.0
    clipped = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))  # NULL stays NULL
    return (clipped - lo) / (hi - lo)


def high_calorie_sedentary() -> Column:
    """FAVC = yes AND FAF < 1 → 1 else 0."""
    return flag(is_yes("FAVC") & (F.col("FAF") < 1.0))


def strict_ordinal(c: str, spec: SurveySpec = OBESITY) -> Column:
    """Ordinal code; an unmapped value fails the job (validate before encoding)."""
    code = lookup_case(c, spec.frequency_ordinal)
    return F.when(code.isNull(), F.raise_error(F.concat(F.lit(f"unmapped {c} value: "),
                                                       F.coalesce(F.col(c), F.lit("NULL"))))).otherwise(code)


def encoded_columns(spec: SurveySpec = OBESITY) -> dict:
    """E4–E7 and the raw scores: name → unscaled expression, in feature order."""
    out = {"BMI": bmi(spec)}
    for c in (*spec.minmax_cols, "Age", "Height", "Weight"):
        out.setdefault(c, F.col(c).cast("double"))
    out["eating_score"] = eating_score(spec)
    out["lifestyle_score"] = lifestyle_score(spec)
    out["high_calorie_sedentary"] = high_calorie_sedentary()
    for c, positive in spec.positive_values.items():
        out[c] = flag(is_yes(c, positive))
    for c in spec.ordinal_cols:
        out[c] = strict_ordinal(c, spec)
    for cat in spec.onehot_categories:
        out[f"{spec.onehot_col}_{cat}"] = flag(F.col(spec.onehot_col) == F.lit(cat))
    return out


def encodable_rows(spec: SurveySpec = OBESITY) -> Column:
    """Row-local predicate: the strict ordinals (E6) and the body-mass index (V9) are defined."""
    out = F.coalesce(F.col("Height") > 0, F.lit(True))
    for c in spec.ordinal_cols:
        out = out & F.col(c).isin(list(spec.frequency_ordinal)) & F.col(c).isNotNull()
    return out


def summary_encoding(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Scores, numeric columns and binary codes of every row; nothing in it needs a valid ordinal
    (an unknown one makes its score NULL)."""
    enc = {c: e for c, e in encoded_columns(spec).items() if c not in spec.ordinal_cols}
    keep = [c for c in (spec.id_col, spec.target) if c in df.columns]
    return df.select(*keep, *[e.alias(n) for n, e in enc.items()])


# ----------------------------------------------------------------- estimator / model
class _StatsParams(Params):
    standardCols = Param(Params._dummy(), "standardCols", "standard-scaled columns", TypeConverters.toListString)
    minmaxCols = Param(Params._dummy(), "minmaxCols", "min-max scaled columns", TypeConverters.toListString)


class SurveyFeatures(Estimator, HasOutputCol, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns scaler statistics on the fitting frame only (no leakage)."""

    @keyword_only
    def __init__(self, outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features", standardCols=list(OBESITY.standard_cols),
                         minmaxCols=list(OBESITY.minmax_cols))
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SurveyFeaturesModel":
        spec = OBESITY
        missing = sorted(set(spec.input_cols) - set(df.columns))
        if missing:
            raise ValueError(f"missing input columns: {missing}")
        enc = encoded_columns(spec)
        std_cols, mm_cols = self.getOrDefault("standardCols"), self.getOrDefault("minmaxCols")
        aggs = []
        for c in std_cols:
            aggs += [F.avg(enc[c]).alias(f"mean_{c}"), F.stddev_pop(enc[c]).alias(f"std_{c}")]
        for c in mm_cols:
            aggs += [F.min(enc[c]).alias(f"min_{c}"), F.max(enc[c]).alias(f"max_{c}")]
        row = df.agg(*aggs).first()  # one row of 18 numbers
        model = SurveyFeaturesModel(outputCol=self.getOutputCol())
        model._set(standardCols=std_cols, minmaxCols=mm_cols,
                   means=[row[f"mean_{c}"] for c in std_cols],
                   stds=[row[f"std_{c}"] for c in std_cols],
                   mins=[row[f"min_{c}"] for c in mm_cols],
                   maxs=[row[f"max_{c}"] for c in mm_cols])
        return model


class SurveyFeaturesModel(Model, HasOutputCol, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """One projection producing the 24 features (vector + optional columns)."""

    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviations", TypeConverters.toListFloat)
    mins = Param(Params._dummy(), "mins", "minimums", TypeConverters.toListFloat)
    maxs = Param(Params._dummy(), "maxs", "maximums", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def scaled_columns(self, spec: SurveySpec = OBESITY) -> dict:
        enc = encoded_columns(spec)
        for c, m, s in zip(self.getOrDefault("standardCols"), self.getOrDefault("means"), self.getOrDefault("stds")):
            enc[c] = (enc[c] - F.lit(m)) / F.lit(s if s else 1.0)
        for c, lo, hi in zip(self.getOrDefault("minmaxCols"), self.getOrDefault("mins"), self.getOrDefault("maxs")):
            rng = hi - lo
            enc[c] = (enc[c] - F.lit(lo)) / F.lit(rng if rng else 1.0)
        return {name: enc[name].cast("double") for name in spec.feature_names}

    def feature_frame(self, df: DataFrame, keep=("id",), spec: SurveySpec = OBESITY) -> DataFrame:
        """The 24 named feature columns (E11 as a table)."""
        cols = self.scaled_columns(spec)
        return df.select(*[c for c in keep if c in df.columns], *[e.alias(n) for n, e in cols.items()])

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.scaled_columns(OBESITY)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*cols.values())))

    def inverse(self, df: DataFrame) -> DataFrame:
        """Undo standard and min-max scaling of the named feature columns."""
        out = {}
        for c, m, s in zip(self.getOrDefault("standardCols"), self.getOrDefault("means"), self.getOrDefault("stds")):
            out[c] = F.col(c) * F.lit(s if s else 1.0) + F.lit(m)
        for c, lo, hi in zip(self.getOrDefault("minmaxCols"), self.getOrDefault("mins"), self.getOrDefault("maxs")):
            out[c] = F.col(c) * F.lit((hi - lo) if hi != lo else 1.0) + F.lit(lo)
        return df.withColumns(out)

    def scaler_table(self) -> list:
        """E8/E9 learned parameters as rows ``(column, scaler, center, scale)``."""
        rows = [(c, "standard", m, s) for c, m, s in zip(self.getOrDefault("standardCols"),
                                                         self.getOrDefault("means"), self.getOrDefault("stds"))]
        rows += [(c, "minmax", lo, hi - lo) for c, lo, hi in zip(self.getOrDefault("minmaxCols"),
                                                                self.getOrDefault("mins"), self.getOrDefault("maxs"))]
        return rows


def feature_names(spec: SurveySpec = OBESITY) -> list:
    """E12."""
    return spec.feature_names


# ----------------------------------------------------------------- other encodings
def correlation_encoding(df: DataFrame, spec: SurveySpec = OBESITY, extra=()) -> DataFrame:
    """Case-sensitive maps (unmapped → NULL), transport excluded, target ordinal,
    listwise drop (C10)."""
    cols = {c: F.col(c).cast("double") for c in spec.numeric_cols}
    cols.update({c: lookup_case(c, m).cast("double") for c, m in spec.binary_codes.items()})
    cols.update({c: ordinal(c, spec) for c in spec.ordinal_cols})
    cols.update({name: e for name, e in extra})
    target = lookup_case(spec.target, {c: i for i, c in enumerate(spec.class_order)}).cast("double")
    keep = [spec.id_col] if spec.id_col in df.columns else []
    out = df.select(*keep, *[e.alias(n) for n, e in cols.items()], target.alias("Obesity_encoded"))
    return out.na.drop("any", subset=[*cols, "Obesity_encoded"])


def exploratory_encoding(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """E16 (+ the K2 matrix input): binaries by lower-case equality, Gender by exact match,
    frequency ordinals, transport activity ordinal, target ordinal."""
    keep = [spec.id_col] if spec.id_col in df.columns else []
    return df.select(*keep, *[e.alias(n) for n, e in exploratory_columns(spec).items()])


def exploratory_columns(spec: SurveySpec = OBESITY) -> dict:
    """E16 as name → expression."""
    out = {c: F.col(c).cast("double") for c in spec.numeric_cols}
    out["Gender"] = flag(F.col("Gender") == "Male").cast("double")
    for c in ("family_history", "FAVC", "SMOKE", "SCC"):
        out[c] = flag(F.lower(F.col(c)) == "yes").cast("double")
    for c in spec.ordinal_cols:
        out[c] = ordinal(c, spec)
    out["MTRANS"] = lookup_case("MTRANS", MTRANS_ACTIVITY).cast("double")
    out["Obesity_Ordinal"] = lookup_case(spec.target, {c: i for i, c in enumerate(spec.class_order)}).cast("double")
    return out


ALT_FEATURES = ["Age", "Height", "Weight", "FCVC", "NCP", "CH2O", "FAF", "TUE",
                "Gender", "family_history", "FAVC", "SMOKE", "SCC", "CAEC", "CALC", "MTRANS"]


def alternative_encoding(df: DataFrame, spec: SurveySpec = OBESITY, scoring: bool = False) -> DataFrame:
    """The stand-alone model's 16 all-ordinal features (exact-match binaries). Unknown
    CAEC/CALC/MTRANS are NULL in training; in scoring they get the defaults 0, 0 and 3."""
    out = {c: F.col(c).cast("double") for c in spec.numeric_cols}
    out["Gender"] = flag(F.col("Gender") == "Male").cast("double")
    for c in ("family_history", "FAVC", "SMOKE", "SCC"):
        out[c] = flag(F.col(c) == "yes").cast("double")
    for c in spec.ordinal_cols:
        out[c] = lookup_case(c, spec.frequency_ordinal).cast("double")
    out["MTRANS"] = lookup_case("MTRANS", MTRANS_ALPHABETICAL).cast("double")
    if scoring:
        out |= {c: F.coalesce(out[c], F.lit(float(v))) for c, v in ALT_DEFAULTS.items()}
    keep = [c for c in (spec.id_col, spec.target) if c in df.columns]
    return df.select(*keep, *[out[c].alias(c) for c in ALT_FEATURES])


def telemetry(df: DataFrame) -> DataFrame:
    """mean/min/max of the scores and the flag count/% in one aggregate over unscaled scores."""
    aggs = []
    for s in ("BMI", "eating_score", "lifestyle_score"):
        aggs += [F.round(F.avg(s), 6).alias(f"{s}_mean"), F.round(F.min(s), 6).alias(f"{s}_min"),
                 F.round(F.max(s), 6).alias(f"{s}_max")]
    aggs += [F.coalesce(F.sum("high_calorie_sedentary"), F.lit(0)).cast("long").alias("n_flagged"),
             F.round(F.avg("high_calorie_sedentary") * 100.0, 2).alias("pct_flagged")]
    return df.agg(*aggs)
