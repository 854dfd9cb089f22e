"""Distribution, demographic and descriptive summary tables.

Shapes shared by all of them: aggregate first (partial aggregation map-side, so a
class holding a third of the rows costs one partial row per task), then join the
≤7-row class dimension (broadcast, size fixed by the spec) to zero-fill and label.
Quantiles use the bounded exact algorithm in ``functions.stats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import class_dim
from ..functions.exprs import pct, rnd
from ..functions.stats import exact_quantiles_wide, moments, rounded_mean
from ..spec import OBESITY, SEVERE_CLASSES, SurveySpec


def class_distribution(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """A1: count and % per class; all classes present (zero-filled), canonical order."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(spec.target).alias("class_en")).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))  # one row
    return (class_dim(spark, spec).join(counts, "class_en", "left").crossJoin(total)
            .select("class_en", "class_pt", "severity",
                    F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("count"),
                    pct(F.coalesce(F.col("cnt"), F.lit(0)), "total", 2).alias("percentage"))
            .orderBy("severity"))


def age_by_class(df: DataFrame, spec: SurveySpec = OBESITY, col: str = "Age") -> DataFrame:
    """A2: mean and exact median of ``col`` per class present, rounded to 1."""
    spark = df.sparkSession
    keyed = df.where(F.col(spec.target).isNotNull())
    means = keyed.groupBy(F.col(spec.target).alias("class_en")).agg(F.avg(col).alias("mean"))
    med = (exact_quantiles_wide(keyed.select(F.col(spec.target).alias("class_en"), col), [col], [0.5],
                                by=["class_en"], names=["median"]).drop("column"))
    return (class_dim(spark, spec).join(means, "class_en").join(med, "class_en", "left")
            .select("class_pt", "severity", rnd("mean", 1).alias(f"mean_{col.lower()}"),
                    rnd("median", 1).alias(f"median_{col.lower()}"))
            .orderBy("severity"))


def gender_by_class(df: DataFrame, spec: SurveySpec = OBESITY, col: str = "Gender") -> DataFrame:
    """A3: % of each gender within a class (row total = all non-NULL genders), rounded to 1."""
    spark = df.sparkSession
    values = spec.categorical_values[col]
    keyed = df.where(F.col(spec.target).isNotNull() & F.col(col).isNotNull())
    agg = keyed.groupBy(F.col(spec.target).alias("class_en")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(col) == v).alias(f"_{v}") for v in values])
    return (class_dim(spark, spec).join(agg, "class_en")
            .select("class_pt", "severity", *[pct(f"_{v}", "_n", 1).alias(f"{v}_pct") for v in values])
            .orderBy("severity"))


def family_history_impact(df: DataFrame, spec: SurveySpec = OBESITY, col: str = "family_history") -> DataFrame:
    """A4: class % within ``col == yes`` and within ``col == no``; 7 rows zero-filled, round 2."""
    spark = df.sparkSession
    keyed = df.where(F.col(spec.target).isNotNull())
    agg = keyed.groupBy(F.col(spec.target).alias("class_en")).agg(
        F.count_if(F.col(col) == "yes").alias("_yes"), F.count_if(F.col(col) == "no").alias("_no"))
    totals = agg.agg(F.coalesce(F.sum("_yes"), F.lit(0)).alias("_ty"), F.coalesce(F.sum("_no"), F.lit(0)).alias("_tn"))
    return (class_dim(spark, spec).join(agg, "class_en", "left").crossJoin(totals)
            .select("class_pt", "severity",
                    pct(F.coalesce(F.col("_yes"), F.lit(0)), "_ty", 2).alias("with_history_pct"),
                    pct(F.coalesce(F.col("_no"), F.lit(0)), "_tn", 2).alias("without_history_pct"))
            .orderBy("severity"))


def describe(df: DataFrame, cols, places: int = 4, quartiles: bool = True) -> DataFrame:
    """Mean, median, sample std, min, max (+ quartiles) per column, long format."""
    cols = list(cols)
    m = moments(df, cols)
    probs, names = ([0.25, 0.5, 0.75], ["q1", "median", "q3"]) if quartiles else ([0.5], ["median"])
    q = exact_quantiles_wide(df, cols, probs, names=names)
    out = m.join(q, "column", "left")
    stats = ["mean", "median", "std", "min", "max"] + (["q1", "q2", "q3"] if quartiles else [])
    if quartiles:
        out = out.withColumn("q2", F.col("median"))
    return out.select("column", *[(rounded_mean if s == "mean" else rnd)(s, places).alias(s) for s in stats])


def frequency_table(df: DataFrame, cols, places: int = 2) -> DataFrame:
    """Count and % of every value per column (NULLs excluded), long format."""
    cols = list(cols)
    long = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("column").agg(F.sum("count").alias("_t"))  # ≤ one row per column
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "count", pct("count", "_t", places).alias("percentage"))


def class_imbalance(dist: DataFrame) -> DataFrame:
    """most/least frequent class over the A1 table; ties → first in canonical order."""
    return dist.agg(
        F.max_by("class_en", F.struct(F.col("count"), -F.col("severity"))).alias("most_frequent"),
        F.min_by("class_en", F.struct(F.col("count"), F.col("severity"))).alias("least_frequent"),
        F.max("count").alias("max_count"), F.min("count").alias("min_count"),
        F.round(F.try_divide(F.max("count").cast("double"), F.min("count").cast("double")), 2).alias("ratio"))


def flag_share(df: DataFrame, col: str = "high_calorie_sedentary") -> DataFrame:
    """Count and % of rows with the flag set."""
    return df.agg(F.coalesce(F.sum(col), F.lit(0)).cast("long").alias("n_flagged"),
                  F.count("*").alias("n_rows"),
                  pct(F.coalesce(F.sum(col), F.lit(0)), F.count("*"), 2).alias("pct_flagged"))


def crosstab_pct(df: DataFrame, col: str, levels, spec: SurveySpec = OBESITY, places: int = 1) -> DataFrame:
    """Class × ``col`` counts normalised per class row (%)."""
    spark = df.sparkSession
    agg = df.groupBy(F.col(spec.target).alias("class_en")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(col) == F.lit(v)).alias(f"_{v}") for v in levels])
    return (class_dim(spark, spec).join(agg, "class_en")
            .select("class_en", "severity", *[pct(f"_{v}", "_n", places).alias(f"pct_{v}") for v in levels]))


def mean_target_by_level(df: DataFrame, level_col: str, target_col: str = "severity") -> DataFrame:
    """Mean target ordinal per level present."""
    return df.where(F.col(level_col).isNotNull()).groupBy(level_col).agg(
        F.count("*").alias("n"), rnd(F.avg(target_col), 4).alias("mean_target"))


def top_pairs(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Most frequent (a, b) pairs — a top-k report (limit is the feature)."""
    return (df.groupBy(a, b).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first(a), F.asc_nulls_first(b)).limit(n))


def binary_distribution(df: DataFrame, cols) -> DataFrame:
    """Count and % of 0 and 1 for each encoded binary column (zero default)."""
    cols = list(cols)
    items = [F.struct(F.lit(c).alias("column"), F.lit(v).alias("code"),
                      F.count_if(F.col(c) == v).alias("count"), F.count("*").alias("_n"))
             for c in cols for v in (0, 1)]
    return (df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("x")).select("x.*")
            .select("column", "code", "count", pct("count", "_n", 2).alias("percentage")))


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """Exact non-NULL distinct count per column (one unpivot + one distinct)."""
    cols = list(cols)
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))
    return long.distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def severe_share(df: DataFrame, group_col: str, spec: SurveySpec = OBESITY, severe=SEVERE_CLASSES) -> DataFrame:
    """Share of severe classes within each value of ``group_col`` and the ratio of
    the two values' shares (first group over second, groups sorted descending)."""
    keyed = df.where(F.col(spec.target).isin(spec.class_order) & F.col(group_col).isNotNull())
    shares = keyed.groupBy(F.col(group_col).cast("string").alias("group")).agg(
        F.count("*").alias("n"), F.count_if(F.col(spec.target).isin(list(severe))).alias("n_severe"))
    return shares.select("group", "n", "n_severe", pct("n_severe", "n", 1).alias("severe_pct"))


def severe_ratio(shares: DataFrame, high: str, low: str) -> DataFrame:
    """A17 ratio: severe share of ``high`` over severe share of ``low`` (NULL when 0)."""
    p = shares.agg(F.max(F.when(F.col("group") == high, F.col("n_severe") / F.col("n"))).alias("h"),
                   F.max(F.when(F.col("group") == low, F.col("n_severe") / F.col("n"))).alias("l"))
    return p.select(F.round(F.try_divide("h", "l"), 1).alias("ratio"))


def mean_by_class(df: DataFrame, col: str, spec: SurveySpec = OBESITY, places: int = 1) -> DataFrame:
    """Mean of ``col`` per class present."""
    spark = df.sparkSession
    agg = df.groupBy(F.col(spec.target).alias("class_en")).agg(F.avg(col).alias("_m"))
    return class_dim(spark, spec).join(agg, "class_en").select(
        "class_en", "severity", rnd("_m", places).alias(f"mean_{col.lower()}"))


def kpis(filtered: DataFrame, dist: DataFrame, visible, spec: SurveySpec = OBESITY) -> DataFrame:
    """Rows of the filtered table; over the visible classes of the unfiltered distribution: how
    many have rows, the largest (ties → first in canonical order) and its share of their rows."""
    f = filtered.agg(F.count("*").alias("n_rows"))
    d = dist.where(F.col("class_en").isin(list(visible))).agg(
        F.count_if(F.col("count") > 0).alias("n_classes"), F.sum("count").alias("_all"), F.max("count").alias("_top"),
        F.max_by("class_pt", F.struct(F.col("count"), -F.col("severity"))).alias("_class"))
    d = d.select("n_classes", F.when(F.col("_all") > 0, F.col("_class")).otherwise(F.lit("—")).alias("top_class"),
                 pct(F.coalesce(F.col("_top"), F.lit(0)), "_all", 1).alias("top_share"))
    return f.crossJoin(d)  # two one-row frames


def renormalize(df: DataFrame, cols, places: int = 1) -> DataFrame:
    """Each column re-expressed as % of its own total (small result tables only)."""
    tot = df.agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    out = df.crossJoin(tot)
    return out.select(*[c for c in df.columns if c not in cols],
                      *[pct(c, f"_t_{c}", places).alias(c) for c in cols])


def wide_to_long(df: DataFrame, ids, values, var: str = "group", val: str = "pct") -> DataFrame:
    """Unpivot."""
    return df.unpivot(list(ids), list(values), var, val)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed; empty bins zero."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    counts = (df.where(F.col(col).isNotNull()).crossJoin(rng).groupBy(b.alias("bin"))
              .agg(F.count("*").alias("count")))
    grid = rng.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select(F.lit(col).alias("column"), "bin",
                    rnd(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins, 6).alias("bin_lo"),
                    rnd(F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins, 6).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def box_summary(df: DataFrame, col: str, spec: SurveySpec = OBESITY) -> DataFrame:
    """Per class Q1/median/Q3 (linear), whiskers at the furthest values within
    1.5·IQR of the box, and the number of outliers beyond them."""
    spark = df.sparkSession
    keyed = df.select(F.col(spec.target).alias("class_en"), col).where(F.col("class_en").isNotNull())
    q = exact_quantiles_wide(keyed, [col], [0.25, 0.5, 0.75], by=["class_en"],
                             names=["q1", "median", "q3"]).drop("column")
    q = q.withColumn("_iqr", F.col("q3") - F.col("q1"))
    lo_fence = F.col("q1") - 1.5 * F.col("_iqr")
    hi_fence = F.col("q3") + 1.5 * F.col("_iqr")
    v = F.col(col)
    inside = v.between(lo_fence, hi_fence)
    # q has ≤ one row per class (bounded by the spec) → broadcast
    agg = keyed.join(F.broadcast(q), "class_en").groupBy("class_en", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(v.isNotNull() & ~inside).alias("n_outliers"))
    return class_dim(spark, spec).join(agg, "class_en").select(
        "class_en", "severity", rnd("q1", 4).alias("q1"), rnd("median", 4).alias("median"),
        rnd("q3", 4).alias("q3"), rnd("whisker_lo", 4).alias("whisker_lo"),
        rnd("whisker_hi", 4).alias("whisker_hi"), "n_outliers")


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def head(df: DataFrame, order_col: str = "id", n: int = 5) -> DataFrame:
    """First rows in id order (a sample report; the limit is the feature)."""
    return df.orderBy(order_col).limit(n)
