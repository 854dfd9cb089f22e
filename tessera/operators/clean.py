"""Duplicate removal, imputation, case standardisation and the cleaning report.

Every step is a DataFrame → DataFrame function. Statistics (medians, modes) are
computed in one job each, collected as at most one scalar per column (bounded by
the spec) and folded into the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import literal_map
from ..functions.stats import RANGE_ROWS, exact_quantiles
from ..session import materialize
from ..spec import OBESITY, SurveySpec


#: Hashes of repeated rows up to which they are broadcast (some 200 MB); with more, the rows are dealt out by their hash.
BROADCAST_HASHES = 4_000_000
#: Rows of one hash from which they are not dealt out by it.
HOT_COPIES = 10_000


def remove_duplicates(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Full-row distinct over the survey columns, keeping the smallest id.

    Rows are counted by a 64-bit hash first, with map-side partial sums, so a hot group of copies
    collapses before the shuffle. A row whose hash is there once has no copy and stays where it is; only
    the others are grouped by their values. Grouping all rows by value would sort them whole in every
    task, because the least text id of a group can't be kept in a hash table.

    With many different rows that are there more than once, all rows move one time, to the task of their
    hash, and are grouped there; only the copies of hot rows are combined before they move.
    """
    cols = [c for c in spec.columns if c in df.columns]
    if spec.id_col not in df.columns:
        return df.dropDuplicates(cols)
    # -0.0 and 0.0 are one value, as in a grouping
    values = [(F.col(c) + F.lit(0.0)).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in cols]
    rows = df.select(spec.id_col, *values).withColumn("_hash", F.xxhash64(*cols))
    repeated = materialize(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    least = F.min(spec.id_col).alias(spec.id_col)
    if repeated.count() <= BROADCAST_HASHES:
        together = F.broadcast(repeated.select("_hash"))
        others = rows.join(together, "_hash", "left_anti")
    else:
        together = F.broadcast(repeated.where(F.col("_n") >= HOT_COPIES).select("_hash"))  # at most rows / HOT_COPIES
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
        dealt = rows.join(together, "_hash", "left_anti").repartition(parts, "_hash")
        others = dealt.groupBy("_hash", *cols).agg(least)
    more = rows.join(together, "_hash", "left_semi").groupBy(*cols).agg(least)
    return others.select(spec.id_col, *cols).unionByName(more.select(spec.id_col, *cols))


def null_counts(df: DataFrame, cols) -> DataFrame:
    """One-row frame with ``count_if(c IS NULL)`` for every column (single scan)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def numeric_medians(df: DataFrame, spec: SurveySpec = OBESITY, only_missing: bool = True) -> dict:
    """C2 statistics: exact median per numeric column (only columns that have NULLs)."""
    cols = [c for c in spec.numeric_cols if c in df.columns]
    if only_missing:
        nulls = null_counts(df, cols).first().asDict()
        cols = [c for c in cols if nulls[c] > 0]
    if not cols:
        return {}
    q = exact_quantiles(df, cols, [0.5])
    found = {r["column"]: r["value"] for r in q.collect()}  # ≤ one row per numeric column
    return {c: found.get(c) for c in cols}


def impute_numeric(df: DataFrame, spec: SurveySpec = OBESITY, medians: dict | None = None) -> DataFrame:
    """NULL numeric cells ← exact median of the column (after dedupe)."""
    medians = numeric_medians(df, spec) if medians is None else medians
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in medians.items() if v is not None}
    return df.withColumns(fills) if fills else df


def category_modes(df: DataFrame, spec: SurveySpec = OBESITY, only_missing: bool = True) -> dict:
    """C3 statistics: most frequent raw spelling per categorical column; ties → smallest string.

    One job: unpivot → count per (column, value) with partial aggregation →
    ``min_by(value, (-count, value))`` per column (also partially aggregated).
    """
    cols = [c for c in spec.categorical_cols if c in df.columns]
    if only_missing:
        nulls = null_counts(df, cols).first().asDict()
        cols = [c for c in cols if nulls[c] > 0]
    if not cols:
        return {}
    long = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("cnt"))
    modes = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("val"))).alias("mode"))
    found = {r["column"]: r["mode"] for r in modes.collect()}  # ≤ one row per categorical column
    return {c: found.get(c) for c in cols}


def impute_categorical(df: DataFrame, spec: SurveySpec = OBESITY, modes: dict | None = None) -> DataFrame:
    """NULL categorical cells ← mode; an all-NULL column has no mode and stays as is."""
    modes = category_modes(df, spec) if modes is None else modes
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in modes.items() if v is not None}
    return df.withColumns(fills) if fills else df


#: What ``strip_ws`` takes off, for a trim: no pattern is searched in each cell.
WHITESPACE = " \t\n\x0b\f\r"


def canonical_case(c: str, values) -> F.Column:
    """strip + lower lookup onto the canonical spelling; unknown spellings kept unchanged. A cell that
    is spelt so already is only compared."""
    mapping = {v.strip().lower(): v for v in values}
    canonical = [v for v in values if mapping[v.strip().lower()] == v]
    found = F.element_at(literal_map(mapping), F.lower(F.trim(F.col(c), F.lit(WHITESPACE))))
    return F.when(F.col(c).isin(canonical), F.col(c)).otherwise(F.coalesce(found, F.col(c)))


def standardize_case(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """C4: case/whitespace variants of a category become the canonical value."""
    return df.withColumns({c: canonical_case(c, vals) for c, vals in spec.categorical_values.items()
                           if c in df.columns})


def clean(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Dedupe → numeric median → categorical mode → case standardisation.

    The deduplicated frame feeds two statistics jobs and the final plan, so it is
    materialised once (checkpoint in the shared folder on a cluster, cache locally).
    """
    return clean_deduplicated(materialize(remove_duplicates(df, spec)), spec)


def clean_deduplicated(deduped: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """C2→C3→C4 on an already deduplicated (and materialised) frame."""
    medians = numeric_medians(deduped, spec)
    step = impute_numeric(deduped, spec, medians)
    modes = category_modes(step, spec)
    step = impute_categorical(step, spec, modes)
    return standardize_case(step, spec)


def cleaning_report(original: DataFrame, cleaned: DataFrame, deduped: DataFrame | None = None,
                    spec: SurveySpec = OBESITY) -> DataFrame:
    """``(item, value)`` rows — duplicates removed, shapes, and NULLs per column of the
    *original* (only columns with NULLs, as ``missing:<column>``)."""
    cols = [c for c in spec.columns if c in original.columns]
    stats = original.agg(F.count("*").alias("rows_before"),
                         *[F.count_if(F.col(c).isNull()).alias(f"missing:{c}") for c in cols])
    deduped = remove_duplicates(original.select(*cols), spec) if deduped is None else deduped
    distinct = deduped.agg(F.count("*").alias("distinct_rows"))
    after = cleaned.agg(F.count("*").alias("rows_after"))
    wide = stats.crossJoin(distinct).crossJoin(after)  # three one-row frames
    items = [F.struct(F.lit("duplicates_removed").alias("item"),
                      (F.col("rows_before") - F.col("distinct_rows")).alias("value")),
             F.struct(F.lit("rows_before").alias("item"), F.col("rows_before").alias("value")),
             F.struct(F.lit("cols_before").alias("item"), F.lit(len(original.columns)).cast("long").alias("value")),
             F.struct(F.lit("rows_after").alias("item"), F.col("rows_after").alias("value")),
             F.struct(F.lit("cols_after").alias("item"), F.lit(len(cleaned.columns)).cast("long").alias("value"))]
    items += [F.struct(F.lit(f"missing:{c}").alias("item"), F.col(f"`missing:{c}`").alias("value")) for c in cols]
    return (wide.select(F.explode(F.array(*items)).alias("x")).select("x.item", "x.value")
            .where(~F.col("item").startswith("missing:") | (F.col("value") > 0)))


def normalized_counts(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Per categorical column, how many values case standardisation changes (one scan)."""
    cols = [c for c in spec.categorical_cols if c in df.columns]
    agg = df.agg(*[F.sum(F.when(canonical_case(c, spec.categorical_values[c]).eqNullSafe(F.col(c)), 0)
                         .otherwise(1)).cast("long").alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "changed")


def remaining_nulls(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Total NULL cells over the survey columns (``isnull().sum().sum()``)."""
    cols = [c for c in spec.columns if c in df.columns]
    total = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    return df.agg(total.cast("long").alias("remaining_nulls"))


def known_classes(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Keep rows whose target is one of the declared classes (NULLs dropped too)."""
    return df.where(F.col(spec.target).isin(spec.class_order))

