"""Exact order statistics that stay distributed, with tasks of bounded size.

* ``exact_quantiles`` — linear-interpolated quantiles (numpy/pandas "linear",
  DuckDB ``quantile_cont``): a mergeable sketch bounds each rank, a second scan
  counts what lies below the bounds and between them. No task holds more than a
  bounded number of values per rank. Spark's own exact ``percentile`` keeps a map
  of every distinct value of a group in one buffer, which does not hold for a
  continuous column on a huge table.
* ``moments`` — mean, deviation, least and greatest value of columns by sums in whole
  numbers, which don't depend on the order of rows or on partitions.
* ``running_total`` — exclusive prefix sum within groups over a total order,
  computed from range partitions plus per-partition offsets (no window over a
  whole group in one task).
* ``average_ranks`` — average (tie-averaged) ranks per distinct value, built on
  ``running_total`` over the distinct-value table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_MAX_PASSES = 200
#: Rows of one range of a running total, about; there are as many ranges as that takes.
RANGE_ROWS = 250_000


def to_long(df: DataFrame, value_cols, by=(), var="column", val="v") -> DataFrame:
    """Wide → long ``(by..., var, val)`` with doubles; NULL/NaN values dropped."""
    by = list(by)
    cast = df.select(*by, *[F.col(c).cast("double").alias(c) for c in value_cols])
    long = cast.unpivot(by, list(value_cols), var, val)
    return long.where(F.col(val).isNotNull() & ~F.isnan(val))


#: Items that a quantile sketch keeps; a rank that it tells is off by more than ``SKETCH_ERROR`` of all rows in
#: one case of a hundred.
SKETCH_K = 4096
SKETCH_ERROR = 0.0014
#: Distinct values that are counted one by one between the two bounds of a rank, about.
BETWEEN = 100_000


def exact_quantiles(df: DataFrame, value_cols, probs, by=(), bins: int = 4096) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value_cols`` per ``by`` group.

    Returns ``(by..., column, p, n, value)``; groups with no non-null value are absent. One scan makes a
    sketch of each group and column, which bounds every rank from both sides; the next counts the rows
    below the bounds and the values between them. Where there are too many values between (more
    than ``BETWEEN``), or a bound was wrong, further scans narrow them by histograms of ``bins`` cells.
    """
    by = list(by)
    # each pass reads the wide frame again (pruned to these columns) and unpivots it on the way to
    # the counts: nothing is copied
    long = to_long(df, value_cols, by)
    keys = by + ["column"]
    stats = long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
                                    F.kll_sketch_agg_double("v", SKETCH_K).alias("sketch"))
    def bounds_of(sign: int) -> Column:
        ranks = F.array(*[F.lit(min(1.0, max(0.0, p + sign * 2 * SKETCH_ERROR))) for p in probs])
        return F.kll_sketch_get_quantile_double("sketch", ranks)

    # of few rows, all are between
    few = F.col("n") * SKETCH_ERROR < 2
    each = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), bounds_of(-1).alias("lo"), bounds_of(1).alias("hi"))
    targets = (stats.select(*keys, "n", "min", "max", F.explode(each).alias("x")).select(
        *keys, "n", "min", "max", "x.p", F.when(few, F.col("min")).otherwise(F.col("x.lo")).alias("lo"), F.when(few, F.col("max")).otherwise(F.col("x.hi")).alias("hi"))
        .withColumn("h", F.col("p") * (F.col("n") - 1)).withColumn("k0", F.floor("h").cast("long")).withColumn("k1", F.ceil("h").cast("long"))
        .withColumn("frac", F.col("h") - F.col("k0")))
    targets = materialize(targets.withColumn("k", F.explode(F.array_distinct(F.array("k0", "k1")))))

    state = targets.select(*keys, "k", "n", "min", "max", "lo", "hi").distinct().withColumn(
        "value", F.when(F.col("min") == F.col("max"), F.col("min")))
    first = True
    for _ in range(_MAX_PASSES):
        active = state.where(F.col("value").isNull())
        if active.isEmpty():
            break
        # bounds rise with the rank, so a value lies between those of the first whose upper one it doesn't pass
        bounds = active.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("hi", "lo"))).alias("b"), F.first("n").alias("n"))
        j = F.size(F.filter("b", lambda x: x["hi"] < F.col("v")))
        at = F.get("b", j)
        cells = long.join(bounds, keys).withColumn("j", j).withColumn("at", at)
        inside = F.coalesce(F.col("v") >= F.col("at.lo"), F.lit(False))
        few = (F.col("n") * (4 * SKETCH_ERROR) <= BETWEEN) if first else F.lit(False)
        width = F.col("at.hi") - F.col("at.lo")
        histogram = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("at.lo")) / width * bins), F.lit(bins - 1))).otherwise(0).cast("double")
        cell = F.when(inside, F.when(few, F.col("v")).otherwise(histogram))
        hist = cells.groupBy(*keys, "j", inside.alias("inside"), cell.alias("cell")).agg(
            F.count("*").alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
        w = Window.partitionBy(*keys).orderBy("j", "inside", "cell").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).where("inside")
        hit = (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c"))
        picked = active.select(*keys, "k").join(hist, keys).where(hit).select(*keys, "k", "bmin", "bmax")
        narrowed = active.drop("value").join(picked, [*keys, "k"], "left")
        # a rank that wasn't between its bounds starts again from all rows
        narrowed = narrowed.select(*keys, "k", "n", "min", "max", F.coalesce("bmin", "min").alias("lo"), F.coalesce("bmax", "max").alias("hi"),
                                   F.when(F.col("bmin") == F.col("bmax"), F.col("bmin")).alias("value"))
        state = materialize(state.where(F.col("value").isNotNull()).unionByName(narrowed))
        first = False
    else:  # pragma: no cover - needs pathological value spreads
        raise RuntimeError("exact_quantiles did not converge")

    vals = state.select(*keys, "k", "value")
    targets = targets.select(*keys, "p", "n", "k0", "k1", "frac").distinct()
    return (targets.join(vals.withColumnsRenamed({"k": "k0", "value": "v0"}), keys + ["k0"])
            .join(vals.withColumnsRenamed({"k": "k1", "value": "v1"}), keys + ["k1"])
            .select(*keys, "p", "n", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("value")))


def exact_quantiles_wide(df: DataFrame, value_cols, probs, by=(), names=None) -> DataFrame:
    """``(by..., column, q_<name>...)`` — one row per group and column."""
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    q = exact_quantiles(df, value_cols, probs, by)
    by = list(by)
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*by, "column").agg(*aggs)


def _whole_sum(c: Column) -> Column:
    """Sum of doubles below 2 ** 63 by their whole parts and fractions in units of 2 ** -50, both added exactly."""
    whole = F.floor(c)
    part = F.floor((c - whole.cast("double")) * float(1 << 50))
    add = lambda x: F.sum(x.cast("decimal(20,0)"))
    return ((add(whole) * F.lit(1 << 50).cast("decimal(16,0)") + add(part)).cast("decimal(38,0)")).cast("double") / float(1 << 50)


def moments(df: DataFrame, cols, by=()) -> DataFrame:
    """``(by..., column, n, mean, std, min, max)`` of columns over their non-null numbers, std with n - 1.

    The mean is the exact sum divided by n, and the deviation a second scan's sum of squared distances
    from it: the same rows give the same bits in any order and number of partitions.
    """
    by = list(by)
    long = to_long(df, cols, by)
    keys = by + ["column"]
    first = materialize(long.groupBy(*keys).agg(F.count("*").alias("n"), (_whole_sum(F.col("v")) / F.count("*")).alias("mean"),
                                                F.min("v").alias("min"), F.max("v").alias("max")))
    away = F.col("v") - F.col("mean")
    squares = long.join(first.select(*keys, "mean"), keys).groupBy(*keys).agg(_whole_sum(away * away).alias("s"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    out = first.join(squares, keys).withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("s") / (F.col("n") - 1)))).drop("s")
    return out if by else every.join(out, "column", "left")


def rounded_mean(c, places: int) -> Column:
    """A mean rounded half-up as the decimal that it is up to ten places: what lies on a tie stays there,
    whatever the last bits of the double are."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("decimal(28,10)"), places).cast("double")


def running_total(df: DataFrame, group_cols, order_cols, value_col, out_col,
                  partitions: int | None = None) -> DataFrame:
    """Adds ``out_col`` = sum of ``value_col`` over the rows of the same group that come
    strictly before this row in ``order_cols`` (which must be a total order per group).
    ``value_col``/``out_col`` may be lists to carry several sums through one pass.

    Plan: range-partition on (group, order) → each task sums its own slice (bounded by the
    range partition size); per-(partition, group) totals (≤ partitions + groups rows) give the
    offsets through a window on that small table; offsets are joined back.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    spark = df.sparkSession
    order_exprs = [c if not isinstance(c, str) else F.col(c) for c in order_cols]
    # range bounds come from a sampling job over the input: materialise the input first so the
    # sample and the shuffle read it once; the partition id must be the same for both branches
    # below (local sums and totals), so the partitioned frame is materialised too
    df = materialize(df)
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    rp = materialize(df.repartitionByRange(parts, *[F.col(g) for g in group_cols], *order_exprs)
                     .withColumn("_pid", F.spark_partition_id()))
    local_w = (Window.partitionBy("_pid", *group_cols).orderBy(*order_exprs)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = rp.withColumns({f"_local{i}": F.coalesce(F.sum(v).over(local_w), F.lit(0)) for i, v in enumerate(values)})
    totals = rp.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    off_w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group_cols, *[F.coalesce(F.sum(f"_t{i}").over(off_w), F.lit(0)).alias(f"_off{i}")
                                                  for i in range(len(values))])
    out = local.join(offsets, ["_pid", *group_cols])
    out = out.withColumns({o: F.col(f"_local{i}") + F.col(f"_off{i}") for i, o in enumerate(outs)})
    return out.drop("_pid", *[f"_local{i}" for i in range(len(values))], *[f"_off{i}" for i in range(len(values))])


def average_ranks(df: DataFrame, group_cols, value_col: str, weight_col: str | None = None,
                  out_col: str = "rank") -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank within each group.

    ``df`` may hold raw rows (weight 1 each) or pre-counted rows (``weight_col``).
    Returns ``(group..., value_col, cnt, before, rank)``.
    """
    group_cols = list(group_cols)
    w = F.col(weight_col) if weight_col else F.lit(1)
    distinct = df.groupBy(*group_cols, value_col).agg(F.sum(w).cast("long").alias("cnt"))
    ranked = running_total(distinct, group_cols, [value_col], "cnt", "before")
    return ranked.withColumn(out_col, F.col("before") + (F.col("cnt") + 1) / 2.0)

