"""L1–L5 (+V11): deterministic stratified splits and folds.

Row order inside a class is ``md5("<id>:<seed>")`` then id, the same digest in
Spark and DuckDB. The position of a row inside its class comes from windows over
buckets of the hash, never over a whole class — a class may hold a third of the
rows. Per-class quotas follow the
largest-remainder rule on the class-count table (one row per class, bounded by the
label domain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import literal_map
from ..spec import OBESITY, RANDOM_STATE, SurveySpec


def hash_key(id_col: str = "id", seed: int = RANDOM_STATE) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def largest_remainder(counts: dict, total_part: int, order) -> dict:
    """Allocate ``total_part`` over classes proportionally to ``counts``: floors first, the
    rest one each to the largest remainders (ties → earlier in ``order``). Exact integers."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    alloc = {c: (k * total_part) // n for c, k in counts.items()}
    rest = total_part - sum(alloc.values())
    rank = sorted(counts, key=lambda c: (-((counts[c] * total_part) % n), order.index(c) if c in order else len(order), c))
    for c in rank[:rest]:
        alloc[c] += 1
    return alloc


def ceil_frac(n: int, num: int, den: int) -> int:
    """ceil(n · num / den) in integers (test-size rounding)."""
    return -((-n * num) // den)


def split_quotas(counts: dict, order, holdout=(3, 10), test_of_holdout=(1, 2)) -> dict:
    """Per-class (train, val, test) sizes of the two-stage split: hold out ``holdout`` of
    the rows (rounded up), then ``test_of_holdout`` of the hold-out is test (rounded up)."""
    n = sum(counts.values())
    n_hold = ceil_frac(n, *holdout)
    train = largest_remainder(counts, n - n_hold, order)
    hold = {c: counts[c] - train[c] for c in counts}
    h = sum(hold.values())
    n_test = ceil_frac(h, *test_of_holdout)
    val = largest_remainder(hold, h - n_test, order)
    return {c: (train[c], val[c], hold[c] - val[c]) for c in counts}


#: Rows of one class that are numbered in one window, about.
WINDOW_ROWS = 200_000


#: Rows from which on a split is cut at its classes' keys instead of numbering all rows.
MANY_ROWS = 16 * WINDOW_ROWS


def _keyed(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """Adds ``_h``, the row's hash, and ``_b``, its bucket: as many leading digits as ``n`` rows need."""
    digits = 1
    while 16 ** digits * WINDOW_ROWS < n:
        digits += 1
    return df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, digits))


def _before(sizes: DataFrame, label: str) -> DataFrame:
    """``_before``: rows in the earlier buckets ``_d`` of the class ``_c``."""
    return sizes.select(F.col(label).alias("_c"), F.col("_b").alias("_d"), "_n", F.coalesce(F.sum("_n").over(
        Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def class_positions(df: DataFrame, label: str, id_col: str = "id", seed: int = RANDOM_STATE) -> DataFrame:
    """Adds ``pos`` (0-based) = rank of the row inside its class by (hash, id).

    The hash's leading digits are buckets in hash order: rows are numbered inside (class, bucket),
    which is one shuffle and a sort of bounded groups, and the sizes of the class's buckets before it
    (a table of classes × buckets) are added. Nothing is sampled or stored.
    """
    keyed = _keyed(df, df.count(), id_col, seed)
    sizes = keyed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = _before(sizes, label).drop("_n")
    order = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    numbered = keyed.withColumn("_at", F.row_number().over(order) - 1)
    joined = numbered.join(before, F.col(label).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_d")))
    return joined.withColumn("pos", F.col("_before") + F.col("_at")).drop("_h", "_b", "_c", "_d", "_at", "_before")


def cut_keys(df: DataFrame, cuts: dict, n: int, label: str, id_col: str = "id", seed: int = RANDOM_STATE) -> dict | None:
    """For each (class, position) of ``cuts`` (class → positions) the (hash, id) of the row at that position: all rows
    before it have a lesser one. None if rows with the same key are on both sides of a position. ``df`` has ``n`` rows.

    Two scans: bucket sizes, then the buckets that hold a position are numbered. No other row moves.
    """
    at = {c: sorted(set(qs)) for c, qs in cuts.items() if qs}
    if not at:
        return {}
    keyed = _keyed(df.select(label, id_col), n, id_col, seed)
    sizes = _before(keyed.groupBy(label, "_b").agg(F.count("*").alias("_n")), label)
    positions = F.create_map(*[x for c, qs in at.items() for x in (F.lit(c), F.array(*[F.lit(q).cast("long") for q in qs]))])
    held = (sizes.withColumn("_q", F.explode(F.element_at(positions, F.col("_c"))))
            .where((F.col("_before") <= F.col("_q")) & (F.col("_before") + F.col("_n") > F.col("_q"))))
    held = [(r["_c"], r["_d"], r["_before"], r["_q"]) for r in held.collect()]  # one row a position
    inside = F.lit(False)
    for c, d in sorted({(c, d) for c, d, _, _ in held}, key=str):
        inside |= (F.col(label) == c) & F.col("_b").eqNullSafe(F.lit(d))
    order = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    numbered = keyed.where(inside).withColumn("_at", F.row_number().over(order) - 1).withColumn("_less", F.rank().over(order) - 1)
    here = F.lit(False)
    for c, d, before, q in held:
        here |= (F.col(label) == c) & F.col("_b").eqNullSafe(F.lit(d)) & (F.col("_at") == q - before)
    keys = {}
    for r in numbered.where(here).collect():
        if r["_less"] < r["_at"]:
            return None
        for c, d, before, q in held:
            if (r[label], r["_b"], r["_at"]) == (c, d, q - before):
                keys[c, q] = (r["_h"], r[id_col])
    return keys


def class_counts(df: DataFrame, label: str, order=None) -> dict:
    """Rows per known class (bounded by the label domain)."""
    known = df.where(F.col(label).isin(OBESITY.class_order if order is None else list(order)))
    return {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}


def stratified_split(df: DataFrame, spec: SurveySpec = OBESITY, label: str | None = None,
                     holdout=(3, 10), test_of_holdout=(1, 2), seed: int = RANDOM_STATE) -> DataFrame:
    """L1 (70/15/15 by default) / L2 (``test_of_holdout=(1, 1)`` gives a single 80/20-style
    split with ``holdout=(1, 5)``): adds ``split`` ∈ {train, val, test}."""
    label = label or spec.target
    df = df.where(F.col(label).isin(spec.class_order))  # spellings outside the domain have no quota
    counts = class_counts(df, label, spec.class_order)
    quotas = split_quotas(counts, spec.class_order, holdout, test_of_holdout)
    ends = {c: (q[0], q[0] + q[1]) for c, q in quotas.items()}
    if sum(counts.values()) >= MANY_ROWS:
        inner = {c: [q for q in e if 0 < q < counts[c]] for c, e in ends.items()}
        keys = cut_keys(df, inner, sum(counts.values()), label, spec.id_col, seed)
        if keys is not None:
            return _cut(df, ends, counts, keys, label, spec.id_col, seed)
    t, v = (literal_map({c: e[i] for c, e in ends.items()}) for i in (0, 1))
    pos = class_positions(df, label, spec.id_col, seed)
    split = (F.when(F.col("pos") < F.element_at(t, F.col(label)), "train")
             .when(F.col("pos") < F.element_at(v, F.col(label)), "val").otherwise("test"))
    return pos.withColumn("split", split).drop("pos")


def _cut(df: DataFrame, ends: dict, counts: dict, keys: dict, label: str, id_col: str, seed: int) -> DataFrame:
    """Adds ``split`` by comparing each row's key with the keys at its class's ends: no row moves.
    Rows without an id are counted and left out, as by ``class_positions``."""
    key = F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    kind = df.schema[id_col].dataType

    def under(i: int) -> Column:
        out = F.lit(False)
        for c, e in ends.items():
            if e[i] <= 0:
                continue
            h, row_id = keys.get((c, e[i]), (None, None))
            less = F.lit(True) if e[i] >= counts[c] else key < F.struct(F.lit(h).cast("string").alias("h"), F.lit(row_id).cast(kind).alias("id"))
            out |= (F.col(label) == c) & less
        return out

    return df.where(F.col(id_col).isNotNull()).withColumn("split", F.when(under(0), "train").when(under(1), "val").otherwise("test"))


def stratified_folds(df: DataFrame, k: int = 5, spec: SurveySpec = OBESITY, label: str | None = None,
                     seed: int = RANDOM_STATE) -> DataFrame:
    """L3: ``fold`` = position inside the class modulo k (balanced per class)."""
    label = label or spec.target
    return class_positions(df, label, spec.id_col, seed).withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos")


def split_distribution(split_df: DataFrame, spec: SurveySpec = OBESITY, places: int = 2) -> DataFrame:
    """L4: class % overall and per split, with the largest absolute deviation per class."""
    label = spec.target
    splits = ["train", "val", "test"]
    agg = split_df.groupBy(label).agg(F.count("*").alias("_all"),
                                      *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in splits])
    tot = agg.agg(F.sum("_all").alias("_t_all"), *[F.sum(f"_{s}").alias(f"_t_{s}") for s in splits])
    j = agg.crossJoin(tot)
    pct = {s: F.col(f"_{s}") / F.col(f"_t_{s}") * 100.0 for s in ["all", *splits]}
    dev = F.greatest(*[F.abs(pct[s] - pct["all"]) for s in splits])
    return j.select(F.col(label).alias("class_en"), *[F.round(pct[s], places).alias(f"pct_{s}") for s in ["all", *splits]],
                    F.round(dev, places).alias("max_abs_delta"))


def drift_check(dist: DataFrame, limit: float = 5.0) -> DataFrame:
    """Every class within ``limit`` percentage points in every split."""
    return dist.agg(F.max("max_abs_delta").alias("max_abs_delta"),
                    (F.max("max_abs_delta") <= limit).alias("within_limit"))
