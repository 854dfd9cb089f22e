"""Spearman correlation from distributed average ranks.

Spearman ρ is Pearson's r of tie-averaged ranks, and pairwise deletion ranks the rows where both columns
are there. One scan counts each column's values, for all rows and for those rows that each combination of
columns with NULLs leaves; running totals over these value tables give all ranks at once. Further scans
look ranks up and add the products of all pairs. Small value tables are broadcast (their size is checked).
The other columns' ranks are first added by the value of a large one, with map-side partial sums, and
the sums meet its rank table: a row never moves whole. Constant columns give NULL (K7: no divide-by-zero
error under ANSI).
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import feature_text_dim
from ..functions.exprs import nan_to_null
from ..functions.stats import running_total
from ..session import materialize

#: Values of a column up to which its ranks are broadcast (some 100 bytes each).
SMALL_COLUMN = 10_000


def _ranks(df: DataFrame, cols: list[str], masks: list[tuple[str, ...]]) -> DataFrame:
    """Per column (its place in ``cols``) and value: n_<m> and r_<m>, its number of rows and its average rank
    among the rows where the columns of mask m are there."""
    there = [F.lit(True) if not m else F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in m)) for m in masks]
    flags = F.array(*[t.cast("int") for t in there])
    long = df.select(flags.alias("f"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("col", "v")).where("v IS NOT NULL")
    n = [f"n_{m}" for m in range(len(masks))]
    values = long.groupBy("col", "v").agg(*[F.sum(F.get("f", F.lit(m))).cast("long").alias(c) for m, c in enumerate(n)])
    before = [f"before_{m}" for m in range(len(masks))]
    ranked = running_total(values, ["col"], ["v"], n, before)
    return materialize(ranked.select("col", "v", *n, *[(F.col(x) + (F.col(c) + 1) / 2.0).alias(f"r_{m}") for m, (c, x) in enumerate(zip(n, before))]))


def _products(df: DataFrame, cols: list[str], ranks: DataFrame, large: list[int], pairs: list[tuple[int, int, int]], mean) -> dict[int, float]:
    """Per place in ``pairs`` (columns i and j, mask m): the sum of the products of both ranks' distances
    from their means, over the rows that have both values.

    Pairs of small columns are one scan with broadcast tables. A large column takes one scan for all its
    small partners; a pair of large ones is summed by the value of one, then by that of the other.
    """
    one = lambda i: ranks.where(F.col("col") == i)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(cols)])

    def away(i: int, m: int) -> Column:
        return F.col(f"r_{i}_{m}") - F.lit(mean(i, m))

    def with_ranks(table: DataFrame, i: int, masks: set[int], hint=lambda t: t) -> DataFrame:
        found = one(i).select(F.col("v").alias(f"c_{i}"), *[F.col(f"r_{m}").alias(f"r_{i}_{m}") for m in sorted(masks)])
        return table.join(hint(found), f"c_{i}", "left")

    def masks(i: int, among: list[int]) -> set[int]:
        return {pairs[k][2] for k in among if i in pairs[k][:2]}

    def looked_up(among: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows with the ranks of the small columns of the pairs ``among``."""
        small = sorted({x for k in among for x in pairs[k][:2]} - set(large))
        out = rows.select(*keep, *[f"c_{i}" for i in small])
        for i in small:  # at most SMALL_COLUMN rows
            out = with_ranks(out, i, masks(i, among), F.broadcast)
        return out

    out: dict[int, float] = {}
    plain = [k for k, (i, j, _) in enumerate(pairs) if i not in large and j not in large]
    if plain:
        got = looked_up(plain).agg(*[F.sum(away(pairs[k][0], pairs[k][2]) * away(pairs[k][1], pairs[k][2])).alias(f"p_{k}") for k in plain]).first()
        out |= {k: got[f"p_{k}"] for k in plain}
    for x in large:
        of_x = [k for k, p in enumerate(pairs) if x in p[:2] and k not in out]
        partner = {k: pairs[k][0] if pairs[k][1] == x else pairs[k][1] for k in of_x}
        mixed = [k for k in of_x if partner[k] not in large]
        if mixed:
            sums = looked_up(mixed, (f"c_{x}",)).where(F.col(f"c_{x}").isNotNull()).groupBy(f"c_{x}").agg(
                *[F.sum(away(partner[k], pairs[k][2])).alias(f"s_{k}") for k in mixed])
            met = with_ranks(sums, x, masks(x, mixed))
            got = met.agg(*[F.sum(F.col(f"s_{k}") * away(x, pairs[k][2])).alias(f"p_{k}") for k in mixed]).first()
            out |= {k: got[f"p_{k}"] for k in mixed}
        for k in (k for k in of_x if partner[k] in large):
            y, m = partner[k], pairs[k][2]
            cells = rows.where(F.col(f"c_{x}").isNotNull() & F.col(f"c_{y}").isNotNull()).groupBy(f"c_{x}", f"c_{y}").agg(F.count(F.lit(1)).alias("n"))
            sums = with_ranks(cells, x, {m}).groupBy(f"c_{y}").agg(F.sum(away(x, m) * F.col("n")).alias("s"))
            out[k] = with_ranks(sums, y, {m}).agg(F.sum(F.col("s") * away(y, m))).first()[0]
    return out


def pair_spearman(df: DataFrame, pairs) -> DataFrame:
    """ρ(a, b) for each pair of columns over the rows where both are there: ``a, b, n, rho``. A pair
    without any complete row has no row; one with a constant side has a NULL ρ."""
    pairs = list(pairs)
    spark = df.sparkSession
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    # several scans follow; what the columns are derived from is worked out once
    df = materialize(df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in cols]))
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()
    mask_of = {p: tuple(c for c in cols if c in p and nulls[c]) for p in pairs}
    masks = list(dict.fromkeys([(), *mask_of.values()]))
    place = {c: i for i, c in enumerate(cols)}
    ranks = _ranks(df, cols, masks)
    # per column and mask: rows, and the spread of the ranks around their mean (columns x masks numbers)
    totals = ranks.groupBy("col").agg(F.count(F.lit(1)).alias("values"), *[F.sum(f"n_{m}").alias(f"n_{m}") for m in range(len(masks))]).collect()
    size = {r["col"]: r["values"] for r in totals}
    n = {(r["col"], m): r[f"n_{m}"] for r in totals for m in range(len(masks))}
    mean = lambda i, m: (n.get((i, m), 0) + 1) / 2.0
    middle = spark.createDataFrame([(i, [mean(i, m) for m in range(len(masks))]) for i in range(len(cols))], "col int, mean array<double>")
    away = [F.col(f"r_{m}") - F.get("mean", F.lit(m)) for m in range(len(masks))]
    spread = ranks.join(F.broadcast(middle), "col").groupBy("col").agg(*[F.sum(F.col(f"n_{m}") * a * a).alias(f"s_{m}") for m, a in enumerate(away)])
    var = {(r["col"], m): r[f"s_{m}"] for r in spread.collect() for m in range(len(masks))}
    places = [(place[a], place[b], masks.index(mask_of[a, b])) for a, b in pairs]
    got = _products(df, cols, ranks, [i for i in range(len(cols)) if size.get(i, 0) > SMALL_COLUMN], places, mean)
    out = []
    for k, (a, b) in enumerate(pairs):
        i, j, m = place[a], place[b], masks.index(mask_of[a, b])
        rows = n.get((i, m), 0)
        if rows and n.get((j, m), 0):
            vx, vy = var[i, m], var[j, m]
            out.append((a, b, rows, got[k] / math.sqrt(vx * vy) if vx > 0 and vy > 0 else None))
    return spark.createDataFrame(out, "a string, b string, n bigint, rho double")


def spearman_vs_target(df: DataFrame, features, target: str, places: int = 4) -> DataFrame:
    """K1/K3/K4: ρ(feature, target) for each feature, with pairwise deletion (callers that delete
    listwise have no NULLs left). Returns ``feature, correlation, abs_correlation, n``."""
    r = pair_spearman(df, [(f, target) for f in features])
    return r.select(F.col("a").alias("feature"), F.round("rho", places).alias("correlation"),
                    F.round(F.abs("rho"), places).alias("abs_correlation"), "n")


def spearman_matrix(df: DataFrame, cols, places: int = 4) -> DataFrame:
    """K2: full Spearman matrix with pairwise deletion, long format ``(a, b, rho)``."""
    cols = list(cols)
    spark = df.sparkSession
    every = spark.createDataFrame(list(combinations(cols, 2)), "a string, b string")
    out = every.join(pair_spearman(df, combinations(cols, 2)), ["a", "b"], "left").select("a", "b", "rho")
    sym = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, rho double")
    return sym.unionByName(diag).select("a", "b", F.round("rho", places).alias("rho"))


def top_risk_factors(corr: DataFrame, n: int = 5) -> DataFrame:
    """K6: top-n features by |ρ| (ties → feature name), direction and interpretation text."""
    spark = corr.sparkSession
    direction = F.when(F.col("correlation") >= 0, F.lit("positivo")).otherwise(F.lit("negativo"))
    top = corr.orderBy(F.desc("abs_correlation"), F.asc("feature")).limit(n)
    fallback = F.format_string("Feature '%s' apresenta correlação %s com obesidade", F.col("feature"), direction)
    return (top.join(feature_text_dim(spark), "feature", "left")
            .select("feature", "correlation", direction.alias("direction"),
                    F.coalesce(F.col("interpretation_pt"), fallback).alias("interpretation_pt")))
