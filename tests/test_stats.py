"""Distributed order statistics against brute force (numpy/pandas) on small fixtures,
including ties, NULLs, groups and different partition counts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.stats import average_ranks, exact_quantiles, moments, rounded_mean, running_total
from tessera.operators.correlate import spearman_matrix, spearman_vs_target


def frame(spark, n=500, parts=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1.0, 2.0, 2.0, 3.5]) if i % 7 else None,
             rng.gauss(0, 1), float(rng.randint(0, 6))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, d double, x double, y double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_exact_quantiles_match_numpy(spark, parts):
    df = frame(spark, parts=parts)
    pdf = df.toPandas()
    q = {(r["g"], r["column"], r["p"]): r["value"]
         for r in exact_quantiles(df, ["d", "x"], [0.25, 0.5, 0.75], by=["g"]).collect()}
    for (g, col, p), v in q.items():
        vals = pdf.loc[pdf.g == g, col].dropna().to_numpy()
        assert v == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_exact_quantiles_even_count_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (4.0,), (None,), (float("nan"),), (10.0,)], "v double")
    med = exact_quantiles(df, ["v"], [0.5]).first()["value"]
    assert med == 3.5  # NaN and NULL are skipped (Spark alone would sort NaN last)
    const = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert exact_quantiles(const, ["v"], [0.5]).first()["value"] == 2.0


@pytest.mark.parametrize("between", [100_000, 0])
def test_exact_quantiles_of_many_values(spark, monkeypatch, between):
    """More values than a sketch keeps, ties in the middle; with histograms between the bounds as well."""
    monkeypatch.setattr(stats, "BETWEEN", between)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(60_000) < 0.3, np.round(rng.normal(0, 1, 60_000), 1), rng.lognormal(0, 3, 60_000))
    g = rng.integers(0, 3, 60_000)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x})).repartition(5)
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.01, 0.5, 0.75, 1.0], by=["g"]).collect()}
    assert len(got) == 15
    for (k, p), v in got.items():
        assert v == pytest.approx(np.quantile(x[g == k], p), abs=1e-12)


def test_exact_quantiles_recover_from_wrong_bounds(spark, monkeypatch):
    monkeypatch.setattr(stats, "SKETCH_ERROR", -0.2)  # bounds that exclude the rank
    x = np.random.default_rng(1).normal(0, 1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert exact_quantiles(df, ["x"], [0.3]).first()["value"] == pytest.approx(np.quantile(x, 0.3), abs=1e-12)


def test_quantiles_take_two_scans(spark, monkeypatch, tmp_path):
    reads = []
    real = stats.to_long
    monkeypatch.setattr(stats, "to_long", lambda *a, **k: reads.append(1) or real(*a, **k))
    written = []
    keep = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df: written.append(df) or keep(df))
    df = frame(spark, 2000)
    exact_quantiles(df, ["x"], [0.25, 0.5]).collect()
    # the sketch's table, and one round of counts: each of the two reads the rows once
    assert len(reads) == 1 and len(written) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_moments_dont_depend_on_partitions(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1e6, 3000), rng.integers(0, 999, 3000) / 10, [None, np.nan]])
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i int, x double")
    got = [moments(df.orderBy(F.xxhash64("i", F.lit(k))).repartition(n), ["x"]).first() for k, n in enumerate((1, 4, 16))]
    assert got[0] == got[1] == got[2]
    ok = np.array([v for v in x if v is not None and not np.isnan(float(v))], float)
    assert got[0]["n"] == len(ok) and got[0]["mean"] == pytest.approx(ok.mean()) and got[0]["std"] == pytest.approx(ok.std(ddof=1))
    assert (got[0]["min"], got[0]["max"]) == (ok.min(), ok.max())


def test_moments_by_group_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("b", 5.0, None)], "g string, x double, y double")
    got = {(r["g"], r["column"]): (r["n"], r["mean"], r["std"]) for r in moments(df, ["x", "y"], by=["g"]).collect()}
    assert got == {("a", "x"): (2, 2.0, pytest.approx(2 ** 0.5)), ("b", "x"): (1, 5.0, None), ("a", "y"): (1, 2.0, None)}
    empty = moments(df.where("g = 'z'"), ["x"]).first()
    assert (empty["column"], empty["n"], empty["mean"]) == ("x", None, None)


def test_a_mean_on_a_tie_rounds_up(spark):
    df = spark.createDataFrame([(38.07235,), (38.07234999999999,), (38.07235000000001,), (-1e-17,)], "m double")
    assert [r[0] for r in df.select(rounded_mean("m", 4)).collect()] == [38.0724, 38.0724, 38.0724, 0.0]


def test_running_total_matches_cumsum(spark):
    df = frame(spark, n=300)
    got = {r["id"]: r["before"] for r in running_total(df, ["g"], ["x", "id"], "y", "before", partitions=5).collect()}
    pdf = df.toPandas().sort_values(["g", "x", "id"])
    pdf["before"] = pdf.groupby("g")["y"].cumsum() - pdf["y"]
    for i, b in zip(pdf.id, pdf.before):
        assert got[i] == pytest.approx(b)


def test_average_ranks_match_pandas(spark):
    df = frame(spark)
    r = {(row["g"], row["y"]): row["rank"] for row in average_ranks(df, ["g"], "y").collect()}
    pdf = df.toPandas()
    pdf["rk"] = pdf.groupby("g")["y"].rank(method="average")
    for g, y, rk in zip(pdf.g, pdf.y, pdf.rk):
        assert r[(g, y)] == pytest.approx(rk)


@pytest.mark.parametrize("small", [10_000, 3, 0])
def test_spearman_with_broadcast_and_shuffled_ranks(spark, monkeypatch, small):
    """Pairwise deletion over columns with many and few values; all, some and no rank tables are broadcast."""
    from tessera.operators import correlate
    monkeypatch.setattr(correlate, "SMALL_COLUMN", small)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 400), "b": rng.integers(0, 3, 400).astype(float), "c": rng.normal(0, 1, 400), "e": 1.0})
    pdf["d"] = pdf.a + rng.normal(0, 1, 400)
    pdf.loc[rng.random(400) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(400) < 0.2, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["a"], r["b"]): r["rho"] for r in spearman_matrix(df, list(pdf.columns), places=10).collect()}
    want = pdf.corr("spearman")
    assert len(got) == 25
    for (x, y), rho in got.items():
        assert (rho is None and x != y and "e" in (x, y)) or rho == pytest.approx(want.loc[x, y] if x != y else 1.0, abs=1e-9)


def spearman_np(a, b):
    ra, rb = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
    return float(np.corrcoef(ra, rb)[0, 1])


def test_spearman_vs_target(spark):
    df = frame(spark).where(F.col("d").isNotNull())
    pdf = df.toPandas()
    got = {r["feature"]: r["correlation"] for r in spearman_vs_target(df, ["x", "d"], "y", places=10).collect()}
    assert got["x"] == pytest.approx(spearman_np(pdf.x, pdf.y), abs=1e-9)
    assert got["d"] == pytest.approx(spearman_np(pdf.d, pdf.y), abs=1e-9)


def test_spearman_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, y double")
    assert spearman_vs_target(df, ["c"], "y").first()["correlation"] is None


def test_spearman_matrix_pairwise(spark):
    df = frame(spark, n=200)
    pdf = df.toPandas()[["x", "y", "d"]]
    got = {(r["a"], r["b"]): r["rho"] for r in spearman_matrix(df, ["x", "y", "d"], places=10).collect()}
    ref = pdf.corr(method="spearman")
    for a in ["x", "y", "d"]:
        for b in ["x", "y", "d"]:
            assert got[(a, b)] == pytest.approx(ref.loc[a, b], abs=1e-9)


def test_spearman_of_large_columns_moves_sums_not_rows(spark, monkeypatch):
    """Pairs of two small, a small and a large, and two large columns, with NULLs, against pandas."""
    import numpy as np
    import pandas as pd
    from tessera.operators import correlate as K
    rng = np.random.default_rng(5)
    n = 400
    p = pd.DataFrame({"a": rng.integers(0, 3, n).astype(float), "b": rng.integers(0, 2, n).astype(float), "x": rng.normal(size=n).round(2), "y": rng.integers(0, 90, n).astype(float)})
    p["y"] += p["a"] * 20
    p.loc[rng.random(n) < 0.1, "x"] = None
    p.loc[rng.random(n) < 0.1, "a"] = None
    monkeypatch.setattr(K, "SMALL_COLUMN", 10)
    seen = []
    products = K._products
    monkeypatch.setattr(K, "_products", lambda df, cols, ranks, large, *rest: seen.append([cols[i] for i in large]) or products(df, cols, ranks, large, *rest))
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in p.itertuples(index=False)]
    m = {(r.a, r.b): r.rho for r in K.spearman_matrix(spark.createDataFrame(rows, "a double, b double, x double, y double"), list(p), 9).collect()}
    assert seen == [["x", "y"]]
    want = p.corr(method="spearman")
    assert all(abs(m[a, b] - want.loc[a, b]) < 1e-8 for a in p for b in p)
