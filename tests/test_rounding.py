"""P12 and P13 against Python's own rounding and formatting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.exprs import format_fixed, round_columns, round_exact, round_half_even
from tessera.operators.filters import percent1, signed3


def values(n, seed=1):
    rng = random.Random(seed)
    odd = [0.0, -0.0, 0.05, -0.05, 0.25, 0.35, 16.65, -16.65, 2.675, 1.005, 0.5, 1.5, 2.5, 1e-12, -1e-12, 5e-324, 123456789.05, 2.0 ** 40 + 0.5, 0.0005, 0.0015, 99.95, 9.9995]
    out = list(odd)
    while len(out) < n:
        k = rng.randrange(5)
        x = (rng.uniform(-1000, 1000), rng.randrange(-200_000, 200_000) / 20, rng.randrange(-200_000, 200_000) / 2000,
             rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9), rng.randrange(-9999, 9999) / 16)[k]
        out.append(x)
    return out


@pytest.mark.parametrize("places", [0, 1, 2, 3, 4, 6])
def test_equal_to_python(spark, places):
    x = values(100_000, places)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    rows = df.select("i", format_fixed("x", places).alias("f"), format_fixed("x", places, plus=True).alias("p"), round_exact("x", places).alias("r"),
                     round_half_even("x", places).alias("n")).toPandas().sort_values("i")
    assert rows["f"].tolist() == [f"{v:.{places}f}" for v in x]
    assert rows["p"].tolist() == [f"{v:+.{places}f}" for v in x]
    assert rows["r"].tolist() == [round(v, places) for v in x]
    assert rows["n"].tolist() == (np.rint(np.array(x) * 10.0 ** places) / 10.0 ** places).tolist()


def test_printed_forms(spark):
    df = spark.createDataFrame([(16.65,), (-0.0004,), (None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r[0] for r in df.select(percent1(F.col("x"))).collect()] == ["16.6%", "-0.0%", None, "nan%", "inf%", "-inf%"]
    assert [r[0] for r in df.select(signed3(F.col("x"))).collect()] == ["+16.650", "-0.000", None, "+nan", "+inf", "-inf"]


def test_columns_rounded_as_one_array(spark):
    x = [*values(5_000), None, math.nan, math.inf]
    df = spark.createDataFrame([(i, v, None if v is None else -v) for i, v in enumerate(x)], "i int, a double, b double")
    got = round_columns(df, ["b", "a"], 6, keep=("i",))
    assert got.columns == ["i", "b", "a"]
    want = df.select("i", F.round("b", 6).alias("b"), F.round("a", 6).alias("a"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
