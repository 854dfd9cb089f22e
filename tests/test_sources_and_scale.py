"""CSV by header name, row ids at large keys, split positions, AUC at large counts, stream scoring."""

import math

import pytest
from conftest import make_survey
from pyspark.sql import functions as F

from tessera.operators import correlate as K
from tessera.operators import evaluate as N
from tessera.operators import split as L
from tessera.operators import validate as V
from tessera.sources.survey import read_survey_csv, survey_raw
from tessera.spec import OBESITY as S


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header)] + [",".join("" if r.get(c) is None else str(r[c]) for c in header) for r in rows]) + "\n")
    return str(path)


def test_csv_columns_are_taken_by_name(spark, survey_rows, tmp_path):
    header = ["Weight", "id", "extra", *[c for c in S.columns if c not in ("Weight",)][::-1]]
    got = {r["id"]: r for r in read_survey_csv(spark, write_csv(tmp_path / "a.csv", header, survey_rows)).collect()}
    assert set(got["1"].asDict()) == {"id", *S.columns}
    assert (got["1"]["Age"], got["1"]["Weight"], got["1"]["MTRANS"]) == (25.0, 70.0, "Public_Transportation")


def test_csv_with_a_missing_column_is_reported(spark, survey_rows, tmp_path):
    header = ["id", *[c for c in S.columns if c != "Age"]]
    df = read_survey_csv(spark, write_csv(tmp_path / "b.csv", header, survey_rows))
    assert V.missing_columns(df) == ["Age"]
    assert [r["message"] for r in V.violations(df).collect()] == ["Missing column: Age"] or "Age" in V.violations(df).first()["message"]


def test_csv_without_ids_gets_them(spark, survey_rows, tmp_path):
    rows = [*survey_rows, survey_rows[0], survey_rows[0]]
    path = write_csv(tmp_path / "c.csv", list(S.columns), rows)
    ids = [r["id"] for r in read_survey_csv(spark, path).collect()]
    assert len(ids) == 5 == len(set(ids))
    again = [r["id"] for r in read_survey_csv(spark, write_csv(tmp_path / "d.csv", list(S.columns)[::-1], rows[::-1])).collect()]
    assert sorted(ids) == sorted(again)
    assert "id" not in read_survey_csv(spark, path, with_id=False).columns


def test_row_ids_at_large_keys(spark, tmp_path):
    keys = [(15_000_000 + i, i % 7 + 1, 100_000 + 1000 * i, 10_000 + i, i % 50 + 1) for i in range(200)]
    keys += [(9_000_000_000_000, 1, 900_000_000, 90_000_000, 50), (15_000_000, 1, 1, 1, 1), (150_000_001, 1, 1, 1, 1)]
    cols = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double"
    spark.createDataFrame([(*k[:4], float(k[4])) for k in keys], cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = survey_raw(spark, str(tmp_path))
    assert raw.select("id").distinct().count() == len(keys)
    assert raw.count() >= len(keys)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_split_does_not_depend_on_partitions(spark, parts):
    rows = [(str(i), S.class_order[i % 3 if i % 2 else 0]) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, Obesity string")
    want = {r["id"]: r["split"] for r in L.stratified_split(df.coalesce(1)).collect()}
    got = {r["id"]: r["split"] for r in L.stratified_split(df.repartition(parts)).collect()}
    assert got == want and len(got) == 900


def _one_side(monkeypatch, spark, rows, types, **k):
    """The split of many rows against that by positions, and whether rows moved to be numbered."""
    df = spark.createDataFrame(rows, types)
    want = sorted(map(tuple, L.stratified_split(df, **k).select("id", "Obesity", "split").collect()), key=str)
    calls, real = [], L.class_positions
    with monkeypatch.context() as m:
        m.setattr(L, "MANY_ROWS", 1)
        m.setattr(L, "WINDOW_ROWS", 7)
        m.setattr(L, "class_positions", lambda *a, **b: calls.append(1) or real(*a, **b))
        got = sorted(map(tuple, L.stratified_split(df.repartition(5), **k).select("id", "Obesity", "split").collect()), key=str)
    return got, want, bool(calls)


def test_a_split_of_many_rows_moves_none(spark, monkeypatch):
    rows = [(str(i), S.class_order[i % 3 if i % 2 else 0]) for i in range(900)] + [("one", S.class_order[5]), ("x", "Strange"), ("y", None)]
    for k in ({}, {"holdout": (1, 5), "test_of_holdout": (1, 1)}):
        got, want, moved = _one_side(monkeypatch, spark, rows, "id string, Obesity string", **k)
        assert got == want and len(got) == 901 and not moved
    numbers = [(i, c) for i, (_, c) in enumerate(rows)] + [(None, S.class_order[0])]
    got, want, moved = _one_side(monkeypatch, spark, numbers, "id int, Obesity string")
    assert got == want and not moved


def test_rows_of_one_id_at_a_cut_are_numbered(spark, monkeypatch):
    got, want, moved = _one_side(monkeypatch, spark, [("same", S.class_order[i % 2]) for i in range(40)], "id string, Obesity string")
    assert got == want and len(got) == 40 and moved
    got, want, moved = _one_side(monkeypatch, spark, [(None, S.class_order[0])] * 9 + [(str(i), S.class_order[0]) for i in range(9)], "id string, Obesity string")
    assert got == want and len(got) == 9


def test_positions_over_many_buckets(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(L, "WINDOW_ROWS", 5)
    rows = [(str(i), "ab"[i % 3 == 0]) for i in range(600)]
    got = {r["id"]: r["pos"] for r in L.class_positions(spark.createDataFrame(rows, "id string, c string"), "c").collect()}
    for c in "ab":
        ids = sorted((i for i, x in rows if x == c), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_unknown_classes_have_no_split(spark):
    rows = [(str(i), S.class_order[i % 2]) for i in range(40)] + [("x", "Strange"), ("y", None)]
    assert L.stratified_split(spark.createDataFrame(rows, "id string, Obesity string")).count() == 40


def scored_frame(spark, rows):
    cols = ", ".join(f"p_{c} double" for c in S.class_order)
    a = S.class_order
    return spark.createDataFrame([(x, *[p if c == a[0] else 0.0 for c in a]) for x, p in rows], f"actual string, {cols}")


def test_auc_with_counts_whose_product_outgrows_a_bigint(spark, monkeypatch):
    a, b = S.class_order[:2]
    table = spark.createDataFrame([(a, 0.1, 0, 4_000_000_000), (a, 0.5, 1_000_000_000, 2_000_000_000), (a, 0.9, 4_000_000_000, 0)],
                                  "class string, score double, pos bigint, neg bigint")
    monkeypatch.setattr(N, "_score_table", lambda scored, classes: table)
    (r,) = N.auc(None).collect()
    pairs = 5e9 * 6e9
    assert math.isclose(r["auc"], (1e9 * 4e9 + 0.5 * 1e9 * 2e9 + 4e9 * 6e9) / pairs, abs_tol=1e-6)


def test_roc_starts_at_the_origin_and_drops_straight_points(spark):
    a, b = S.class_order[:2]
    # descending scores: + + - -, so the corner is the only bend
    got = N.roc_points(scored_frame(spark, [(a, 0.9), (a, 0.8), (b, 0.3), (b, 0.2)])).where(F.col("class") == a).collect()
    points = sorted((r["tpr"], r["fpr"], r["score"] is None) for r in got)
    assert points == [(0.0, 0.0, True), (0.5, 0.0, False), (1.0, 0.0, False), (1.0, 1.0, False)]


def test_spearman_deletes_nulls_pairwise(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 200).astype(float), "z": rng.normal(size=200), "y": rng.integers(0, 4, 200).astype(float)})
    pdf.loc[::7, "x"] = None
    pdf.loc[::11, "y"] = None
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)], "x double, z double, y double")
    got = {r["feature"]: (r["correlation"], r["n"]) for r in K.spearman_vs_target(df, ["x", "z"], "y", places=6).collect()}
    for c in "xz":
        pair = pdf[[c, "y"]].dropna().rank()
        assert abs(got[c][0] - pair.corr().iloc[0, 1]) < 1e-6 and got[c][1] == len(pair)


def test_scoring_stream_and_its_retry(spark, survey_rows, tmp_path):
    from tessera.operators import model as M
    from tessera.streaming.scoring import run_scoring_stream
    rows = [dict(r, id=f"{r['id']}-{i}", Age=r["Age"] + i) for i in range(8) for r in survey_rows]
    train = make_survey(spark, rows)
    params = {"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 1, "max_features": "sqrt"}
    model = M.build_pipeline(M.make_classifier(M.RANDOM_FOREST, params, 3)).fit(train)
    source = train.drop("Obesity").withColumn("Age", F.when(F.col("id") == "1-0", 5.0).otherwise(F.col("Age")))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    source.write.parquet(src)
    for attempt in ("a", "b"):  # a lost checkpoint replays the batch: what it wrote is there and stays
        run_scoring_stream(spark, lambda: (model, None), src, source.schema, out, str(tmp_path / attempt))
        got = spark.read.parquet(out)
        assert got.where("route = 'scored'").count() == len(rows) - 1
        assert [r["id"] for r in got.where("route = 'rejected'").collect()] == ["1-0"]


def test_metadata_defaults_and_errors(spark, tmp_path):
    from tessera.sources import artefacts as SA
    (r,) = SA.read_metadata(spark, str(tmp_path / "absent")).collect()
    assert (r["model_version"], r["accuracy"]) == ("N/A", 0.0)
    path = str(tmp_path / "runs")
    SA.log_run(spark, path, "low", "e", {"a": 1}, {"accuracy": 0.5}, None)
    SA.log_run(spark, path, "high", "e", {"a": 2}, {"accuracy": 0.9}, "m")
    SA.log_run(spark, path, "other", "f", {}, {"accuracy": 1.0}, None)
    assert SA.best_run(spark, path, "e").first()["run_name"] == "high"
