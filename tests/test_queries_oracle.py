"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="driver tables absent")

FAST = ["s0_survey_raw", "c1_remove_duplicates", "c5_clean", "c6_cleaning_report", "v4_violations", "v6_record_errors",
        "a1_class_distribution", "a2_age_by_class", "a24_box_weight", "e11_features",
        "k1_spearman", "l1_stratified_split", "n6_class_report", "n8_auc", "o2_alerts", "p6_filtered_data",
        "a7_describe_numeric", "a20_kpis", "e17_alternative_encoding", "e17_scoring_encoding", "k4_numeric_vs_target",
        "k5_fe_comparison", "m6_routing_counts", "n7_roc_points", "p5_labels_back", "t4_correlations_ascending"]



def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() == 7
