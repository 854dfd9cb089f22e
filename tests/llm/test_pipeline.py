"""The pipeline: each stage on what the one before it kept."""

import os

import pytest

from .conftest import odd_rows
from .test_classifiers import language_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_odd_rows(spark, make, tmp_path):
    import corpus_pipeline as pipeline
    docs = make(language_rows(5, 60) + [(1000 + (r[0] or 0) if r[0] else None, *r[1:]) for r in odd_rows()])
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if i < 3:
            assert docs.count() <= before
            before = docs.count()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    for name, stage in pipeline.STAGES:
        assert stage(spark, make([]), SF).count() == 0, name


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver tables absent")
def test_run_on_driver_tables(spark):
    import corpus_pipeline as pipeline
    rows = pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names), n
