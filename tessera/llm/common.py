"""Helpers shared by the corpus operators: intermediate tables, words and the table reader."""

from __future__ import annotations

import gc
import importlib
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_exit, shared_dir

# executors need not have this package installed: its functions travel with the tasks
cloudpickle.register_pickle_by_value(importlib.import_module(__package__))

#: Java regular expression of one word: a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning. The folder goes when the
    application ends, or before by ``discard``. The shuffle files that led to it aren't needed any
    more; a collection on the driver lets Spark's cleaner remove them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order, unchanged; empty for NULL or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: F.length(w) > 0)


def count_words(text: Column) -> Column:
    """Number of words of a text (NULL: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_worker(name: str, make):
    """A table that is costly to build, kept for the life of a Python worker."""
    import sys

    tables = sys.modules.setdefault("_tessera_worker_tables", {})
    if name not in tables:
        tables[name] = make()
    return tables[name]


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(d, th): a row's key. d is the id; th, a 64-bit hash of the text, tells rows of equal ids apart. Rows
    without an id have 61 more bits of hash in d, below all ids from -6 917 529 027 641 081 856 on."""
    more = F.xxhash64(F.lit(1), text).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(doc_id, more + F.lit(-(1 << 63))), F.xxhash64(text)
