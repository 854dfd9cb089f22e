"""A training-data pipeline over ``documents`` made of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result
is written as Parquet in the shared folder and read again.

In all stages a NULL text counts as empty, rows are judged one by one whatever ids they share, columns
besides those of ``documents`` stay (the last stage returns pieces instead), and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, saved
from tessera.llm.langid import held_out, keep_identified, learn
from tessera.llm.mixing import mixed
from tessera.llm.ngram_join import one_per_class
from tessera.llm.packing import pack
from tessera.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents without a language (no letters, or no language with half of them) go; so do
    NULL and empty texts. Ties between languages go to the one that sorts first."""
    return keep_identified(docs, learn(docs.filter(~held_out(F.col("doc_id")))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each class of near duplicates stays, the one with the least doc_id (a
    NULL id is the last choice). Repeated rows are duplicates; rows without words all stay."""
    return one_per_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: personal data in the texts is replaced by its kind; NULL texts stay NULL, no row goes."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents are dropped or repeated so that sources have their target weights. Rows
    of equal id, source and size share their copies by chance; NULL sources are one source."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: what is left is packed into training sequences; one row per piece. An
    empty text is a piece of its end mark alone."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: DuckDB can't express the models, the random rounding or the tokenizer; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
