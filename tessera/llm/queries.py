"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .collocations import collocations
from .common import documents, table
from .langid import held_out, identify, learn
from .mixing import mix
from .negatives import hard_negatives
from .ngram_join import near_duplicates
from .oracles import COLLOCATIONS, HARD_NEGATIVES, NGRAM_JOIN, SUBSTRING, SUFFIX
from .packing import pack
from .pii import personal_data
from .quality import classify
from .rules import quality_rules
from .substring import repeated_words
from .suffix import later_bytes
from .syncmer import fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING, "op4_suffix_dedup": SUFFIX, "op9_ngram_jaccard_join": NGRAM_JOIN,
                           "op12_collocations": COLLOCATIONS, "op13_hard_negatives": HARD_NEGATIVES}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(documents(spark, sf_dir))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    got = identify(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_words(documents(spark, sf_dir), 35)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = later_bytes(documents(spark, sf_dir), 100)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints(documents(spark, sf_dir))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                      "next_id", "next_chars")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's source is its host, and its language section there its path
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(docs, table(spark, sf_dir, "labels"))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(documents(spark, sf_dir))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans",
                      F.size("found").cast("long").alias("n_spans"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), own.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    own = held_out(F.col("doc_id"))
    model = toxicity.learn(docs.filter(~own), table(spark, sf_dir, "labels").filter(~own))
    got = toxicity.score(docs, model)
    return got.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_windows", "worst")
