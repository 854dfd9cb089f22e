"""Quality classifier with hierarchical empirical Bayes (dealt operator 5).

A logistic model of format features, trained on labelled documents, gives each document its own
evidence. Hosts and, within them, paths have posteriors: their documents' mean evidence, shrunk
toward the level above by as many pseudo-documents as the variance between groups allows (method of
moments). A sparse site so stays near the global prior. A document's own evidence is left out of
its site's posterior, and both are combined on the log-odds scale.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, words_of

#: A bound on the labelled documents that the model is fitted on.
MAX_TRAINING = 50_000
#: A site table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SITES = 50_000
FEATURES = ["log_words", "upper", "symbol", "digit", "stop", "space", "word_length", "repeated", "repeated_lines", "bars", "no_text"]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, host, path and the format features of each text (NULL: as empty)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")) / chars

    rows = docs.select("doc_id", "host", "path", t.alias("text")).withColumn("_w", words_of(F.col("text")))
    rows = rows.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0))
    n, t = F.size("_w"), F.col("text")
    chars = F.greatest(F.length(t), F.lit(1))
    return rows.select(
        "doc_id", "host", "path", F.log1p(n).alias("log_words"), share(r"\P{Lu}+").alias("upper"), share(r"[^#*$%&|<>!=_~^@\\/+{}\[\]]+").alias("symbol"),
        share(r"\P{Nd}+").alias("digit"), share(r"[^.,;:'\"?()-]+").alias("stop"), share(r"[^\x20\x09-\x0D]+").alias("space"),
        F.when(n > 0, F.length(t) / n).otherwise(F.lit(0.0)).alias("word_length"),
        F.when(n > 0, 1 - F.size(F.array_distinct("_w")) / n).otherwise(F.lit(0.0)).alias("repeated"),
        F.when(F.size("_l") > 0, 1 - F.size(F.array_distinct("_l")) / F.size("_l")).otherwise(F.lit(0.0)).alias("repeated_lines"),
        F.when(n > 0, F.size(F.filter("_w", lambda w: w == "|")) / n).otherwise(F.lit(0.0)).alias("bars"),
        (n == 0).cast("double").alias("no_text"))


def evidence(rows: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """Add ``p``: the model's probability of good quality, between 0.001 and 0.999.

    ``labels`` (doc_id, quality) are joined by id; the mean of several counts as good from one half
    on. Without both kinds of labels all documents get the share of good ones, or one half.
    """
    truth = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    known = saved(rows.join(truth, "doc_id"), "labelled")
    n, good = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return rows.withColumn("p", F.lit(0.5 if not n else min(0.999, max(0.001, good / n))))
    take = min(1.0, MAX_TRAINING / n)
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(take * 1_000_000))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="x")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-4, maxIter=60, probabilityCol="_p", rawPredictionCol="_r",
                               predictionCol="_y").fit(vector.transform(sample.coalesce(4)))
    got = model.transform(vector.transform(rows))
    p = vector_to_array("_p")[1]
    return got.select("doc_id", "host", "path", F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)).alias("p"))


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents of a level: variance within its groups over the variance between them."""
    g = groups.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("s") * F.col("s") / F.col("n")),
                                   F.sum(F.col("n").cast("double") * F.col("n"))).first()
    k, n, s, q, ss, nn = (float(x or 0) for x in g)
    if k < 2 or n <= k:
        return 1.0
    within = max(0.0, (q - ss) / (n - k))
    between = (ss - s * s / n - (k - 1) * within) / (n - nn / n)
    return within / between if between > 1e-9 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Quality of each row of ``docs`` (doc_id, text, host, path), one row per row.

    Returns doc_id, evidence (of the text alone), host_posterior, path_posterior, score (the
    combined probability), kept (score at or above ``threshold``). NULL hosts or paths are groups
    like any other. NULL texts are as empty ones. Repeated rows count as several documents of their
    site. Without labels all evidence is equal and so is the score. An empty table gives no rows;
    other columns are not read.
    """
    rows = saved(features(docs), "features")
    scored = saved(evidence(rows, labels).select("doc_id", "host", "path", "p"), "evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = saved(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    prior = (total[1] / total[0]) if total[0] else 0.5
    for_host, for_path = _strength(hosts), _strength(paths)
    h, p = hosts.alias("h"), paths.alias("p")
    sites = p.join(h, F.col("h.host").eqNullSafe(F.col("p.host"))).select(
        "p.host", "p.path", F.col("p.n").alias("pn"), F.col("p.s").alias("ps"), F.col("h.n").alias("hn"), F.col("h.s").alias("hs"))
    few = paths.count() <= BROADCAST_SITES
    d, s = scored.alias("d"), (F.broadcast(sites) if few else sites).alias("s")
    joined = d.join(s, F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    host = (for_host * prior + F.col("hs") - F.col("p")) / (for_host + F.col("hn") - 1)
    clip = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), c))
    joined = joined.select("d.doc_id", "d.p", "pn", "ps", clip(F.when((F.lit(for_host) + F.col("hn") - 1) > 0, host).otherwise(F.lit(prior))).alias("host_posterior"))
    path = (for_path * F.col("host_posterior") + F.col("ps") - F.col("p")) / (for_path + F.col("pn") - 1)
    joined = joined.withColumn("path_posterior", clip(F.when((F.lit(for_path) + F.col("pn") - 1) > 0, path).otherwise(F.col("host_posterior"))))
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(min(0.999, max(0.001, prior))))
    return (joined.withColumn("score", 1 / (1 + F.exp(-odds)))
            .select("doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept")))
