"""Classification metrics from one confusion aggregate, and ROC/AUC from
distributed cumulative counts.

Everything except ROC/AUC derives from ``confusion_counts`` — one shuffle of
at most (#classes)² groups with map-side partial aggregation. ROC points and AUC
need per-score cumulative counts: scores are pre-aggregated per (class, score)
and the running sums come from ``running_total`` (bounded tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import class_dim
from ..functions.stats import running_total
from ..session import materialize
from ..spec import ACCURACY_GATE, OBESITY, SurveySpec

# FIXED VALUES of the deterministic rule-based scorer used to exercise evaluation with an
# exact oracle: class cut points on BMI (the fixture's own class bands) and band centres.
RULE_CUTS = [18.5, 25.0, 27.0, 30.0, 35.0, 40.0]
RULE_MIDS = [16.0, 21.75, 26.0, 28.5, 32.5, 37.5, 42.5]
RULE_SHIFT = 0.8


def rule_scored(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """``scored_rule``: prediction = BMI band of ``bmi + (k − 3)·0.8`` with k = 0..6
    from the digest of the id;
    class probability ∝ 1 / (1 + |shifted − band centre|). Output: id, actual, predicted,
    one ``p_<class>`` column per class, confidence = probability of the predicted class."""
    classes = spec.class_order
    bmi = F.col("Weight") / (F.col("Height") * F.col("Height"))
    k = F.conv(F.substring(F.md5(F.col(spec.id_col).cast("string")), 1, 4), 16, 10).cast("int") % 7
    shifted = bmi + (k - 3).cast("double") * RULE_SHIFT
    pred = None
    for cut, c in zip(RULE_CUTS, classes):
        pred = F.when(F.col("_s") < cut, c) if pred is None else pred.when(F.col("_s") < cut, c)
    pred = pred.otherwise(classes[-1])
    w = [1.0 / (1.0 + F.abs(F.col("_s") - m)) for m in RULE_MIDS]
    total = w[0]
    for x in w[1:]:
        total = total + x
    base = df.select(spec.id_col, F.col(spec.target).alias("actual"), shifted.alias("_s"))
    probs = {f"p_{c}": (w[i] / F.col("_wt")) for i, c in enumerate(classes)}
    out = (base.withColumn("_wt", total).withColumn("predicted", pred).withColumns(probs)
           .drop("_s", "_wt"))
    conf = None
    for c in classes:
        conf = (F.when(F.col("predicted") == c, F.col(f"p_{c}")) if conf is None
                else conf.when(F.col("predicted") == c, F.col(f"p_{c}")))
    return out.withColumn("confidence", conf)


def confusion_counts(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """All (actual, predicted, n) cells — the single aggregate every metric derives from."""
    return scored.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """Cells restricted to labels present in the truth (other predictions dropped)."""
    present = cells.select(F.col("actual").alias("_l")).distinct()
    return cells.join(F.broadcast(present), cells["predicted"] == present["_l"], "left_semi")


def per_class(cells: DataFrame) -> DataFrame:
    """Per label of actual ∪ predicted: support, tp, predicted count, precision, recall, F1
    (0/0 → 0)."""
    by_true = cells.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    by_pred = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_pred"))
    j = by_true.join(by_pred, "label", "full_outer").na.fill(0, ["support", "tp", "n_pred"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("label", F.col("support").cast("long"), F.col("tp").cast("long"), F.col("n_pred").cast("long"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def summary_metrics(cells: DataFrame, gate: float = ACCURACY_GATE, places: int = 6) -> DataFrame:
    """Accuracy, macro-F1 over actual ∪ predicted labels, accuracy gate."""
    pc = per_class(cells)
    acc = cells.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"))
                    .alias("accuracy"), F.sum("n").alias("n"))
    f1 = pc.agg(F.avg("f1").alias("macro_f1"))
    return acc.crossJoin(f1).select(F.round("accuracy", places).alias("accuracy"),
                                    F.round("macro_f1", places).alias("macro_f1"),
                                    (F.col("accuracy") >= gate).alias("passes_gate"),
                                    F.col("n").cast("long").alias("n"))


def class_report(cells: DataFrame, spec: SurveySpec = OBESITY, places: int = 6) -> DataFrame:
    """Precision, recall (= per-class accuracy), F1 and support for the labels present
    in the truth (canonical order), plus macro and weighted averages over them. Keyed by label."""
    spark = cells.sparkSession
    pc = per_class(cells).where(F.col("support") > 0)
    rows = pc.join(class_dim(spark, spec).select(F.col("class_en").alias("label"), "severity"), "label", "left")
    metrics = ["precision", "recall", "f1"]
    macro = pc.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in metrics],
                   F.sum("support").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics],
                      F.sum("support").alias("support"))
    body = rows.select("label", *metrics, "support", F.col("severity").cast("int").alias("ord"))
    tail = macro.withColumn("ord", F.lit(100)).unionByName(weighted.withColumn("ord", F.lit(101)))
    out = body.unionByName(tail.select("label", *metrics, "support", "ord"))
    return out.select("label", *[F.round(m, places).alias(m) for m in metrics],
                      F.col("support").cast("long").alias("support"), "ord")


def _score_table(scored: DataFrame, classes) -> DataFrame:
    """(class, score, pos, neg) per distinct score: one explode + one partial aggregate."""
    items = [F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("score"),
                      (F.col("actual") == F.lit(c)).cast("int").alias("pos")) for c in classes]
    long = scored.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    return long.groupBy("class", "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))


def roc_points(scored: DataFrame, spec: SurveySpec = OBESITY, places: int = 6) -> DataFrame:
    """One-vs-rest ROC points per class present in the truth: (0, 0) with no threshold, then
    the distinct scores in descending order (threshold = score) with their cumulative TP/FP rates.
    A point whose next one adds as many positives and negatives as it did itself lies on a straight
    line and is dropped, except the first and the last."""
    classes = spec.class_order
    t = _score_table(scored, classes).withColumn("one", F.lit(1))
    totals = t.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where(F.col("P") > 0)
    cum = running_total(t, ["class"], [F.col("score").desc()], ["pos", "neg", "one"], ["_tp_before", "_fp_before", "_i"])
    cum = materialize(cum)  # read by both sides of the join with the following point
    following = cum.select("class", (F.col("_i") - 1).alias("_i"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    bend = (F.col("_i") == 0) | F.col("_pos").isNull() | (F.col("_pos") != F.col("pos")) | (F.col("_neg") != F.col("neg"))
    j = cum.join(following, ["class", "_i"], "left").where(bend).join(F.broadcast(totals), "class")  # ≤ one row per class
    tpr = (F.col("_tp_before") + F.col("pos")).cast("double") / F.col("P").cast("double")
    fpr = F.coalesce(F.try_divide((F.col("_fp_before") + F.col("neg")).cast("double"), F.col("N").cast("double")),
                     F.lit(0.0))
    points = j.select("class", F.round("score", places).alias("score"), F.round(tpr, places).alias("tpr"),
                      F.round(fpr, places).alias("fpr"))
    return points.unionByName(totals.select("class", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("tpr"),
                                            F.lit(0.0).alias("fpr")))


def auc(scored: DataFrame, spec: SurveySpec = OBESITY, places: int = 6) -> DataFrame:
    """One-vs-rest AUC per class = Mann–Whitney U / (P·N) from tie-averaged ranks
    (equal to the trapezoidal area under the ROC curve)."""
    t = _score_table(scored, spec.class_order).withColumn("cnt", F.col("pos") + F.col("neg"))
    r = running_total(t, ["class"], ["score"], "cnt", "_before")
    rank = F.col("_before") + (F.col("cnt") + 1) / 2.0
    agg = r.groupBy("class").agg(F.sum(F.col("pos") * rank).alias("_rs"), F.sum("pos").alias("P"),
                                 F.sum("neg").alias("N"))
    p, n = F.col("P").cast("double"), F.col("N").cast("double")  # their product outgrows a BIGINT
    u = F.col("_rs") - p * (p + 1) / 2.0
    return agg.where((F.col("P") > 0) & (F.col("N") > 0)).select("class", F.round(u / (p * n), places).alias("auc"))
