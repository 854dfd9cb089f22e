"""Registered split (L*), evaluation (N*) and enrichment (O*) queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import spec as SP
from ..operators import enrich as Oe
from ..operators import evaluate as N
from ..operators import split as L
from ..spec import OBESITY
from . import bases
from . import oracle as O
from .registry import register

S = OBESITY
CLASS_CASE = " ".join(f"WHEN {{c}} = {O.q(c)} THEN {i}" for i, c in enumerate(S.class_order))


def sev_sql(col: str) -> str:
    return "CASE " + CLASS_CASE.format(c=col) + " END"


# --------------------------------------------------------------------------- splits
def _quota_ctes() -> tuple:
    return (
        f"qc AS (SELECT Obesity AS c, {sev_sql('Obesity')} AS sev, count(*) AS k FROM base_clean GROUP BY Obesity)",
        "qn AS (SELECT sum(k) AS n, sum(k) - (sum(k) * 3 + 9) // 10 AS t FROM qc)",
        "q1 AS (SELECT qc.c, qc.sev, qc.k, qn.n, qn.t, (qc.k * qn.t) // qn.n AS fl, (qc.k * qn.t) % qn.n AS rm FROM qc, qn)",
        "q1r AS (SELECT *, row_number() OVER (ORDER BY rm DESC, sev, c) AS rk, t - sum(fl) OVER () AS extra FROM q1)",
        "q2 AS (SELECT c, sev, k, fl + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS tr FROM q1r)",
        "q2h AS (SELECT c, sev, tr, k - tr AS h FROM q2)",
        "q2n AS (SELECT sum(h) AS hh, sum(h) - (sum(h) + 1) // 2 AS v FROM q2h)",
        "q3 AS (SELECT q2h.*, (h * v) // NULLIF(hh, 0) AS vfl, (h * v) % NULLIF(hh, 0) AS vrm, v FROM q2h, q2n)",
        "q3r AS (SELECT *, row_number() OVER (ORDER BY vrm DESC, sev, c) AS rk2, v - sum(vfl) OVER () AS vextra FROM q3)",
        "quota AS (SELECT c, tr, coalesce(vfl, 0) + CASE WHEN rk2 <= vextra THEN 1 ELSE 0 END AS va FROM q3r)",
        "pos AS (SELECT id, Obesity, row_number() OVER (PARTITION BY Obesity ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1 "
        "AS p FROM base_clean)",
        "splits AS (SELECT pos.id, pos.Obesity, CASE WHEN p < tr THEN 'train' WHEN p < tr + va THEN 'val' ELSE 'test' END "
        "AS split FROM pos JOIN quota ON pos.Obesity = quota.c)")


SPLIT = _quota_ctes()


def split_frame(spark, sf):
    return L.stratified_split(bases.base_clean(spark, sf).select("id", S.target))


@register("l1_stratified_split", O.with_clean(*SPLIT) + "\nSELECT id, Obesity, split FROM splits")
def l1_stratified_split(spark, sf):
    """L1: 70/15/15 stratified split, hash order seeded with 42; sizes by largest remainder."""
    return split_frame(spark, sf).select("id", S.target, "split")


@register("l1_split_sizes", O.with_clean(*SPLIT) + "\nSELECT Obesity, split, count(*) AS n FROM splits GROUP BY Obesity, split")
def l1_split_sizes(spark, sf):
    return split_frame(spark, sf).groupBy(S.target, "split").agg(F.count("*").alias("n"))


@register("l3_stratified_folds", O.with_clean(SPLIT[-2]) + "\nSELECT id, Obesity, CAST(p % 5 AS INTEGER) AS fold FROM pos")
def l3_stratified_folds(spark, sf):
    """L3: 5 stratified folds (position in the class modulo 5)."""
    return L.stratified_folds(bases.base_clean(spark, sf).select("id", S.target), 5).select("id", S.target, "fold")


_L4 = ("ls AS (SELECT Obesity, count(*) AS a, count(*) FILTER (WHERE split = 'train') AS tr, "
       "count(*) FILTER (WHERE split = 'val') AS va, count(*) FILTER (WHERE split = 'test') AS te FROM splits GROUP BY Obesity)",
       "lt AS (SELECT sum(a) AS ta, sum(tr) AS ttr, sum(va) AS tva, sum(te) AS tte FROM ls)",
       "lp AS (SELECT Obesity, a * 100.0 / ta AS pa, tr * 100.0 / ttr AS ptr, va * 100.0 / tva AS pva, te * 100.0 / tte AS pte "
       "FROM ls, lt)")


@register("l4_split_distribution", O.with_clean(*SPLIT, *_L4)
          + "\nSELECT Obesity AS class_en, round(pa, 2) AS pct_all, round(ptr, 2) AS pct_train, round(pva, 2) AS pct_val, "
          "round(pte, 2) AS pct_test, round(greatest(abs(ptr - pa), abs(pva - pa), abs(pte - pa)), 2) AS max_abs_delta FROM lp")
def l4_split_distribution(spark, sf):
    return L.split_distribution(split_frame(spark, sf))


@register("v11_split_drift", O.with_clean(*SPLIT, *_L4)
          + "\nSELECT max(round(greatest(abs(ptr - pa), abs(pva - pa), abs(pte - pa)), 2)) AS max_abs_delta, "
          "max(round(greatest(abs(ptr - pa), abs(pva - pa), abs(pte - pa)), 2)) <= 5.0 AS within_limit FROM lp")
def v11_split_drift(spark, sf):
    return L.drift_check(L.split_distribution(split_frame(spark, sf)))


# --------------------------------------------------------------------------- evaluation
def _scored_ctes() -> tuple:
    s = "Weight / (Height * Height) + CAST((CAST('0x' || substr(md5(id), 1, 4) AS INTEGER) % 7) - 3 AS DOUBLE) * 0.8"
    ws = [f"1.0 / (1.0 + abs(s - {m}))" for m in N.RULE_MIDS]
    total = ws[0]
    for w in ws[1:]:
        total = f"({total}) + {w}"
    pred = "CASE " + " ".join(f"WHEN s < {cut} THEN {O.q(c)}" for cut, c in zip(N.RULE_CUTS, S.class_order)) + \
        f" ELSE {O.q(S.class_order[-1])} END"
    probs = ", ".join(f"({w}) / ({total}) AS p_{c}" for w, c in zip(ws, S.class_order))
    conf = "CASE " + " ".join(f"WHEN predicted = {O.q(c)} THEN p_{c}" for c in S.class_order) + " END"
    return (f"sc0 AS (SELECT id, Obesity AS actual, {s} AS s FROM base_clean)",
            f"sc1 AS (SELECT id, actual, {pred} AS predicted, {probs} FROM sc0)",
            f"sc AS (SELECT *, {conf} AS confidence FROM sc1)",
            "cells AS (SELECT actual, predicted, count(*) AS n FROM sc GROUP BY actual, predicted)")


SCORED = _scored_ctes()


def scored(spark, sf):
    return N.rule_scored(bases.base_clean(spark, sf))


@register("n0_rule_scored", O.with_clean(*SCORED) + "\nSELECT id, actual, predicted, round(confidence, 6) AS confidence FROM sc")
def n0_rule_scored(spark, sf):
    return scored(spark, sf).select("id", "actual", "predicted", F.round("confidence", 6).alias("confidence"))


@register("n4_confusion_matrix", O.with_clean(*SCORED) + "\nSELECT actual, predicted, n FROM cells "
          "WHERE predicted IN (SELECT DISTINCT actual FROM cells)")
def n4_confusion_matrix(spark, sf):
    return N.confusion_matrix(N.confusion_counts(scored(spark, sf)))


_PC = ("bt AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp "
       "FROM cells GROUP BY actual)",
       "bp AS (SELECT predicted AS label, sum(n) AS n_pred FROM cells GROUP BY predicted)",
       "pc0 AS (SELECT coalesce(bt.label, bp.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, "
       "coalesce(n_pred, 0) AS n_pred FROM bt FULL OUTER JOIN bp ON bt.label = bp.label)",
       "pc1 AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / NULLIF(n_pred, 0), 0.0) AS precision, "
       "coalesce(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) AS recall FROM pc0)",
       "pc AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM pc1)")


@register("n1_n2_metrics", O.with_clean(*SCORED, *_PC)
          + "\nSELECT round(a.acc, 6) AS accuracy, round(m.mf1, 6) AS macro_f1, a.acc >= 0.75 AS passes_gate, a.n "
          "FROM (SELECT CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS acc, "
          "CAST(sum(n) AS BIGINT) AS n FROM cells) a CROSS JOIN (SELECT avg(f1) AS mf1 FROM pc) m")
def n1_n2_metrics(spark, sf):
    """Accuracy, macro-F1 (labels of truth ∪ prediction), accuracy gate."""
    return N.summary_metrics(N.confusion_counts(scored(spark, sf)))


@register("n6_class_report", O.with_clean(*SCORED, *_PC)
          + "\nSELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
          f"CAST(support AS BIGINT) AS support, CAST({sev_sql('label')} AS INTEGER) AS ord FROM pc WHERE support > 0 "
          "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), "
          "CAST(sum(support) AS BIGINT), 100 FROM pc WHERE support > 0 "
          "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), "
          "round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), "
          "CAST(sum(support) AS BIGINT), 101 FROM pc WHERE support > 0")
def n6_class_report(spark, sf):
    """Per-class precision/recall/F1/support + macro and weighted averages."""
    return N.class_report(N.confusion_counts(scored(spark, sf)))


_ST = ("lng AS (" + " UNION ALL ".join(
    f"SELECT {O.q(c)} AS class, p_{c} AS score, CASE WHEN actual = {O.q(c)} THEN 1 ELSE 0 END AS pos FROM sc"
    for c in S.class_order) + ")",
       "st AS (SELECT class, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM lng GROUP BY class, score)",
       "tt AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM st GROUP BY class)")


@register("n7_roc_points", O.with_clean(*SCORED, *_ST,
          "cum AS (SELECT class, score, sum(pos) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, "
          "sum(neg) OVER (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, "
          "row_number() OVER (PARTITION BY class ORDER BY score DESC) = 1 AS is_first, pos, neg, "
          "lead(pos) OVER (PARTITION BY class ORDER BY score DESC) AS next_pos, "
          "lead(neg) OVER (PARTITION BY class ORDER BY score DESC) AS next_neg FROM st)")
          + "\nSELECT cum.class, round(score, 6) AS score, round(CAST(tp AS DOUBLE) / P, 6) AS tpr, "
          "round(coalesce(CAST(fp AS DOUBLE) / NULLIF(N, 0), 0.0), 6) AS fpr FROM cum JOIN tt ON cum.class = tt.class "
          "WHERE P > 0 AND (is_first OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg) "
          "UNION ALL SELECT class, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM tt WHERE P > 0")
def n7_roc_points(spark, sf):
    """One-vs-rest ROC points per class, one per distinct score."""
    return N.roc_points(scored(spark, sf))


@register("n8_auc", O.with_clean(*SCORED, *_ST,
          "rk AS (SELECT class, score, pos, neg, coalesce(sum(pos + neg) OVER (PARTITION BY class ORDER BY score "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (pos + neg + 1) / 2.0 AS r FROM st)")
          + "\nSELECT rk.class, round((sum(pos * r) - max(tt.P) * (max(tt.P) + 1) / 2.0) / (max(tt.P) * max(tt.N)), 6) AS auc "
          "FROM rk JOIN tt ON rk.class = tt.class WHERE tt.P > 0 AND tt.N > 0 GROUP BY rk.class")
def n8_auc(spark, sf):
    """One-vs-rest AUC per class (Mann–Whitney with average ranks)."""
    return N.auc(scored(spark, sf))


# --------------------------------------------------------------------------- enrichment
def _band_sql(x: str) -> tuple:
    lab = "CASE " + " ".join(f"WHEN {x} <= {t} THEN {O.q(l)}" for t, l, _ in SP.BMI_BANDS if t != float("inf")) + \
        f" ELSE {O.q(SP.BMI_BANDS[-1][1])} END"
    col = "CASE " + " ".join(f"WHEN {x} <= {t} THEN {O.q(c)}" for t, _, c in SP.BMI_BANDS if t != float("inf")) + \
        f" ELSE {O.q(SP.BMI_BANDS[-1][2])} END"
    return lab, col


@register("o1_bmi_interpretation", O.with_clean("ob AS (SELECT id, Weight / (Height * Height) AS bmi FROM base_clean)")
          + "\nSELECT id, round(bmi, 2) AS bmi, {0} AS band, {1} AS band_color FROM ob".format(*_band_sql("bmi")))
def o1_bmi_interpretation(spark, sf):
    """O1 + O7: BMI rounded to 2 and its right-closed interpretation band."""
    b = F.col("Weight") / (F.col("Height") * F.col("Height"))
    return bases.base_clean(spark, sf).select("id", F.round(b, 2).alias("bmi"), Oe.bmi_band(b).alias("band"),
                                              Oe.bmi_band_color(b).alias("band_color"))


def _alerts_sql() -> str:
    d = SP.ALERT_DEFAULTS
    fam, smoke, favc = (f"coalesce({c}, {O.q(d[c])})" for c in ("family_history", "SMOKE", "FAVC"))
    faf, ch2o = f"coalesce(FAF, {d['FAF']})", f"coalesce(CH2O, {d['CH2O']})"
    codes = [f"CASE WHEN {fam} = 'yes' THEN 'family_history' END",
             f"CASE WHEN {smoke} = 'yes' THEN 'smoking' END",
             f"CASE WHEN {favc} = 'yes' AND {faf} < 1.0 THEN 'calorie_sedentary' WHEN {faf} < 1.0 THEN 'low_activity' END",
             f"CASE WHEN {ch2o} < 1.5 THEN 'low_water' END"]
    return (O.with_raw() + "\nSELECT id, array_to_string(list_filter([" + ", ".join(codes)
            + "], lambda x: x IS NOT NULL), '|') AS alerts FROM survey_raw")


@register("o2_alerts", _alerts_sql())
def o2_alerts(spark, sf):
    """O2: contextual alert codes for every raw survey answer set."""
    raw = bases.raw(spark, sf)
    return raw.select("id", F.array_join(Oe.alerts(raw), "|").alias("alerts"))


def _clinical_values() -> str:
    rows = []
    for c, (_, risks, recs) in SP.CLINICAL_INFO.items():
        rows += [f"({O.q(c)}, 'risk', {i}, {O.q(t)})" for i, t in enumerate(risks)]
        rows += [f"({O.q(c)}, 'recommendation', {i}, {O.q(t)})" for i, t in enumerate(recs)]
    return "clin AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(cls, kind, pos, text))"


@register("o5_clinical_long", O.with_clean(*SCORED, _clinical_values())
          + "\nSELECT sc.id, sc.predicted, clin.kind, CAST(clin.pos AS INTEGER) AS pos, clin.text "
          "FROM sc JOIN clin ON sc.predicted = clin.cls")
def o5_clinical_long(spark, sf):
    """Clinical risks and recommendations of the predicted class, one row each."""
    return Oe.clinical_long(scored(spark, sf))


def _display_sql() -> str:
    icon = "CASE " + " ".join(f"WHEN predicted = {O.q(c)} THEN {O.q(v[0])}" for c, v in SP.CLASS_DISPLAY.items()) + \
        f" ELSE {O.q(SP.DISPLAY_DEFAULT[0])} END"
    color = "CASE " + " ".join(f"WHEN predicted = {O.q(c)} THEN {O.q(v[1])}" for c, v in SP.CLASS_DISPLAY.items()) + \
        f" ELSE {O.q(SP.DISPLAY_DEFAULT[1])} END"
    risk = "coalesce(CASE " + " ".join(f"WHEN predicted = {O.q(c)} THEN {O.q(v)}" for c, v in SP.RISK_LEVELS.items()) + \
        f" END, {O.q(SP.RISK_DEFAULT)})"
    rlab = "CASE " + " ".join(f"WHEN {risk} = {O.q(k)} THEN {O.q(v)}" for k, v in SP.RISK_LABELS.items()) + " END"
    rcol = f"CASE {risk} " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in SP.RISK_COLORS.items()) + " END"
    lab = "coalesce(CASE " + " ".join(f"WHEN predicted = {O.q(c)} THEN {O.q(v)}" for c, v in S.class_labels.items()) + \
        " END, predicted)"
    return (O.with_clean(*SCORED) + f"\nSELECT id, predicted, {lab} AS label_pt, {icon} AS icon, {color} AS color, "
            f"{risk} AS risk_level, {rlab} AS risk_label, {rcol} AS risk_color, round(confidence, 6) AS confidence FROM sc")


@register("o6_prediction_display", _display_sql())
def o6_prediction_display(spark, sf):
    """O6 + M7/M8 + P4: label, icon, colour, risk level/label and confidence per prediction."""
    e = Oe.enrich_prediction(scored(spark, sf))
    return e.select("id", "predicted", "label_pt", "icon", "color", "risk_level", "risk_label", "risk_color",
                    F.round("confidence", 6).alias("confidence"))


@register("l5_prediction_sample", O.with_clean(*SCORED)
          + "\nSELECT id, actual, predicted, round(confidence, 6) AS confidence, "
          "CAST(CASE WHEN actual = predicted THEN 1 ELSE 0 END AS INTEGER) AS correct FROM sc ORDER BY id LIMIT 5")
def l5_prediction_sample(spark, sf):
    """L5 + T3 + M7: first rows (by id) with prediction, truth and confidence — a sample report."""
    s = scored(spark, sf)
    return (s.select("id", "actual", "predicted", F.round("confidence", 6).alias("confidence"),
                     (F.col("actual") == F.col("predicted")).cast("int").alias("correct"))
            .orderBy("id").limit(5))


@register("p7_visible_classes", O.with_clean(*SCORED)
          + "\nSELECT actual AS class_en, count(*) AS n FROM sc WHERE actual IN ('Obesity_Type_I', 'Obesity_Type_II', "
          "'Obesity_Type_III') GROUP BY actual")
def p7_visible_classes(spark, sf):
    """A result table restricted to the classes visible in a view (here the severe ones)."""
    from ..spec import SEVERE_CLASSES
    return scored(spark, sf).where(F.col("actual").isin(SEVERE_CLASSES)).groupBy(
        F.col("actual").alias("class_en")).agg(F.count("*").alias("n"))
