"""Builders of the independent DuckDB/ANSI oracle SQL for the registered queries.

Each oracle starts from the fixture projection of ``lineitem`` and re-states the
operator in plain SQL (window functions and single-node aggregates are fine here:
the oracle is a correctness reference, not the engine).
"""

from __future__ import annotations

from ..sources.survey import FIXTURE_CTES, FIXTURE_SELECT
from ..spec import OBESITY

S = OBESITY
COLS = ", ".join(S.columns)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


RAW = f"{FIXTURE_CTES},\nsurvey_raw AS ({FIXTURE_SELECT})"
DEDUP = f"dedup AS (SELECT min(id) AS id, {COLS} FROM survey_raw GROUP BY {COLS})"
ANALYTICS = f"base_analytics AS (SELECT * FROM dedup WHERE Obesity IN {in_list(S.class_order)})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def canonical(c: str, values) -> str:
    whens = " ".join(f"WHEN {q(v.strip().lower())} THEN {q(v)}" for v in values)
    return f"CASE lower({strip(c)}) {whens} ELSE {c} END"


def _clean_ctes() -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in S.numeric_cols)
    imp = ", ".join(f"coalesce(d.{c}, m.{c}) AS {c}" if c in S.numeric_ranges else f"d.{c}" for c in S.columns)
    modes = ",\n".join(
        f"mode_{c} AS (SELECT {c} AS v FROM imp WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)" for c in S.categorical_cols)
    imp2 = ", ".join(f"coalesce(imp.{c}, (SELECT v FROM mode_{c})) AS {c}" if c in S.categorical_values
                     else f"imp.{c}" for c in S.columns)
    canon = ", ".join(f"{canonical(c, S.categorical_values[c])} AS {c}" if c in S.categorical_values else c
                      for c in S.columns)
    return (f"med AS (SELECT {med} FROM dedup),\n"
            f"imp AS (SELECT d.id, {imp} FROM dedup d CROSS JOIN med m),\n{modes},\n"
            f"imp2 AS (SELECT imp.id, {imp2} FROM imp),\n"
            f"base_clean AS (SELECT id, {canon} FROM imp2)")


CLEAN = _clean_ctes()


def class_dim_values() -> str:
    rows = ", ".join(f"({q(c)}, {q(S.class_labels[c])}, {i})" for i, c in enumerate(S.class_order))
    return f"class_dim AS (SELECT * FROM (VALUES {rows}) AS t(class_en, class_pt, severity))"


CLASS_DIM = class_dim_values()


def with_raw(*ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, *ctes])


def with_dedup(*ctes: str) -> str:
    return with_raw(DEDUP, *ctes)


def with_analytics(*ctes: str) -> str:
    return with_raw(DEDUP, ANALYTICS, CLASS_DIM, *ctes)


def with_clean(*ctes: str) -> str:
    return with_raw(DEDUP, CLEAN, CLASS_DIM, *ctes)


def pct(part: str, whole: str, places: int) -> str:
    return (f"coalesce(round_even(CAST({part} AS DOUBLE) / CAST(NULLIF({whole}, 0) AS DOUBLE) * 100.0 * {10 ** places}.0, 0) / {10 ** places}.0, 0.0)")


# ----------------------------------------------------------------- feature oracles
def encodable_sql() -> str:
    conds = [f"{c} IN {in_list(S.frequency_ordinal)}" for c in S.ordinal_cols]
    return " AND ".join(["Height > 0", *conds])


FEAT_BASE = f"feat_base AS (SELECT * FROM base_clean WHERE {encodable_sql()})"
ALL_ROWS = "feat_base AS (SELECT * FROM base_clean)"


def ordinal_sql(c: str) -> str:
    whens = " ".join(f"WHEN {c} = {q(k)} THEN {v}" for k, v in S.frequency_ordinal.items())
    return f"CAST(CASE {whens} END AS DOUBLE)"


def yes_sql(c: str, positive: str = "yes") -> str:
    return f"CASE WHEN lower({c}) = {q(positive)} THEN 1 ELSE 0 END"


def _enc_cols() -> list:
    cols = ["Weight / (Height * Height) AS BMI", "Age", "Height", "Weight", "FCVC", "NCP", "CH2O", "FAF", "TUE",
            f"(CAST({yes_sql('FAVC')} AS DOUBLE) * 2.0 + FCVC + NCP + {ordinal_sql('CAEC')}) / 12.0 AS eating_score",
            f"(CASE WHEN (FAF - TUE - {ordinal_sql('CALC')} * 0.5 - CAST({yes_sql('SMOKE')} AS DOUBLE) * 2.0) IS NULL "
            f"THEN NULL ELSE least(greatest(FAF - TUE - {ordinal_sql('CALC')} * 0.5 - CAST({yes_sql('SMOKE')} AS DOUBLE) * 2.0, "
            f"-7.0), 3.0) END + 7.0) / 10.0 AS lifestyle_score",
            "CASE WHEN lower(FAVC) = 'yes' AND FAF < 1.0 THEN 1 ELSE 0 END AS high_calorie_sedentary"]
    cols += [f"{yes_sql(c, p)} AS {c}" for c, p in S.positive_values.items()]
    cols += [f"CAST({ordinal_sql(c)} AS INTEGER) AS {c}" for c in S.ordinal_cols]
    cols += [f"CASE WHEN {S.onehot_col} = {q(cat)} THEN 1 ELSE 0 END AS {S.onehot_col}_{cat}" for cat in S.onehot_categories]
    return cols


ENC = "enc AS (SELECT id, Obesity, " + ", ".join(_enc_cols()) + " FROM feat_base)"


def _stats_cte() -> str:
    parts = [f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in S.standard_cols]
    parts += [f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in S.minmax_cols]
    return "fstats AS (SELECT " + ", ".join(parts) + " FROM enc)"


FSTATS = _stats_cte()


def scaled_sql(c: str) -> str:
    if c in S.standard_cols:
        return f"(enc.{c} - fstats.mean_{c}) / (CASE WHEN coalesce(fstats.std_{c}, 0) = 0 THEN 1.0 ELSE fstats.std_{c} END)"
    if c in S.minmax_cols:
        rng = f"(fstats.max_{c} - fstats.min_{c})"
        return f"(enc.{c} - fstats.min_{c}) / (CASE WHEN coalesce({rng}, 0) = 0 THEN 1.0 ELSE {rng} END)"
    return f"CAST(enc.{c} AS DOUBLE)"


FEATURES_SELECT = ("SELECT enc.id, " + ", ".join(f"round({scaled_sql(c)}, 6) AS {c}" for c in S.feature_names)
                   + " FROM enc CROSS JOIN fstats")


def spearman_sql(src: str, features, target: str, places: int = 4) -> str:
    """ρ(feature, target) per feature over the complete pairs of ``src`` via average ranks + corr."""
    lng = " UNION ALL ".join(f"SELECT {q(f)} AS feature, CAST({f} AS DOUBLE) AS v, CAST({target} AS DOUBLE) AS y FROM {src}"
                             for f in features)
    return (f"sp_long AS (SELECT * FROM ({lng}) u WHERE v IS NOT NULL AND y IS NOT NULL),\n"
            "sp_rank AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + "
            "(count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rx, "
            "rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry "
            "FROM sp_long),\n"
            "sp AS (SELECT feature, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho, "
            "count(*) AS n FROM sp_rank GROUP BY feature)")


def analytics_encoding_sql(src: str = "base_analytics") -> str:
    cols = [f"CAST({c} AS DOUBLE) AS {c}" for c in S.numeric_cols]
    for c, m in S.binary_codes.items():
        whens = " ".join(f"WHEN {c} = {q(k)} THEN {v}" for k, v in m.items())
        cols.append(f"CAST(CASE {whens} END AS DOUBLE) AS {c}")
    cols += [f"{ordinal_sql(c)} AS {c}" for c in S.ordinal_cols]
    tw = " ".join(f"WHEN Obesity = {q(c)} THEN {i}" for i, c in enumerate(S.class_order))
    cols.append(f"CAST(CASE {tw} END AS DOUBLE) AS Obesity_encoded")
    names = [*S.numeric_cols, *S.binary_codes, *S.ordinal_cols, "Obesity_encoded"]
    return (f"aenc0 AS (SELECT id, {', '.join(cols)} FROM {src}),\n"
            f"aenc AS (SELECT * FROM aenc0 WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)})")


def exploratory_encoding_sql(src: str = "base_clean") -> str:
    from ..spec import MTRANS_ACTIVITY
    cols = [f"CAST({c} AS DOUBLE) AS {c}" for c in S.numeric_cols]
    cols.append("CAST(CASE WHEN Gender = 'Male' THEN 1 ELSE 0 END AS DOUBLE) AS Gender")
    cols += [f"CAST({yes_sql(c)} AS DOUBLE) AS {c}" for c in ("family_history", "FAVC", "SMOKE", "SCC")]
    cols += [f"{ordinal_sql(c)} AS {c}" for c in S.ordinal_cols]
    mw = " ".join(f"WHEN MTRANS = {q(k)} THEN {v}" for k, v in MTRANS_ACTIVITY.items())
    cols.append(f"CAST(CASE {mw} END AS DOUBLE) AS MTRANS")
    tw = " ".join(f"WHEN Obesity = {q(c)} THEN {i}" for i, c in enumerate(S.class_order))
    cols.append(f"CAST(CASE {tw} END AS DOUBLE) AS Obesity_Ordinal")
    return f"xenc AS (SELECT id, {', '.join(cols)} FROM {src})"
