"""S1/S2 sources: the survey view over the driver tables, CSV and record input.

All readers give the same shape: ``id STRING`` plus the spec's 17 columns,
doubles for numeric columns with NaN normalised to NULL once at ingest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null
from ..spec import OBESITY, SurveySpec

# FIXED VALUES — the survey projection of ``lineitem`` (FIXTURES §3); valid in Spark SQL and DuckDB.
FIXTURE_CTES = """k AS (
  SELECT concat_ws('-', CAST(CAST(l_orderkey AS BIGINT) AS VARCHAR(20)), CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR(20)),
                   CAST(CAST(l_partkey AS BIGINT) AS VARCHAR(20)), CAST(CAST(l_suppkey AS BIGINT) AS VARCHAR(20)),
                   CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20))) AS id,
         CAST(l_orderkey AS BIGINT) AS o, CAST(l_partkey AS BIGINT) AS p,
         CAST(l_suppkey AS BIGINT) AS s, CAST(l_linenumber AS BIGINT) AS n,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem),
g AS (
  SELECT *, CAST(150 + (o * 31 + s * 17 + q * 3) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) AS bmi0,
         CAST(145 + p % 54 AS DOUBLE) / CAST(100 AS DOUBLE) AS h,
         (o * 13 + p * 7 + n * 5) % 1000 AS r
  FROM k),
b AS (
  SELECT id, (o * 29 + p * 23 + s * 19 + n * 11 + q) % 89 AS twice,
    CASE WHEN (p + n) % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
    CASE WHEN r = 17 THEN CAST(5 AS DOUBLE) ELSE CAST(140 + (p * 7 + o) % 480 AS DOUBLE) / CAST(10 AS DOUBLE) END AS Age,
    h AS Height,
    CASE WHEN r IN (29, 31) THEN NULL ELSE bmi0 * h * h END AS Weight,
    CASE WHEN bmi0 >= CAST(25 AS DOUBLE) OR r % 4 = 0 THEN 'yes' ELSE 'no' END AS family_history,
    CASE WHEN r % 53 = 0 THEN ' YES ' WHEN r % 9 = 0 THEN 'no' ELSE 'yes' END AS FAVC,
    CAST((o + q) % 7 AS DOUBLE) / CAST(2 AS DOUBLE) AS FCVC,
    CAST(2 + (p + s) % 7 AS DOUBLE) / CAST(2 AS DOUBLE) AS NCP,
    CASE r % 10 WHEN 0 THEN 'no' WHEN 1 THEN 'Always' WHEN 2 THEN 'Frequently' WHEN 3 THEN 'frequently' ELSE 'Sometimes' END AS CAEC,
    CASE WHEN r % 47 = 0 THEN 'yes' ELSE 'no' END AS SMOKE,
    CAST((s + n) % 7 AS DOUBLE) / CAST(2 AS DOUBLE) AS CH2O,
    CASE WHEN r % 21 = 0 THEN 'yes' ELSE 'no' END AS SCC,
    CAST((o * 3 + n) % 7 AS DOUBLE) / CAST(2 AS DOUBLE) AS FAF,
    CAST((p * 5 + q) % 5 AS DOUBLE) / CAST(2 AS DOUBLE) AS TUE,
    CASE WHEN r % 101 = 0 THEN NULL WHEN r % 3 = 0 THEN 'no' WHEN r % 13 = 0 THEN 'Frequently' WHEN r % 89 = 0 THEN 'Always' ELSE 'Sometimes' END AS CALC,
    CASE WHEN r = 71 THEN 'Rocket' WHEN r % 4 = 0 THEN 'Automobile' WHEN r % 37 = 0 THEN 'Bike' WHEN r % 41 = 0 THEN 'Motorbike' WHEN r % 19 = 0 THEN 'Walking' ELSE 'Public_Transportation' END AS MTRANS,
    CASE WHEN bmi0 < CAST(18.5 AS DOUBLE) THEN 'Insufficient_Weight' WHEN bmi0 < CAST(25 AS DOUBLE) THEN 'Normal_Weight'
         WHEN bmi0 < CAST(27 AS DOUBLE) THEN 'Overweight_Level_I' WHEN bmi0 < CAST(30 AS DOUBLE) THEN 'Overweight_Level_II'
         WHEN bmi0 < CAST(35 AS DOUBLE) THEN 'Obesity_Type_I' WHEN bmi0 < CAST(40 AS DOUBLE) THEN 'Obesity_Type_II'
         ELSE 'Obesity_Type_III' END AS Obesity
  FROM g)"""
FIXTURE_COLUMNS = ", ".join([OBESITY.id_col, *OBESITY.columns])
FIXTURE_SELECT = f"SELECT {FIXTURE_COLUMNS} FROM b UNION ALL SELECT {FIXTURE_COLUMNS} FROM b WHERE twice = 0"
# the same rows from one scan
FIXTURE_SPARK_SELECT = (f"SELECT {FIXTURE_COLUMNS} FROM b LATERAL VIEW explode("
                        "CASE WHEN twice = 0 THEN array(1, 2) ELSE array(1) END) copies AS copy")

# pandas' default missing-value tokens (public pandas documentation), applied to every CSV field
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def survey_raw(spark: SparkSession, sf_dir: str, spec: SurveySpec = OBESITY) -> DataFrame:
    """The 17-column survey view derived from ``lineitem`` (scan → project; no shuffle)."""
    lineitem = table(spark, sf_dir, "lineitem")
    df = spark.sql(f"WITH {FIXTURE_CTES.replace('FROM lineitem', 'FROM {lineitem}')} {FIXTURE_SPARK_SELECT}",
                   lineitem=lineitem)
    return normalize_missing(df, spec)


def normalize_missing(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """NaN → NULL in numeric columns (Spark aggregates skip NULL but not NaN)."""
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in spec.numeric_cols if c in df.columns})


def survey_schema(spec: SurveySpec = OBESITY, with_id: bool = True, as_text: bool = False) -> T.StructType:
    fields = [T.StructField(spec.id_col, T.StringType())] if with_id else []
    for c in spec.columns:
        num = c in spec.numeric_ranges
        fields.append(T.StructField(c, T.StringType() if as_text or not num else T.DoubleType()))
    return T.StructType(fields)


def read_survey_csv(spark: SparkSession, path: str, spec: SurveySpec = OBESITY, with_id: bool = True) -> DataFrame:
    """Header CSV → typed survey frame. Columns are taken by their header name, in any order; a
    column the file lacks is absent from the result, so that V1 can report it, and columns outside
    the spec are dropped. Fields are read as text so every pandas NA token (not just one
    ``nullValue``) becomes NULL; numbers then go through ``try_cast``.

    A file without an id column gets one if ``with_id``: a digest of the row's fields and the
    number of the copy among equal rows, which does not depend on how the file is split.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    wanted = ([spec.id_col] if with_id else []) + list(spec.columns)
    present = [c for c in wanted if c in raw.columns]
    out = []
    for name in present:
        c = F.col(f"`{name}`")
        text = F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c)
        if name in spec.numeric_ranges:
            num = nan_to_null(F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)"))
            text = F.when(text.isNull(), F.lit(None).cast("double")).otherwise(num)
        out.append(text.alias(name))
    df = raw.select(*out)
    return assign_id(df, spec) if with_id and spec.id_col not in present else df


def assign_id(df: DataFrame, spec: SurveySpec = OBESITY) -> DataFrame:
    """Adds an id to rows that have none: digest of the values, then the number of the copy.

    Equal rows are counted before they are numbered, so a row that is repeated many times is
    never gathered in one task: ``explode`` numbers the copies of one aggregated row.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    key = F.concat_ws("-", F.md5(F.concat_ws("\u0001", *fields)), F.col("_i").cast("string"))
    return numbered.select(key.alias(spec.id_col), *df.columns)


def records(spark: SparkSession, rows: list, spec: SurveySpec = OBESITY) -> DataFrame:
    """A list of record dicts (for example one form submission) → frame with the input schema."""
    fields = [T.StructField(spec.id_col, T.StringType())] + [
        T.StructField(c, T.DoubleType() if c in spec.numeric_ranges else T.StringType()) for c in spec.input_cols]
    schema = T.StructType(fields)
    text = lambda f, v: str(v) if f.name == spec.id_col and v is not None else v
    data = [tuple(text(f, r.get(f.name)) for f in fields) for r in rows]
    return spark.createDataFrame(data, schema)

