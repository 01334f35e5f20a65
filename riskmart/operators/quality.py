"""Data-quality checks: table validation report and per-record constraints.

Table checks run as one aggregate per table (row count, null fraction of every column, and for
the application table the distinct TARGET values and the XNA count in the same pass). Results are
a small report DataFrame ``(table_name, check_name, severity, observed, expected, passed)``; the
driver raises once, after all checks, if any error-level check failed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources.tables import MIN_ROWS, REQUIRED_COLUMNS

# Fixed values (must equal the reference): null-fraction warning level.
NULL_WARN_LEVEL = 0.95

REPORT_SCHEMA = ("table_name string, check_name string, severity string, observed double, "
                 "expected double, passed int")


class ValidationError(ValueError):
    """Raised once with every failed error-level check."""


def missing_columns(df: DataFrame, table: str) -> list[str]:
    """V-1: required columns absent from ``df`` (schema only, no job)."""
    return [c for c in REQUIRED_COLUMNS.get(table, []) if c not in df.columns]


def null_fraction_exprs(df: DataFrame) -> list[Column]:
    return [F.avg(F.when(F.col(f"`{c}`").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias(c) for c in df.columns]


def null_fractions(df: DataFrame) -> DataFrame:
    """V-3: null fraction per column as a long table ``(position, column_name, null_fraction)``.

    One global aggregate (partial aggregation per task, one row to merge), then ``unpivot``.
    """
    wide = df.agg(*null_fraction_exprs(df))
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_fraction"))
        for i, c in enumerate(df.columns)])).alias("r"))
    return stacked.select("r.*")


def worst_null_column(df: DataFrame) -> DataFrame:
    """Column with the largest null fraction (first in column order on ties) and the warning flag."""
    fr = null_fractions(df)
    best = fr.agg(F.max_by(F.struct("column_name", "null_fraction"),
                           F.struct(F.col("null_fraction"), -F.col("position"))).alias("w"))
    return best.select(F.col("w.column_name").alias("column_name"), F.col("w.null_fraction").alias("null_fraction"),
                       (F.col("w.null_fraction") > NULL_WARN_LEVEL).cast("int").alias("warn"))


def _table_checks(df: DataFrame, table: str) -> DataFrame:
    """All data checks of one table from a single aggregate pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    nf = [F.avg(F.when(F.col(f"`{c}`").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))) for c in df.columns]
    aggs.append((reduce(lambda a, b: F.greatest(a, b), nf) if len(nf) > 1 else nf[0]).alias("_maxnull"))
    is_app = table == "application"
    if is_app and "TARGET" in df.columns:
        aggs.append(F.countDistinct("TARGET").alias("_tdist"))
    if is_app and "CODE_GENDER" in df.columns:
        aggs.append(F.count_if(F.col("CODE_GENDER") == "XNA").alias("_xna"))
    row = df.agg(*aggs)
    rows = [
        F.struct(F.lit("min_rows").alias("check_name"), F.lit("error").alias("severity"),
                 F.col("_n").cast("double").alias("observed"), F.lit(float(MIN_ROWS.get(table, 0))).alias("expected"),
                 (F.col("_n") >= MIN_ROWS.get(table, 0)).cast("int").alias("passed")),
        F.struct(F.lit("max_null_fraction").alias("check_name"), F.lit("warning").alias("severity"),
                 F.col("_maxnull").alias("observed"), F.lit(NULL_WARN_LEVEL).alias("expected"),
                 F.coalesce((F.col("_maxnull") <= NULL_WARN_LEVEL).cast("int"), F.lit(1)).alias("passed")),
    ]
    if is_app and "TARGET" in df.columns:
        rows.append(F.struct(F.lit("target_distinct").alias("check_name"), F.lit("error").alias("severity"),
                             F.col("_tdist").cast("double").alias("observed"), F.lit(2.0).alias("expected"),
                             (F.col("_tdist") >= 2).cast("int").alias("passed")))
    if is_app and "CODE_GENDER" in df.columns:
        rows.append(F.struct(F.lit("xna_rows").alias("check_name"), F.lit("info").alias("severity"),
                             F.col("_xna").cast("double").alias("observed"), F.lit(0.0).alias("expected"),
                             F.lit(1).alias("passed")))
    return row.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows)))


def validation_report(tables: dict[str, DataFrame]) -> DataFrame:
    """V-6: every check of every table as one report DataFrame."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    schema_rows = []
    for name, df in tables.items():
        miss = missing_columns(df, name)
        schema_rows.append((name, "required_columns", "error", float(len(miss)), 0.0, int(not miss)))
    if "application" in tables and "TARGET" not in tables["application"].columns:
        schema_rows.append(("application", "target_present", "error", 0.0, 1.0, 0))
    parts = [spark.createDataFrame(schema_rows, REPORT_SCHEMA)]
    parts += [_table_checks(df, name) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def validate_tables(tables: dict[str, DataFrame], raise_on_error: bool = True) -> DataFrame:
    """Run the report; raise one :class:`ValidationError` listing every failed error check."""
    report = validation_report(tables).cache()
    failed = report.where((F.col("severity") == "error") & (F.col("passed") == 0)).collect()
    if failed and raise_on_error:
        lines = [f"  - {r.table_name}: {r.check_name} observed {r.observed:g}, expected {r.expected:g}" for r in failed]
        raise ValidationError("Data validation failed:\n" + "\n".join(lines))
    return report


# ---------------------------------------------------------------------------
# V-7: per-record constraints on scoring requests
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference): request field ranges, enums and defaults.
NUMERIC_RULES = [
    # field, lower, upper, default (None = required)
    ("amt_income_total", 10_000.0, 100_000_000.0, None),
    ("amt_credit", 10_000.0, 10_000_000.0, None),
    ("amt_annuity", 1_000.0, 1_000_000.0, None),
    ("ext_source_2", 0.0, 1.0, 0.5),
    ("ext_source_3", 0.0, 1.0, 0.5),
    ("age_years", 18.0, 100.0, None),
    ("employed_years", 0.0, 60.0, 0.0),
]
ENUM_RULES = [
    ("code_gender", ["F", "M"], "F"),
    ("name_income_type", ["Commercial associate", "Pensioner", "State servant", "Unemployed", "Working"], "Working"),
    ("name_education_type", ["Academic degree", "Higher education", "Incomplete higher", "Lower secondary",
                             "Secondary / secondary special"], "Higher education"),
    ("name_family_status", ["Civil marriage", "Married", "Separated", "Single / not married", "Widow"], "Married"),
    ("name_housing_type", ["Co-op apartment", "House / apartment", "Municipal apartment", "Office apartment",
                           "Rented apartment", "With parents"], "House / apartment"),
]


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill optional request fields with their defaults (absent columns are added)."""
    cols = set(requests.columns)
    out = requests
    for name, _, _, default in NUMERIC_RULES:
        if default is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default))
    for name, _, default in ENUM_RULES:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default))
    return out


def row_constraints(requests: DataFrame) -> DataFrame:
    """Add ``n_reasons``, ``reasons`` (text, '; '-separated) and ``is_valid`` to every request row."""
    df = with_defaults(requests)
    checks = []
    for name, lo, hi, _ in NUMERIC_RULES:
        if name not in df.columns:
            checks.append(F.lit(f"{name}: missing"))
            continue
        c = F.col(name)
        checks.append(F.when(c.isNull(), F.lit(f"{name}: missing"))
                      .when((c < lo) | (c > hi), F.lit(f"{name}: out of range")))
    for name, allowed, _ in ENUM_RULES:
        checks.append(F.when(~F.col(name).isin(allowed), F.lit(f"{name}: not allowed")))
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in checks])
    return df.select("*", n.alias("n_reasons"), F.concat_ws("; ", *checks).alias("reasons")).withColumn(
        "is_valid", (F.col("n_reasons") == 0).cast("int"))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons) from one constraint projection."""
    checked = row_constraints(requests)
    return checked.where(F.col("is_valid") == 1), checked.where(F.col("is_valid") == 0)
