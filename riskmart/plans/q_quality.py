"""Catalogue entries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.operators import quality as Q
from riskmart.plans.registry import query
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A
from riskmart.sources.tables import MIN_ROWS


def _nullfrac_sql(table: str) -> str:
    cols = A.adapter_columns(table)
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_fraction "
        f"FROM {table}" for i, c in enumerate(cols))


def _maxnull_sql(table: str) -> str:
    cols = A.adapter_columns(table)
    parts = [f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)" for c in cols]
    return parts[0] if len(parts) == 1 else f"greatest({', '.join(parts)})"


_MINROWS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {MIN_ROWS[t]} AS min_rows, "
    f"CASE WHEN count(*) >= {MIN_ROWS[t]} THEN 1 ELSE 0 END AS passed FROM {t}" for t in A.LOAN_TABLES)


@query("validate_min_rows", norm_sql(_MINROWS_SQL, ints=["n_rows", "min_rows", "passed"], strs=["table_name"],
                                     prefix=A.cte(*A.LOAN_TABLES)))
def validate_min_rows(spark, sf_dir):
    tables = A.loan_tables(spark, sf_dir)
    rep = Q.validation_report(tables).where(F.col("check_name") == "min_rows")
    return tidy(rep.select("table_name", F.col("observed").cast("long").alias("n_rows"),
                           F.col("expected").cast("long").alias("min_rows"), "passed"))


@query("null_fractions", norm_sql(_nullfrac_sql("application"), ints=["position"], strs=["column_name"],
                                  dbls=["null_fraction"], prefix=A.cte("application")))
def null_fractions(spark, sf_dir):
    return tidy(Q.null_fractions(A.adapter(spark, sf_dir, "application")))


@query("worst_null_column", norm_sql(
    f"SELECT column_name, null_fraction, CASE WHEN null_fraction > {Q.NULL_WARN_LEVEL} THEN 1 ELSE 0 END AS warn "
    f"FROM ({_nullfrac_sql('application')}) f ORDER BY null_fraction DESC, position ASC LIMIT 1",
    ints=["warn"], strs=["column_name"], dbls=["null_fraction"], prefix=A.cte("application")))
def worst_null_column(spark, sf_dir):
    return tidy(Q.worst_null_column(A.adapter(spark, sf_dir, "application")))


@query("target_check", norm_sql(
    "SELECT count(DISTINCT TARGET) AS n_distinct, CASE WHEN count(DISTINCT TARGET) >= 2 THEN 1 ELSE 0 END AS passed "
    "FROM application", ints=["n_distinct", "passed"], prefix=A.cte("application")))
def target_check(spark, sf_dir):
    rep = Q.validation_report({"application": A.adapter(spark, sf_dir, "application")})
    rep = rep.where(F.col("check_name") == "target_distinct")
    return tidy(rep.select(F.col("observed").cast("long").alias("n_distinct"), "passed"))


@query("xna_count", norm_sql("SELECT count_if(CODE_GENDER = 'XNA') AS xna_rows FROM application",
                             ints=["xna_rows"], prefix=A.cte("application")))
def xna_count(spark, sf_dir):
    app = A.adapter(spark, sf_dir, "application")
    return tidy(app.agg(F.count_if(F.col("CODE_GENDER") == "XNA").alias("xna_rows")))


def _report_sql() -> str:
    parts = []
    for t in A.LOAN_TABLES:
        parts.append(f"SELECT '{t}' AS table_name, 'required_columns' AS check_name, 'error' AS severity, 0e0 AS observed, "
                     f"0e0 AS expected, 1 AS passed")
        parts.append(f"SELECT '{t}', 'min_rows', 'error', CAST(count(*) AS DOUBLE), {float(MIN_ROWS[t])!r}, "
                     f"CASE WHEN count(*) >= {MIN_ROWS[t]} THEN 1 ELSE 0 END FROM {t}")
        parts.append(f"SELECT '{t}', 'max_null_fraction', 'warning', {_maxnull_sql(t)}, {Q.NULL_WARN_LEVEL!r}, "
                     f"CASE WHEN {_maxnull_sql(t)} <= {Q.NULL_WARN_LEVEL!r} THEN 1 ELSE 0 END FROM {t}")
    parts.append("SELECT 'application', 'target_distinct', 'error', CAST(count(DISTINCT TARGET) AS DOUBLE), 2e0, "
                 "CASE WHEN count(DISTINCT TARGET) >= 2 THEN 1 ELSE 0 END FROM application")
    parts.append("SELECT 'application', 'xna_rows', 'info', CAST(count_if(CODE_GENDER = 'XNA') AS DOUBLE), 0e0, 1 "
                 "FROM application")
    return " UNION ALL ".join(parts)


@query("validation_report", norm_sql(_report_sql(), ints=["passed"], strs=["table_name", "check_name", "severity"],
                                     dbls=["observed", "expected"], prefix=A.cte(*A.LOAN_TABLES)))
def validation_report(spark, sf_dir):
    return tidy(Q.validation_report(A.loan_tables(spark, sf_dir)))


def _constraints_sql() -> str:
    checks = []
    for name, lo, hi, default in Q.NUMERIC_RULES:
        v = name if default is None else f"coalesce({name}, {float(default)!r})"
        checks.append(f"CASE WHEN {v} IS NULL THEN '{name}: missing' WHEN {v} < {lo!r} OR {v} > {hi!r} "
                      f"THEN '{name}: out of range' END")
    for name, allowed, default in Q.ENUM_RULES:
        vals = ", ".join(f"'{a}'" for a in allowed)
        checks.append(f"CASE WHEN NOT (coalesce({name}, '{default}') IN ({vals})) THEN '{name}: not allowed' END")
    n = " + ".join(f"(CASE WHEN ({c}) IS NULL THEN 0 ELSE 1 END)" for c in checks)
    return (f"SELECT id, coalesce(ext_source_2, 5e-1) AS ext_source_2, coalesce(code_gender, 'F') AS code_gender, "
            f"{n} AS n_reasons, concat_ws('; ', {', '.join(checks)}) AS reasons, "
            f"CASE WHEN {n} = 0 THEN 1 ELSE 0 END AS is_valid FROM requests")


@query("row_constraints", norm_sql(_constraints_sql(), ints=["id", "n_reasons", "is_valid"],
                                   strs=["code_gender", "reasons"], dbls=["ext_source_2"], prefix=A.cte("requests")))
def row_constraints(spark, sf_dir):
    checked = Q.row_constraints(A.adapter(spark, sf_dir, "requests"))
    return tidy(checked.select("id", "ext_source_2", "code_gender", "n_reasons", "reasons", "is_valid"))


@query("rejected_rows", norm_sql(f"SELECT id, n_reasons, reasons FROM ({_constraints_sql()}) c WHERE is_valid = 0",
                                 ints=["id", "n_reasons"], strs=["reasons"], prefix=A.cte("requests")))
def rejected_rows(spark, sf_dir):
    _, rejected = Q.split_valid(A.adapter(spark, sf_dir, "requests"))
    return tidy(rejected.select("id", "n_reasons", "reasons"))
