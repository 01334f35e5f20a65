"""Adapter views that shape the driver's TPC-H-like tables into the seven loan tables.

The same SQL text runs in Spark SQL and in DuckDB (double literals are written in exponent form so
both engines type them as DOUBLE). Oracle queries embed these statements as CTEs; the Spark side
binds the parquet scans as DataFrame arguments of ``spark.sql``, so column pruning and filter
pushdown still reach the parquet reader and no session view is created.

The modulo conditions below shape values (NULLs, sentinels, zero denominators); every view keeps every row
of its table. Applicants without a kind of history come about by NULL keys, never by dropped rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("customer", "orders", "lineitem", "events")

ADAPTER_SQL: dict[str, str] = {
    "application": """
SELECT c_custkey AS SK_ID_CURR, CASE WHEN c_custkey % 12 = 0 THEN 1 ELSE 0 END AS TARGET,
 CASE WHEN c_custkey % 97 = 0 THEN 'XNA' WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
 (c_acctbal + 1e3) * 2e1 AS AMT_INCOME_TOTAL, 5e4 + (c_custkey % 400) * 2.5e3 AS AMT_CREDIT,
 CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE 2.5e3 + (c_custkey % 90) * 5e2 END AS AMT_ANNUITY,
 CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE 4.5e4 + (c_custkey % 400) * 2.25e3 END AS AMT_GOODS_PRICE,
 -(7500 + (c_custkey * 37) % 17500) AS DAYS_BIRTH,
 CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 13) % 9000) END AS DAYS_EMPLOYED,
 -((c_custkey * 7) % 12000) AS DAYS_REGISTRATION, -((c_custkey * 11) % 6000) AS DAYS_ID_PUBLISH,
 CASE WHEN c_custkey % 9 < 5 THEN NULL ELSE ((c_custkey * 17) % 1000) / 1e3 END AS EXT_SOURCE_1,
 CASE WHEN c_custkey % 331 = 0 THEN NULL ELSE ((c_custkey * 29) % 1000) / 1e3 END AS EXT_SOURCE_2,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ((c_custkey * 43) % 1000) / 1e3 END AS EXT_SOURCE_3,
 CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_2, CASE WHEN c_custkey % 4 <> 0 THEN 1 ELSE 0 END AS FLAG_DOCUMENT_3,
 1 AS FLAG_MOBIL, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 1 END AS FLAG_EMP_PHONE, CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS FLAG_EMAIL,
 CASE WHEN c_custkey % 3 = 1 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR, CASE WHEN c_custkey % 10 < 7 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
 CASE WHEN c_custkey % 13 < 4 THEN NULL ELSE c_mktsegment END AS OCCUPATION_TYPE FROM customer
""",
    "bureau": """
SELECT CASE WHEN o_custkey % 7 <> 3 THEN o_custkey END AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
 CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderkey % 2 = 0 THEN 'Bad debt' ELSE 'Sold' END AS CREDIT_ACTIVE,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_totalprice END AS AMT_CREDIT_SUM,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice * ((o_orderkey % 10) / 1e1) END AS AMT_CREDIT_SUM_DEBT,
 CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 1e-2 ELSE 0e0 END AS AMT_CREDIT_SUM_OVERDUE,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 1.5e0 END AS AMT_CREDIT_SUM_LIMIT,
 CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice * 2e-2 END AS AMT_CREDIT_MAX_OVERDUE,
 CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey % 60 ELSE 0 END AS CREDIT_DAY_OVERDUE,
 -((o_orderkey * 19) % 2900 + 1) AS DAYS_CREDIT, CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE (o_orderkey * 23) % 4000 - 2000 END AS DAYS_CREDIT_ENDDATE,
 CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 0 END AS CNT_CREDIT_PROLONG FROM orders
""",
    "bureau_balance": """
SELECT CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey END AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE,
 CASE CAST(l_quantity AS INT) % 10 WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' WHEN 5 THEN '5' WHEN 6 THEN 'C' WHEN 7 THEN 'X' ELSE '0' END AS STATUS
 FROM lineitem
""",
    "previous": """
SELECT CASE WHEN o_custkey % 5 <> 1 THEN o_custkey END AS SK_ID_CURR, o_orderkey AS SK_ID_PREV,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Approved' WHEN o_orderpriority = '3-MEDIUM' THEN 'Refused' WHEN o_orderpriority = '5-LOW' THEN 'Unused offer' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
 CASE o_orderkey % 4 WHEN 0 THEN 'Consumer loans' WHEN 1 THEN 'Cash loans' WHEN 2 THEN 'Revolving loans' ELSE 'XNA' END AS NAME_CONTRACT_TYPE,
 o_totalprice AS AMT_CREDIT, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_totalprice / 1.2e1 END AS AMT_ANNUITY,
 o_totalprice * (8e-1 + (o_orderkey % 5) / 1e1) AS AMT_APPLICATION,
 CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey % 40) / 1e2 END AS RATE_DOWN_PAYMENT,
 CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 6 * (o_orderkey % 8 + 1) END AS CNT_PAYMENT,
 -((o_orderkey * 31) % 2900 + 1) AS DAYS_DECISION FROM orders
""",
    "installments": """
SELECT CASE WHEN o_custkey % 5 <> 1 THEN o_custkey END AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, l_linenumber % 3 AS NUM_INSTALMENT_VERSION, l_linenumber AS NUM_INSTALMENT_NUMBER,
 -((l_orderkey * 5 + l_linenumber * 30) % 2900) AS DAYS_INSTALMENT,
 CASE WHEN l_partkey % 200 = 0 THEN NULL WHEN l_partkey % 500 = 1 THEN -((l_orderkey * 5 + l_linenumber * 30) % 2900) + 900 ELSE -((l_orderkey * 5 + l_linenumber * 30) % 2900) + (l_partkey % 21 - 14) END AS DAYS_ENTRY_PAYMENT,
 l_extendedprice / 1e1 AS AMT_INSTALMENT, CASE WHEN l_partkey % 200 = 0 THEN NULL ELSE l_extendedprice * (1e0 - l_discount) / 1e1 END AS AMT_PAYMENT
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "pos_cash": """
SELECT CASE WHEN event_id % 2 = 0 THEN user_id END AS SK_ID_CURR, user_id * 10 + event_id % 4 AS SK_ID_PREV, -(event_id % 48) AS MONTHS_BALANCE,
 CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Demand' WHEN 'signup' THEN 'Signed' ELSE 'Active' END AS NAME_CONTRACT_STATUS,
 CASE WHEN value > 1e2 THEN CAST(floor(value) AS INT) - 100 ELSE 0 END AS SK_DPD, CASE WHEN value > 2e2 THEN CAST(floor(value) AS INT) - 200 ELSE 0 END AS SK_DPD_DEF,
 CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 24 END AS CNT_INSTALMENT_FUTURE FROM events
""",
    "credit_card": """
SELECT CASE WHEN event_id % 2 = 1 AND user_id % 3 <> 0 THEN user_id END AS SK_ID_CURR, user_id * 10 + event_id % 2 AS SK_ID_PREV, -(event_id % 96) AS MONTHS_BALANCE,
 CASE WHEN event_id % 41 = 0 THEN -1e0 WHEN event_id % 43 = 0 THEN 0e0 ELSE value * 1e3 END AS AMT_BALANCE,
 CASE WHEN event_id % 29 = 0 THEN 0e0 ELSE 5e4 + (user_id % 10) * 1e4 END AS AMT_CREDIT_LIMIT_ACTUAL,
 CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'error' THEN value * 5e1 ELSE 0e0 END AS AMT_DRAWINGS_ATM_CURRENT,
 value * 1e2 AS AMT_DRAWINGS_CURRENT, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 2e1 END AS AMT_INST_MIN_REGULARITY,
 CASE WHEN event_id % 123 = 0 THEN 0e0 ELSE (event_id % 100) * 1e2 END AS AMT_PAYMENT_TOTAL_CURRENT,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS CNT_DRAWINGS_ATM_CURRENT,
 CASE WHEN value > 1.5e2 THEN CAST(floor(value) AS INT) - 150 ELSE 0 END AS SK_DPD, CASE WHEN value > 2.5e2 THEN 1 ELSE 0 END AS SK_DPD_DEF FROM events
""",
    "scored_events": """
SELECT event_id AS id, CASE WHEN event_type = 'error' OR value > 2e2 THEN 1 ELSE 0 END AS label,
 round(1e0 - exp(-value / 1e2), 2) AS score FROM events
""",
    # Scoring requests (one per applicant) derived from the application view: amounts and scores as
    # they are, whole years of age, tenure 0 for the employment sentinel, categories by id modulo
    # the enum length.
    "requests": """
SELECT SK_ID_CURR AS id, AMT_INCOME_TOTAL AS amt_income_total, AMT_CREDIT AS amt_credit, AMT_ANNUITY AS amt_annuity,
 EXT_SOURCE_2 AS ext_source_2, EXT_SOURCE_3 AS ext_source_3, CAST(floor(-DAYS_BIRTH / 365e0) AS INT) AS age_years,
 CASE WHEN DAYS_EMPLOYED = 365243 THEN 0e0 ELSE -DAYS_EMPLOYED / 365e0 END AS employed_years, CODE_GENDER AS code_gender,
 CASE SK_ID_CURR % 5 WHEN 0 THEN 'Commercial associate' WHEN 1 THEN 'Pensioner' WHEN 2 THEN 'State servant' WHEN 3 THEN 'Unemployed' ELSE 'Working' END AS name_income_type,
 CASE SK_ID_CURR % 5 WHEN 0 THEN 'Academic degree' WHEN 1 THEN 'Higher education' WHEN 2 THEN 'Incomplete higher' WHEN 3 THEN 'Lower secondary' ELSE 'Secondary / secondary special' END AS name_education_type,
 CASE SK_ID_CURR % 5 WHEN 0 THEN 'Civil marriage' WHEN 1 THEN 'Married' WHEN 2 THEN 'Separated' WHEN 3 THEN 'Single / not married' ELSE 'Widow' END AS name_family_status,
 CASE SK_ID_CURR % 6 WHEN 0 THEN 'Co-op apartment' WHEN 1 THEN 'House / apartment' WHEN 2 THEN 'Municipal apartment' WHEN 3 THEN 'Office apartment' WHEN 4 THEN 'Rented apartment' ELSE 'With parents' END AS name_housing_type
 FROM application
""",
}

# Adapters built on other adapters (registered as views first; emitted first in CTEs).
ADAPTER_DEPS = {"requests": ("application",)}

# Which base tables each adapter reads (others are not scanned).
ADAPTER_INPUTS = {
    "application": ("customer",),
    "bureau": ("orders",),
    "bureau_balance": ("lineitem",),
    "previous": ("orders",),
    "installments": ("lineitem", "orders"),
    "pos_cash": ("events",),
    "credit_card": ("events",),
    "scored_events": ("events",),
    "requests": ("customer",),
}

LOAN_TABLES = ("application", "bureau", "bureau_balance", "previous",
               "installments", "pos_cash", "credit_card")


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _parameterised(sql: str) -> str:
    """``FROM t`` / ``JOIN t`` -> ``FROM {t}`` so the statement binds DataFrames, not session views."""
    import re

    names = "|".join(list(BASE_TABLES) + list(ADAPTER_SQL))
    return re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 {\2}", sql)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a lazy DataFrame over the parquet files in ``sf_dir``.

    The SQL text is bound to DataFrame arguments (``spark.sql(text, **frames)``), so nothing is
    registered in the session catalog and two folders can be used side by side."""
    frames = {t: _base(spark, sf_dir, t) for t in ADAPTER_INPUTS[name]}
    for dep in ADAPTER_DEPS.get(name, ()):
        frames[dep] = adapter(spark, sf_dir, dep)
    return spark.sql(_parameterised(ADAPTER_SQL[name]), **frames)


def loan_tables(spark: SparkSession, sf_dir: str, names=LOAN_TABLES) -> dict[str, DataFrame]:
    return {n: adapter(spark, sf_dir, n) for n in names}


def cte(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH`` clause carrying the adapter statements (plus extra named statements) for oracle SQL."""
    ordered: list[str] = []
    for n in names:
        for dep in ADAPTER_DEPS.get(n, ()):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    parts = [f"{n} AS ({ADAPTER_SQL[n].strip()})" for n in ordered]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n"


def adapter_columns(name: str) -> list[str]:
    """Output column names of an adapter statement (from its ``AS name`` aliases)."""
    import re

    body = ADAPTER_SQL[name]
    names = re.findall(r"\bAS\s+([A-Za-z_][A-Za-z0-9_]*)", body)
    return [n for n in names if n.upper() not in ("INT", "BIGINT", "DOUBLE", "VARCHAR")]
