"""Readers, writers and the table catalogue of the seven loan tables (S-IN-*, S-OUT-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference): file name of each table in a raw CSV folder.
RAW_FILES = {
    "application": "application_train.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous": "previous_application.csv",
    "installments": "installments_payments.csv",
    "pos_cash": "POS_CASH_balance.csv",
    "credit_card": "credit_card_balance.csv",
}

# Fixed values (must equal the reference): minimum column list per table.
REQUIRED_COLUMNS = {
    "application": ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
                    "DAYS_BIRTH", "DAYS_EMPLOYED", "EXT_SOURCE_2", "EXT_SOURCE_3", "CODE_GENDER"],
    "bureau": ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "AMT_CREDIT_SUM",
               "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "CREDIT_DAY_OVERDUE"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"],
    "previous": ["SK_ID_CURR", "SK_ID_PREV", "NAME_CONTRACT_STATUS", "AMT_CREDIT",
                 "AMT_ANNUITY", "DAYS_DECISION"],
    "installments": ["SK_ID_CURR", "SK_ID_PREV", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT",
                     "AMT_INSTALMENT", "AMT_PAYMENT"],
    "pos_cash": ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF",
                 "NAME_CONTRACT_STATUS"],
    "credit_card": ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", "AMT_BALANCE",
                    "AMT_CREDIT_LIMIT_ACTUAL", "SK_DPD", "SK_DPD_DEF"],
}

# Fixed values (must equal the reference): minimum row count per table (full data set).
MIN_ROWS = {
    "application": 300_000,
    "bureau": 1_000_000,
    "bureau_balance": 10_000_000,
    "previous": 1_000_000,
    "installments": 5_000_000,
    "pos_cash": 5_000_000,
    "credit_card": 1_000_000,
}

# Extra text tokens that mean "missing" in the raw CSV files (pandas defaults); "XNA" is a value.
CSV_NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "#N/A", "-NaN", "-nan", "<NA>", "n/a"]

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Declared types of known columns, matched to a CSV header by name; a file with other columns is
# read with type inference and the declared columns are cast.
SCHEMAS = {
    "bureau": _schema(("SK_ID_CURR", _L), ("SK_ID_BUREAU", _L), ("CREDIT_ACTIVE", _S),
                      ("CREDIT_CURRENCY", _S), ("DAYS_CREDIT", _L), ("CREDIT_DAY_OVERDUE", _L),
                      ("DAYS_CREDIT_ENDDATE", _D), ("DAYS_ENDDATE_FACT", _D),
                      ("AMT_CREDIT_MAX_OVERDUE", _D), ("CNT_CREDIT_PROLONG", _L),
                      ("AMT_CREDIT_SUM", _D), ("AMT_CREDIT_SUM_DEBT", _D),
                      ("AMT_CREDIT_SUM_LIMIT", _D), ("AMT_CREDIT_SUM_OVERDUE", _D),
                      ("CREDIT_TYPE", _S), ("DAYS_CREDIT_UPDATE", _L), ("AMT_ANNUITY", _D)),
    "bureau_balance": _schema(("SK_ID_BUREAU", _L), ("MONTHS_BALANCE", _I), ("STATUS", _S)),
    "installments": _schema(("SK_ID_PREV", _L), ("SK_ID_CURR", _L), ("NUM_INSTALMENT_VERSION", _D),
                            ("NUM_INSTALMENT_NUMBER", _D), ("DAYS_INSTALMENT", _D),
                            ("DAYS_ENTRY_PAYMENT", _D), ("AMT_INSTALMENT", _D), ("AMT_PAYMENT", _D)),
    "pos_cash": _schema(("SK_ID_PREV", _L), ("SK_ID_CURR", _L), ("MONTHS_BALANCE", _I),
                        ("CNT_INSTALMENT", _D), ("CNT_INSTALMENT_FUTURE", _D),
                        ("NAME_CONTRACT_STATUS", _S), ("SK_DPD", _I), ("SK_DPD_DEF", _I)),
}


class MissingTableError(FileNotFoundError):
    """Raised before any Spark job when an input table does not exist."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (NaN is the reference's only missing marker).

    Spark orders NaN above every number, so ``NaN > 0`` would be true and max/avg would return NaN;
    the reference skips NaN. One projection, no job.
    """
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs) if changed else df


def null_text_tokens(df: DataFrame, tokens=CSV_NULL_TOKENS) -> DataFrame:
    """Map the CSV missing tokens to NULL in string columns (Spark keeps them as text)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            exprs.append(F.when(F.col(f.name).isin(tokens), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S-IN-1: one CSV with header; declared types are matched to the header *by name*.

    When every header column has a declared type the file is read with that schema in header order
    (no inference pass). Otherwise types are inferred and the declared columns are cast to their
    declared types. Missing-value tokens become NULL in text and NaN becomes NULL in numbers."""
    if not _exists(spark, path):
        raise MissingTableError(f"Expected data file not found: {path}")
    base = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    declared = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    header = base.csv(path).columns  # header line only; no data pass
    if declared and all(c in declared for c in header):
        ordered = T.StructType([T.StructField(c, declared[c], True) for c in header])
        df = base.schema(ordered).option("enforceSchema", True).csv(path)
    else:
        df = base.option("inferSchema", True).csv(path)
        if declared:
            df = df.select(*[F.col(f"`{c}`").cast(declared[c]).alias(c) if c in declared else F.col(f"`{c}`")
                             for c in df.columns])
    return nan_to_null(null_text_tokens(df))


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise MissingTableError(f"Expected data file not found: {path}")
    return nan_to_null(spark.read.parquet(path))


def load_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """S-IN-2: one named loan table from ``folder`` (parquet ``<name>.parquet`` or the raw CSV name)."""
    folder = folder.rstrip("/")
    if fmt == "csv":
        return read_csv_table(spark, f"{folder}/{RAW_FILES[name]}", schema or SCHEMAS.get(name))
    return read_parquet_table(spark, f"{folder}/{name}.parquet")


def load_all(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """S-IN-3: all seven tables as lazy DataFrames (missing files fail here, before any job)."""
    return {name: load_table(spark, folder, name, fmt) for name in RAW_FILES}


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one DataFrame: a union of one global count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """S-OUT-1/2: write a result table (parquet by default, csv with header optional)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path)
