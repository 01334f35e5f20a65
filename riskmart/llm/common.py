"""Helpers shared by the operators: table readers, shared scratch folders, text normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.session import shared_path

#: The white space of the word contract, as a Java/Python character class body.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


#: Spark's setting by which a finished query removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. Nothing reads the
    shuffles of the write afterwards, so they go with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`stored` has written, once nothing reads them any more. Others are left alone."""
    for df in tables:
        if df is not None and (at := getattr(df, "stored_at", None)):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null, empty or blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANKS}]+", "")
    return F.filter(F.split(trimmed, f"[{BLANKS}]+"), lambda w: w != "")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Fingerprint of a row's id and text, bound to ``docs``: tells rows apart that have no id or repeat one."""
    return F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose :func:`row_key` is among the one column of ``keys``; any column names may clash."""
    gone = keys.toDF(f"gone_{uuid.uuid4().hex}")
    return docs.join(gone, row_key(docs) == gone[gone.columns[0]], "left_anti")
