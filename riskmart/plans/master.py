"""Master feature table: application features LEFT JOIN the five history packs (J-2, P-14).

Plan shape: every pack ends in a hash aggregate keyed by SK_ID_CURR, so its output is already
hash-partitioned on the join key; the joins are 1 : 0..1 (one row per applicant per block) and
never fan out. With the default shuffle settings Spark joins the blocks with sort-merge joins that
reuse that partitioning - only the application side is exchanged. AQE replaces a join by a
broadcast only when a block's *measured* size is under the broadcast threshold, so nothing whose
size grows with the data is broadcast unchecked.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.functions import expr as X
from riskmart.operators import packs as P
from riskmart.sources import tables as TB

KEY = P.KEY


def feature_blocks(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """The five per-applicant blocks, in the reference's join order."""
    return [
        P.bureau_features(tables["bureau"], tables["bureau_balance"]),
        P.previous_features(tables["previous"]),
        P.installment_features(tables["installments"]),
        P.pos_cash_features(tables["pos_cash"]),
        P.credit_card_features(tables["credit_card"]),
    ]


def zero_fill_prefix(df: DataFrame, prefixes=P.FEATURE_PREFIXES, value=0) -> DataFrame:
    """NULL -> 0 in every column whose name starts with one of ``prefixes`` (one projection)."""
    cols = X.prefixed(df.columns, prefixes)
    return df.fillna(value, subset=cols) if cols else df


def build_master(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per application row with all engineered features; no-history blocks zero-filled."""
    master = P.application_features(tables["application"])
    for block in feature_blocks(tables):
        master = master.join(block, KEY, "left")
    return zero_fill_prefix(master)


def no_history(application: DataFrame, history: DataFrame) -> DataFrame:
    """J-3: applicants without any row in ``history`` (LEFT ANTI join on the key).

    The history keys are de-duplicated first (partial aggregation in every map task), so an
    applicant with a huge share of the history rows contributes one row per task to the join."""
    keys = history.select(KEY).where(F.col(KEY).isNotNull()).distinct()
    return application.join(keys, KEY, "left_anti")


HISTORY_TABLES = ("bureau", "previous", "installments", "pos_cash", "credit_card")


def history_coverage(tables: dict[str, DataFrame], names=HISTORY_TABLES) -> DataFrame:
    """Per history table: applicants with and without history (one small row per table).

    One pass: the keys of all history tables are tagged and unioned, reduced to one row per
    applicant with a presence flag per table (partial aggregation first, so a hot applicant is
    combined map-side), joined once to the application keys, and counted."""
    tagged = None
    for i, name in enumerate(names):
        part = tables[name].select(KEY, F.lit(i).alias("_t")).where(F.col(KEY).isNotNull())
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(KEY).agg(*[F.max(F.when(F.col("_t") == i, 1).otherwise(0)).alias(f"_h{i}")
                                      for i in range(len(names))])
    joined = tables["application"].select(KEY).join(flags, KEY, "left")
    counts = joined.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"_h{i}") == 1).alias(f"_c{i}")
                                                          for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(name).alias("table_name"), F.col(f"_c{i}").alias("with_history"),
                              (F.col("_n") - F.col(f"_c{i}")).alias("without_history"),
                              F.try_divide(F.col(f"_c{i}"), F.col("_n")).alias("coverage_ratio"))
                     for i, name in enumerate(names)])
    return counts.select(F.inline(rows))


def load_or_build_master(spark: SparkSession, raw_dir: str, cache_path: str, fmt: str = "parquet",
                         force_rebuild: bool = False, validate: bool = True) -> DataFrame:
    """S-IN-5: read the cached master table when present, else build, validate and write it.

    The cache folder carries a marker of the input folder so that a cache built from other inputs
    is not reused silently (the reference ignores the input folder once a cache exists).
    """
    from riskmart.operators import quality

    marker = f"{cache_path.rstrip('/')}/_source={_source_key(raw_dir, fmt)}"
    # the writer's marker is there only after a complete write
    if not force_rebuild and TB.table_exists(spark, f"{marker}/_SUCCESS"):
        return spark.read.parquet(marker)
    tables = TB.load_all(spark, raw_dir, fmt)
    if validate:
        quality.validate_tables(tables, raise_on_error=True)
    master = build_master(tables)
    master.write.mode("overwrite").parquet(marker)
    return spark.read.parquet(marker)


def _source_key(path: str, fmt: str) -> str:
    """Key of an input folder and format; different paths never share one."""
    return hashlib.sha256(f"{fmt}:{path.rstrip('/')}".encode()).hexdigest()
