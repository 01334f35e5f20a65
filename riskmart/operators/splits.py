"""Reproducible stratified splits, folds and class weights.

Rows are ordered inside each class by a 32-bit multiplicative hash of the id (ties by id), and
the first ``round(fraction * class size)`` rows of each class form the test part. The ranks come
from :func:`riskmart.plans.ranking.rank_within`: the hash is uniform, so its top 16 bits split
every class into 65,536 buckets and no task ever holds a whole class (the label has only two
values, so a plain ``row_number().over(partitionBy(label))`` would put each class in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.plans.ranking import hash32_bucket, rank_within

# Fixed values (must equal the reference): 15 % hold-out, 5 folds, 10 % early-stopping share,
# seed 42, constant positive-class weight 11 as the alternative to "balanced".
TEST_FRACTION = 0.15
N_FOLDS = 5
VALIDATION_FRACTION = 0.10
SEED = 42
POSITIVE_WEIGHT = 11.0

_GOLDEN = 2654435761          # Knuth's multiplicative constant
_TWO32 = 4294967296
_G_HI, _G_LO = _GOLDEN >> 16, _GOLDEN & 0xFFFF


def hash32(id_col: str, seed: int = SEED) -> Column:
    """``((id XOR seed) * 2654435761) mod 2^32`` without 64-bit overflow for any id."""
    a = F.pmod(F.col(id_col).cast("long").bitwiseXOR(F.lit(seed)), F.lit(_TWO32))
    return F.pmod(a * _G_LO + F.pmod(a * _G_HI, F.lit(65536)) * 65536, F.lit(_TWO32))


def _ranked(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    h = df.withColumn("_h", hash32(id_col, seed))
    return rank_within(h, [label], ["_h", id_col], hash32_bucket(F.col("_h")), rank_col="_rank", total_col="_cls_n")


def stratified_split(df: DataFrame, label: str = "TARGET", id_col: str = "SK_ID_CURR",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``split`` = 'test' for the first round(fraction * n_class) rows of each class, else 'train'."""
    r = _ranked(df, label, id_col, seed)
    n_test = F.round(F.lit(test_fraction) * F.col("_cls_n"))
    return r.withColumn("split", F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_h", "_rank", "_cls_n")


def stratified_folds(df: DataFrame, label: str = "TARGET", id_col: str = "SK_ID_CURR", k: int = N_FOLDS,
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Development rows (the 'train' part of :func:`stratified_split`) with an int ``fold`` in 0..k-1.

    Folds are dealt round-robin in hash order inside each class, so every fold keeps the class
    ratio and the folds are disjoint and complete."""
    r = _ranked(df, label, id_col, seed)
    n_test = F.round(F.lit(test_fraction) * F.col("_cls_n")).cast("long")
    dev = r.where(F.col("_rank") > n_test)
    return dev.withColumn("fold", F.pmod(F.col("_rank") - n_test - 1, F.lit(k)).cast("int")) \
              .drop("_h", "_rank", "_cls_n")


def validation_indicator(df: DataFrame, label: str = "TARGET", id_col: str = "SK_ID_CURR",
                         fraction: float = VALIDATION_FRACTION, seed: int = SEED + 1,
                         out_col: str = "is_validation") -> DataFrame:
    """T-3: boolean early-stopping marker for a stratified ``fraction`` of the rows."""
    s = stratified_split(df, label, id_col, fraction, seed)
    return s.withColumn(out_col, F.col("split") == "test").drop("split")


def class_weights(df: DataFrame, label: str = "TARGET", mode: str = "balanced") -> DataFrame:
    """T-4: per-class weight table ``(label, n_rows, weight)``; balanced = n / (n_classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    if mode == "balanced":
        stats = counts.agg(F.sum("n_rows").alias("_n"), F.count(F.lit(1)).alias("_k")).first()
        w = F.lit(float(stats["_n"])) / (F.lit(float(stats["_k"])) * F.col("n_rows"))
    else:
        w = F.when(F.col(label) == 1, F.lit(POSITIVE_WEIGHT)).otherwise(F.lit(1.0))
    return counts.select(label, "n_rows", w.alias("weight"))


def with_class_weight(df: DataFrame, label: str = "TARGET", mode: str = "balanced", out_col: str = "weight") -> DataFrame:
    """Attach the class weight as a column (the weight table has one row per class, a literal map)."""
    rows = class_weights(df, label, mode).collect()
    mapping = F.create_map(*[x for r in rows for x in (F.lit(r[label]), F.lit(float(r["weight"])))])
    return df.withColumn(out_col, mapping[F.col(label)])


def split_summary(split_df: DataFrame, label: str = "TARGET", split_col: str = "split") -> DataFrame:
    """T-12: rows and default rate per split."""
    return split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.avg(F.col(label).cast("double")).alias("default_rate"))
