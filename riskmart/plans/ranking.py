"""Exact running totals and within-group ranks without a single-task window.

A window with ``orderBy`` but no (or a low-cardinality) ``partitionBy`` sends every row to one
task. Both helpers here split the order into many buckets with a *monotone* bucket function:

1. count/sum rows per (group, bucket) - a bounded table (groups x buckets rows);
2. prefix sums over that small table give each bucket's offset;
3. the offsets are joined back (AQE broadcasts them when their measured size allows it), and a window
   partitioned by (group, bucket) adds the in-bucket part.

Each window partition holds only the rows of one bucket, so the work spreads over all tasks even
when a single group (e.g. one class label) holds most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16


def unit_bucket(score: Column, bits: int = BUCKET_BITS) -> Column:
    """Monotone bucket of a value in [0, 1] (values outside are clamped to the edge buckets)."""
    n = 1 << bits
    b = F.floor(score * F.lit(float(n))).cast("long")
    return F.when(b < 0, F.lit(0)).when(b > n - 1, F.lit(n - 1)).otherwise(b)


def hash32_bucket(h: Column, bits: int = BUCKET_BITS) -> Column:
    """Monotone bucket of a 32-bit unsigned hash value."""
    return F.shiftright(h, 32 - bits)


def _spec(groups: list[str]):
    """Window spec over the small per-bucket table (bounded rows, so one task is fine)."""
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def adaptive_buckets(df: DataFrame, col: str, n_buckets: int = 1 << 12, out_col: str = "_bkt") -> DataFrame:
    """Add a monotone bucket column whose buckets hold about equal numbers of rows.

    Boundaries are approximate quantiles of ``col`` (a bounded-memory sketch, one aggregate), so no
    bucket can collect most rows even when the values crowd into a narrow range; the assignment is
    a binary search per row (Bucketizer, JVM side)."""
    from pyspark.ml.feature import Bucketizer

    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, 1.0 / (4 * n_buckets))
    splits = [float("-inf")] + sorted({float(q) for q in qs if q is not None}) + [float("inf")]
    bk = Bucketizer(splits=splits, inputCol=col, outputCol=out_col, handleInvalid="keep")
    return bk.transform(df.withColumn(col, F.col(col).cast("double"))).withColumn(out_col, F.col(out_col).cast("int"))


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str], bucket: Column | None = None,
                   descending: bool = True, groups: Sequence[str] = (),
                   suffix: str = "_cum") -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows ordered at or before this row.

    ``descending=True`` accumulates from the largest ``order_col`` down (rows with a larger value
    come first). ``order_col`` must be unique within each group (pre-aggregate ties first), and
    ``bucket`` must be monotone non-decreasing in ``order_col``; without it, balanced buckets come
    from :func:`adaptive_buckets`.
    """
    g = list(groups)
    tagged = adaptive_buckets(df, order_col) if bucket is None else df.withColumn("_bkt", bucket)
    totals = tagged.groupBy(*g, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    border = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    before = _spec(g).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_bkt", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                          for v in value_cols])
    joined = tagged.join(offsets, [*g, "_bkt"])
    oorder = F.col(order_col).desc() if descending else F.col(order_col).asc()
    upto = Window.partitionBy(*g, "_bkt").orderBy(oorder).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.sum(v).over(upto))
    return out.drop("_bkt", *[f"_o_{v}" for v in value_cols])


def rank_within(df: DataFrame, groups: Sequence[str], order_cols: Sequence[str], bucket: Column,
                rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` within ``groups`` ordered by ``order_cols`` (ascending).

    ``bucket`` must be monotone non-decreasing in the first order column. Optionally adds the
    group size as ``total_col``.
    """
    g = list(groups)
    tagged = df.withColumn("_bkt", bucket)
    counts = tagged.groupBy(*g, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = _spec(g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    cols = [*g, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total_col:
        cols.append(F.sum("_n").over(_spec(g).rowsBetween(Window.unboundedPreceding,
                                                          Window.unboundedFollowing)).alias(total_col))
    offsets = counts.select(*cols)
    joined = tagged.join(offsets, [*g, "_bkt"])
    w = Window.partitionBy(*g, "_bkt").orderBy(*[F.col(c).asc() for c in order_cols])
    return joined.withColumn(rank_col, F.col("_off") + F.row_number().over(w)).drop("_bkt", "_off")
