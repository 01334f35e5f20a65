"""Ordered target statistics of categories: each row sees only the labels before it.

Rows stand in a permutation given by a hash of their id. A row's value for a category is the smoothed mean label of
the rows of that category before it: (labels + ``strength`` * prior) / (rows + ``strength``). The sums before a row come
from two levels of prefix sums - per (category, hash range), then inside the range - so a category that
holds most rows is spread over 65,536 ranges and no task sees all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.operators.splits import SEED, hash32
from riskmart.plans.ranking import hash32_bucket, running_totals

STRENGTH = 1.0


def _smoothed(total: Column, n: Column, prior: float, strength: float) -> Column:
    return F.try_divide(total + F.lit(strength * prior), n + F.lit(strength))


def prior_of(df: DataFrame, label: str) -> float:
    """Mean label (0 without any)."""
    return float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)


def _long(df: DataFrame, categories: Sequence[str], *others: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("category")) for i, c in enumerate(categories)])
    return df.select(*others, F.explode(pairs).alias("c")).select("*", "c.column", "c.category").drop("c")


def ordered_statistics(df: DataFrame, categories: Sequence[str], *, label: str, id_col: str, strength: float = STRENGTH,
                       seed: int = SEED, prior: float | None = None) -> DataFrame:
    """(id_col, <category>_te ...) for every row of ``df``: the ordered statistic of each category column.

    Ids are unique integers. Null is a category of its own. Rows with a null label add nothing to those after them
    and get their statistics like any other. The first row of a category gets the prior (mean label). An empty
    table gives no rows.
    """
    prior = prior_of(df, label) if prior is None else prior
    y = F.col(label).cast("double")
    rows = _long(df, categories, F.col(id_col).alias("id"), hash32(id_col, seed).alias("h"), F.coalesce(y, F.lit(0.0)).alias("y"),
                 y.isNotNull().cast("long").alias("one"))
    # running_totals joins on its groups, so a null category needs a value; the flag keeps it apart from any text
    rows = rows.withColumn("absent", F.col("category").isNull()).withColumn("category", F.coalesce("category", F.lit("")))
    rows = rows.withColumn("at", F.struct("h", "id"))
    summed = running_totals(rows, "at", ["y", "one"], bucket=hash32_bucket(F.col("h")), descending=False, groups=["column", "absent", "category"])
    value = _smoothed(F.col("y_cum") - F.col("y"), (F.col("one_cum") - F.col("one")).cast("double"), prior, strength)
    return (summed.select("id", "column", value.alias("v")).groupBy("id")
            .agg(*[F.max(F.when(F.col("column") == i, F.col("v"))).alias(f"{c}_te") for i, c in enumerate(categories)])
            .withColumnRenamed("id", id_col))


def category_statistics(df: DataFrame, categories: Sequence[str], *, label: str, strength: float = STRENGTH,
                        prior: float | None = None) -> DataFrame:
    """(column, category, n, value): the statistic over all labelled rows, for rows that were not trained on. A row with
    category null and n null holds the prior, for categories that are not listed."""
    prior = prior_of(df, label) if prior is None else prior
    rows = _long(df.where(F.col(label).isNotNull()), categories, F.col(label).cast("double").alias("y"))
    stats = rows.groupBy("column", "category").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    names = F.array(*[F.lit(c) for c in categories])
    stats = stats.select(names[F.col("column")].alias("column"), "category", "n", _smoothed(F.col("total"), F.col("n").cast("double"), prior, strength).alias("value"))
    return stats.unionByName(df.sparkSession.createDataFrame([(None, None, None, prior)], "column string, category string, n long, value double"))


def apply_statistics(df: DataFrame, stats: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``df`` with ``<category>_te`` from :func:`category_statistics`; categories not in it get the prior."""
    prior = stats.where("column IS NULL").first()["value"]
    out = df
    for c in categories:
        own = stats.where(F.col("column") == c).select(F.col("category").alias("_category"), F.col("value").alias(f"{c}_te"))
        out = out.join(own, F.col(f"`{c}`").cast("string").eqNullSafe(F.col("_category")), "left").drop("_category")
        out = out.withColumn(f"{c}_te", F.coalesce(F.col(f"{c}_te"), F.lit(float(prior))))
    return out
