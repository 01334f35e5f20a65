"""Metrics by group with bootstrap intervals, in one pass over the rows.

A replicate gives every row a Poisson(1) weight, drawn from a hash of its id and the replicate's number: the draw needs
no second look at the table, is the same after a lost task, and the weighted counts of all replicates come from one
aggregate per (group, score).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.plans.ranking import running_totals, unit_bucket
from riskmart.session import written

REPLICATES, THRESHOLD, LEVEL = 100, 0.5, 0.95
_RANGE = 1 << 24
#: Cumulative Poisson(1) probabilities; a weight above 9 has a chance below 1e-7, less than one hash value.
CUMULATIVE = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]


def poisson_weight(id_col: Column, replicate: Column) -> Column:
    """Poisson(1) weight of a row in a replicate; replicate 0 is the sample itself (weight 1)."""
    u = F.pmod(F.xxhash64(id_col, replicate), F.lit(_RANGE))
    weight = sum((u >= F.lit(math.ceil(c * _RANGE))).cast("int") for c in CUMULATIVE)
    return F.when(replicate == 0, F.lit(1)).otherwise(weight)


def group_rates(df: DataFrame, group: str, label: str = "label", score: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """Per group: n, positives, selection_rate, true_positive_rate, false_positive_rate, precision (NULL where undefined),
    and the differences of the first three rates to those of all rows. Null is a group; rows without score or label
    don't count."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    y, hit = F.col(label).cast("int") == 1, F.col(score) >= F.lit(threshold)
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(y).alias("positives"), F.count_if(hit).alias("selected"),
                                     F.count_if(y & hit).alias("tp"))
    total = rows.agg(F.count("*").alias("all_n"), F.count_if(y).alias("all_positives"), F.count_if(hit).alias("all_selected"), F.count_if(y & hit).alias("all_tp"))

    def rates(n, p, s, t):
        n, p, s, t = (F.col(c).cast("double") for c in (n, p, s, t))
        return [F.try_divide(s, n), F.try_divide(t, p), F.try_divide(s - t, n - p)]

    own, base = rates("n", "positives", "selected", "tp"), rates("all_n", "all_positives", "all_selected", "all_tp")
    names = ("selection_rate", "true_positive_rate", "false_positive_rate")
    return counts.crossJoin(F.broadcast(total)).select(      # one row of totals
        group, "n", "positives", *[r.alias(c) for r, c in zip(own, names)],
        F.try_divide(F.col("tp").cast("double"), F.col("selected").cast("double")).alias("precision"),
        *[(r - b).alias(f"{c}_gap") for r, b, c in zip(own, base, names)])


def replicate_auc(df: DataFrame, group: str, label: str = "label", score: str = "score", id_col: str = "id", replicates: int = REPLICATES) -> DataFrame:
    """(group, replicate, auc): exact weighted AUC per group for the sample (0) and every replicate."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        F.col(group).alias("g"), F.col(label).cast("long").alias("y"), F.col(score).cast("double").alias("score"), F.col(id_col).alias("id"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", poisson_weight(F.col("id"), F.col("replicate")))
    counts = (drawn.where("w > 0").groupBy(F.col("g").isNull().alias("absent"), F.coalesce(F.col("g").cast("string"), F.lit("")).alias("g"), "replicate", "score")
              .agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg")))
    curve = running_totals(written(counts, "group-scores"), "score", ["pos", "neg"], groups=["absent", "g", "replicate"], bucket=unit_bucket(F.col("score")))
    u = F.sum(F.col("neg").cast("double") * ((F.col("pos_cum") - F.col("pos")).cast("double") + F.col("pos").cast("double") / 2))
    s = curve.groupBy("absent", "g", "replicate").agg(u.alias("u"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
    return s.select(F.when(~F.col("absent"), F.col("g")).alias(group), "replicate", F.try_divide(F.col("u"), F.col("p") * F.col("q")).alias("auc"))


def group_metrics(df: DataFrame, group: str, label: str = "label", score: str = "score", id_col: str = "id", threshold: float = THRESHOLD,
                  replicates: int = REPLICATES, level: float = LEVEL) -> DataFrame:
    """:func:`group_rates` with auc and the percentile interval (auc_low, auc_high) over the replicates that have both
    classes (the ``k``-th smallest and largest of them, k = floor((1 - level) / 2 * number) + 1).

    ``group`` comes back as text. A group of one class has no AUC. No rows give no groups.
    """
    auc = replicate_auc(df, group, label, score, id_col, replicates)
    drawn = auc.where("replicate > 0 AND auc IS NOT NULL").groupBy(group).agg(F.array_sort(F.collect_list("auc")).alias("a"))   # at most ``replicates``
    k = F.floor(F.lit((1 - level) / 2) * F.size("a") + F.lit(1e-9)).cast("int")       # not one less by rounding
    ends = drawn.select(F.col(group).alias("_g"), F.col("a")[k].alias("auc_low"), F.col("a")[F.size("a") - 1 - k].alias("auc_high"))
    point = auc.where("replicate = 0").select(F.col(group).alias("_h"), "auc")
    rates = group_rates(df.withColumn(group, F.col(group).cast("string")), group, label, score, threshold)
    return (rates.join(point, F.col(group).eqNullSafe(F.col("_h")), "left").join(ends, F.col(group).eqNullSafe(F.col("_g")), "left")
            .drop("_h", "_g"))
