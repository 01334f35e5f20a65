"""Per-row, per-feature attribution and its summaries.

For a linear model the interventional Shapley value of feature f is exact and closed-form:
``coef_f * (x_f - E[x_f])`` with the expectation over a background set, and the contributions plus
the base value ``intercept + sum(coef * E[x])`` add up to the row's margin. Contributions are a long
table ``(id, feature, value, contribution)`` so every summary (global importance, top-k per row,
value/contribution pairs) is an ordinary aggregate or a window partitioned by row id (bounded by
the number of features).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.session import written

# Fixed values (must equal the reference): background rows, factors per row in reports and in
# responses, global top-n, features in the summary view.
BACKGROUND_ROWS = 100
TOP_FACTORS = 10
RESPONSE_FACTORS = 5
TOP_FEATURES = 20
SUMMARY_FEATURES = 25
TIE_DIGITS = 9


def _x(f: str, fill: float) -> Column:
    return F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float(fill)))


def background_means(df: DataFrame, features: Sequence[str], fill: float = 0.0) -> dict[str, float]:
    """E[x] per feature over the background frame (one aggregate, numbers to the driver)."""
    row = df.agg(*[F.avg(_x(f, fill)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return {f: float(row[f"m{i}"] or 0.0) for i, f in enumerate(features)}


def background_sample(df: DataFrame, id_col: str, n: int = BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """X-1: a reproducible n-row background sample - the n smallest id hashes (a sampling operator;
    Spark plans it as a per-partition top-n, so only n rows per task move)."""
    from riskmart.operators.splits import hash32

    return df.orderBy(hash32(id_col, seed), F.col(id_col)).limit(n)


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], intercept: float, id_col: str,
                         background: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """X-2 (linear, exact): long table ``(id, feature, value, contribution, base_value, margin)``."""
    feats = list(coefficients)
    if background is None:
        # read twice (expectation pass, contribution pass): only the needed columns are written
        df = written(df.select(id_col, *[c for c in feats if c in df.columns]), "attribution")
    means = background_means(background if background is not None else df, feats, fill)
    base = float(intercept) + sum(coefficients[f] * means[f] for f in feats)
    margin = F.lit(float(intercept))
    for f in feats:
        margin = margin + _x(f, fill) * F.lit(float(coefficients[f]))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), _x(f, fill).alias("value"),
                              ((_x(f, fill) - F.lit(means[f])) * F.lit(float(coefficients[f]))).alias("contribution"))
                     for f in feats])
    return df.select(F.col(id_col).alias("id"), margin.alias("margin"), F.explode(rows).alias("r")).select(
        "id", "r.feature", "r.value", "r.contribution", F.lit(base).alias("base_value"), "margin")


def vector_contributions(df: DataFrame, features_col: str, names: Sequence[str], coefficients: Sequence[float],
                         intercept: float, id_col: str, background: DataFrame | None = None) -> DataFrame:
    """Linear contributions for an assembled feature vector (e.g. a fitted LogisticRegression); ``background``: rows with the
    same vector column whose means are the expectation (default: the explained rows)."""
    from pyspark.ml.functions import vector_to_array

    def flat(rows: DataFrame) -> DataFrame:
        arr = rows.select(F.col(id_col), vector_to_array(features_col).alias("_v"))
        return arr.select(F.col(id_col), *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])

    return linear_contributions(flat(df), dict(zip(names, coefficients)), intercept, id_col,
                                None if background is None else flat(background))


def completeness_gap(contribs: DataFrame) -> DataFrame:
    """Per row: |sum(contributions) + base - margin| (0 up to rounding for exact attributions)."""
    return contribs.groupBy("id").agg(
        F.abs(F.sum("contribution") + F.first("base_value") - F.first("margin")).alias("gap"))


def global_importance(contribs: DataFrame) -> DataFrame:
    """X-3: mean absolute contribution per feature, largest first (ties by name)."""
    return (contribs.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), F.asc("feature")))


def top_features(contribs: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """X-4: the n most important features (a top-k report)."""
    return global_importance(contribs).limit(n)


def top_factors_per_row(contribs: DataFrame, k: int = RESPONSE_FACTORS, digits: int = 4) -> DataFrame:
    """X-5/X-6: top-k factors of every row by |contribution| (ties by feature name), with direction.

    Contributions that agree to ``TIE_DIGITS`` decimals are tied: the background means are sums whose last
    bits depend on the order of the rows. The window is partitioned by row id, so each partition holds one
    row's features only."""
    w = Window.partitionBy("id").orderBy(F.desc(F.round(F.abs("contribution"), TIE_DIGITS)), F.asc("feature"))
    ranked = contribs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "feature", F.round("contribution", digits).alias("contribution"),
                         F.when(F.col("contribution") > 0, F.lit("increases_risk"))
                         .otherwise(F.lit("decreases_risk")).alias("direction"))


def top_factors_nested(contribs: DataFrame, k: int = RESPONSE_FACTORS) -> DataFrame:
    """Same as :func:`top_factors_per_row`, one row per id with an ordered array of factors."""
    flat = top_factors_per_row(contribs, k)
    return flat.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "contribution", "direction")))
                                  .alias("factors"))


def contribution_pairs(contribs: DataFrame, n: int = SUMMARY_FEATURES) -> DataFrame:
    """X-8: (feature, value, contribution) for the n most important features (summary-view data)."""
    top = top_features(contribs, n).select("feature")
    return contribs.join(F.broadcast(top), "feature", "left_semi").select("id", "feature", "value", "contribution")
