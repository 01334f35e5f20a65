"""Catalogue entries: histograms, splits and target statistics of the boosted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.operators import boosting as B
from riskmart.operators import quantiles as Q
from riskmart.operators import splits as S
from riskmart.operators import target_stats as TS
from riskmart.plans.registry import query
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A

FEATURES = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "DAYS_EMPLOYED"]
PROBS = [i / 8 for i in range(1, 8)]
#: The split whose children are compared by subtraction: feature number, cut, missing values to the left.
SPLIT = (4, 3, True)
_PARAMS = B.family_params("xgboost")


def _rows(spark, sf_dir):
    """Binned application rows with the first round's gradients (margin 0, positive class weighted 11)."""
    app = A.adapter(spark, sf_dir, "application").select("SK_ID_CURR", "TARGET", *FEATURES)
    edges = {c: sorted(set(q)) for c, q in Q.exact_quantiles(app, FEATURES, PROBS).items() if None not in q}
    weight = F.when(F.col("TARGET") == 1, F.lit(_PARAMS.positive_weight)).otherwise(F.lit(1.0))
    g, h = B.gradients(F.lit(0.0), F.col("TARGET").cast("double"), weight)
    return B.binned(app, edges, ["SK_ID_CURR", "TARGET"]).withColumns({"g": g, "h": h})


_PROBS = ", ".join(str(x) for x in PROBS)
_EDGES = " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS f, v FROM (SELECT unnest(quantile_cont(CAST({c} AS DOUBLE), [{_PROBS}])) AS v FROM application) q{i}" for i, c in enumerate(FEATURES))
_LONG = " UNION ALL ".join(
    f"SELECT SK_ID_CURR, {i} AS feature, CASE WHEN {c} IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM edges WHERE f = {i} AND v <= {c}) END AS bin, "
    f"CASE WHEN TARGET = 1 THEN 11e0 * (5e-1 - 1e0) ELSE 5e-1 END AS g, CASE WHEN TARGET = 1 THEN 11e0 * 25e-2 ELSE 25e-2 END AS h FROM application"
    for i, c in enumerate(FEATURES))
_WITH = A.cte("application", extra=(("edges", _EDGES), ("long", _LONG)))
_HIST = "SELECT 0 AS node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM long GROUP BY ALL"


@query("gradient_histogram", norm_sql(_HIST, ints=["node", "feature", "bin", "n"], dbls=["g", "h"], prefix=_WITH))
def gradient_histogram(spark, sf_dir):
    """T-7: gradient and hessian sums per (feature, bin) of the root, one grouped aggregate."""
    return tidy(B.histograms(_rows(spark, sf_dir).withColumn("node", F.lit(0).cast("long"))))


def _side(g: str, h: str) -> str:
    return f"(greatest(abs({g}) - {_PARAMS.l1}, 0) ** 2 / ({h} + {_PARAMS.l2}))"


_GAINS = f"""
WITH hist AS ({_HIST}), sums AS (
 SELECT *, sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER r AS ug, sum(CASE WHEN bin > 0 THEN h ELSE 0 END) OVER r AS uh,
  sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER r AS un, sum(g) OVER f AS ag, sum(h) OVER f AS ah, sum(n) OVER f AS an,
  sum(CASE WHEN bin = 0 THEN g ELSE 0 END) OVER f AS mg, sum(CASE WHEN bin = 0 THEN h ELSE 0 END) OVER f AS mh,
  sum(CASE WHEN bin = 0 THEN n ELSE 0 END) OVER f AS mn
 FROM hist WINDOW f AS (PARTITION BY feature), r AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
sides AS (SELECT feature, bin AS cut, ml, ug + ml * mg AS gl, uh + ml * mh AS hl, un + ml * mn AS nl, ag, ah, an
 FROM sums, (VALUES (0), (1)) m(ml) WHERE bin > 0 AND (ml = 0 OR mn > 0))
SELECT feature, cut, ml AS missing_left, ({_side('gl', 'hl')} + {_side('(ag - gl)', '(ah - hl)')} - {_side('ag', 'ah')}) / 2 - {_PARAMS.gamma} AS gain, nl AS n_left
FROM sides WHERE nl >= 1 AND an - nl >= 1 AND hl >= {_PARAMS.min_child_weight} AND ah - hl >= {_PARAMS.min_child_weight}"""


@query("split_gains", norm_sql(_GAINS, ints=["feature", "cut", "missing_left", "n_left"], dbls=["gain"], prefix=_WITH))
def split_gains(spark, sf_dir):
    """T-7: the gain of every allowed split of the root (L1/L2 leaf penalties, both ways for missing values)."""
    hist = B.histograms(_rows(spark, sf_dir).withColumn("node", F.lit(0).cast("long")))
    gains = B.split_gains(hist, _PARAMS)
    return tidy(gains.select("feature", "cut", F.col("missing_left").cast("int").alias("missing_left"), "gain", "n_left"))


_CHILD = f"""SELECT CASE WHEN side THEN 1 ELSE 2 END AS node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n
FROM long JOIN (SELECT SK_ID_CURR AS id, bin <= {SPLIT[1]} AS side FROM long WHERE feature = {SPLIT[0]}) s ON id = SK_ID_CURR GROUP BY ALL"""


@query("histogram_subtraction", norm_sql(_CHILD, ints=["node", "feature", "bin", "n"], dbls=["g", "h"], prefix=_WITH))
def histogram_subtraction(spark, sf_dir):
    """T-7 (best-first family): the left child's histogram directly, the right one's as parent minus left."""
    rows = _rows(spark, sf_dir)
    tree = B.Tree({0: {"feature": SPLIT[0], "cut": SPLIT[1], "missing_left": SPLIT[2], "left": 1, "right": 2}, 1: {}, 2: {}})
    parent = B.histograms(rows.withColumn("node", F.lit(0).cast("long")))
    left = B.histograms(rows.withColumn("node", tree.column(lambda k: F.lit(1 if k == 1 else None).cast("long"))))
    return tidy(left.unionByName(B.subtracted(parent, left, {1: (0, 2)})))


CATEGORIES = ["CODE_GENDER", "OCCUPATION_TYPE"]
_H = f"(xor(SK_ID_CURR, {S.SEED}) * 2654435761) % 4294967296"
_TE = ", ".join(
    f"(coalesce(sum(TARGET) OVER w{i}, 0) + p) / (count(TARGET) OVER w{i} + 1) AS {c}_te" for i, c in enumerate(CATEGORIES))
_TE_WINDOWS = ", ".join(f"w{i} AS (PARTITION BY {c} ORDER BY {_H}, SK_ID_CURR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                        for i, c in enumerate(CATEGORIES))


@query("ordered_target_encoding", norm_sql(
    f"SELECT SK_ID_CURR, {_TE} FROM application, (SELECT avg(TARGET) AS p FROM application) a WINDOW {_TE_WINDOWS}",
    ints=["SK_ID_CURR"], dbls=[f"{c}_te" for c in CATEGORIES], prefix=A.cte("application")))
def ordered_target_encoding(spark, sf_dir):
    """T-7 (ordered family): each row's smoothed category mean from the rows before it in a hash permutation."""
    app = A.adapter(spark, sf_dir, "application").select("SK_ID_CURR", "TARGET", *CATEGORIES)
    return tidy(TS.ordered_statistics(app, CATEGORIES, label="TARGET", id_col="SK_ID_CURR"))
