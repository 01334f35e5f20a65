"""Catalogue entries: calibration, drift and metrics by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.operators import calibration as CA
from riskmart.operators import drift as DR
from riskmart.operators import fairness as FA
from riskmart.operators import splits as S
from riskmart.plans.registry import query
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A

_SCORED = A.cte("scored_events")
_BINS = """SELECT greatest(least(floor(score * 10), 9), 0) AS bin, count(*) AS n, avg(score) AS mean_score, avg(CAST(label AS DOUBLE)) AS positive_rate,
 abs(avg(score) - avg(CAST(label AS DOUBLE))) AS gap FROM scored_events WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY 1"""


@query("reliability_table", norm_sql(_BINS, ints=["bin", "n"], dbls=["mean_score", "positive_rate", "gap"], prefix=_SCORED))
def reliability_table(spark, sf_dir):
    """Mean score and positive rate in ten equal-width score bins."""
    return tidy(CA.reliability_table(A.adapter(spark, sf_dir, "scored_events")))


@query("calibration_error", norm_sql(
    f"SELECT sum(n * gap) / sum(n) AS expected_calibration_error, max(gap) AS maximum_calibration_error FROM ({_BINS}) b",
    dbls=["expected_calibration_error", "maximum_calibration_error"], prefix=_SCORED))
def calibration_error(spark, sf_dir):
    """Expected and maximum calibration error."""
    return tidy(CA.calibration_error(A.adapter(spark, sf_dir, "scored_events")))


# The isotonic fit by its max-min formula: of all stretches that end at or after a score, the least mean, and of those for all
# starts at or before it the largest.
_ISOTONIC = """
WITH c AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored_events WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score),
r AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM c WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.pos) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM r a JOIN r b ON a.i <= b.i),
u AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
f AS (SELECT r.score, r.n, max(least) AS value FROM r JOIN u ON u.j <= r.i AND u.k = r.i GROUP BY r.score, r.n)
SELECT min(score) AS low, max(score) AS high, sum(n) AS n, avg(value) AS value FROM f GROUP BY round(value, 12)"""


@query("isotonic_calibration", norm_sql(_ISOTONIC, ints=["n"], dbls=["low", "high", "value"], prefix=_SCORED))
def isotonic_calibration(spark, sf_dir):
    """Blocks of the isotonic regression of the label on the score."""
    return tidy(CA.isotonic_blocks(A.adapter(spark, sf_dir, "scored_events")))


DRIFT_FEATURES = ["AMT_INCOME_TOTAL", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "AMT_ANNUITY"]
_H = f"(xor(SK_ID_CURR, {S.SEED}) * 2654435761) % 4294967296"
_PARTS = f"""SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {_H}, SK_ID_CURR) <= round(15e-2 * count(*) OVER (PARTITION BY TARGET)) AS is_test
 FROM application"""
_EDGES = " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS f, v FROM (SELECT unnest(quantile_cont(CAST({c} AS DOUBLE), [{', '.join(str(k / 10) for k in range(1, 10))}])) AS v FROM parts WHERE NOT is_test) q{i}"
    for i, c in enumerate(DRIFT_FEATURES))
_PSI = " UNION ALL ".join(f"""SELECT '{c}' AS feature, sum((a - e) * ln(a / e)) AS psi, max(n_rows) AS n_rows FROM (
 SELECT greatest(count(*) FILTER (x.bin = b.bin AND NOT is_test) / (sum(CASE WHEN is_test THEN 0 ELSE 1 END) * 1e0), 1e-4) AS e,
  greatest(count(*) FILTER (x.bin = b.bin AND is_test) / (sum(CASE WHEN is_test THEN 1 ELSE 0 END) * 1e0), 1e-4) AS a,
  sum(CASE WHEN is_test THEN 1 ELSE 0 END) AS n_rows
 FROM (SELECT is_test, CASE WHEN {c} IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM edges WHERE f = {i} AND v <= {c}) END AS bin FROM parts) x,
  range(11) b(bin) GROUP BY b.bin) s""" for i, c in enumerate(DRIFT_FEATURES))
_STATUS = "CASE WHEN psi < 1e-1 THEN 'stable' WHEN psi < 25e-2 THEN 'shifting' ELSE 'shifted' END AS status"


@query("psi_by_feature", norm_sql(f"SELECT *, {_STATUS} FROM ({_PSI}) p", ints=["n_rows"], strs=["feature", "status"], dbls=["psi"],
                                  prefix=A.cte("application", extra=(("parts", _PARTS), ("edges", _EDGES)))))
def psi_by_feature(spark, sf_dir):
    """Stability of the held-out applications against a profile of the development rows."""
    app = A.adapter(spark, sf_dir, "application").select("SK_ID_CURR", "TARGET", *DRIFT_FEATURES)
    split = S.stratified_split(app)
    profile = DR.reference_profile(split.where("split = 'train'"), DRIFT_FEATURES)
    return tidy(DR.psi_by_feature(split.where("split = 'test'"), profile))


_GROUP = "SELECT SK_ID_CURR AS id, CODE_GENDER AS g, TARGET AS y, 1e0 - EXT_SOURCE_2 AS s FROM application WHERE EXT_SOURCE_2 IS NOT NULL"
_RATES = f"""
WITH d AS ({_GROUP}),
r AS (SELECT g, count(*) AS n, sum(y) AS positives, sum(CASE WHEN s >= 5e-1 THEN 1 ELSE 0 END) AS sel, sum(CASE WHEN s >= 5e-1 THEN y ELSE 0 END) AS tp FROM d GROUP BY g),
t AS (SELECT sum(n) AS n, sum(positives) AS positives, sum(sel) AS sel, sum(tp) AS tp FROM r),
a AS (SELECT p.g, avg(CASE WHEN p.s > q.s THEN 1e0 WHEN p.s = q.s THEN 5e-1 ELSE 0e0 END) AS auc FROM d p JOIN d q ON p.g = q.g AND p.y = 1 AND q.y = 0 GROUP BY p.g)
SELECT r.g AS CODE_GENDER, r.n, r.positives, r.sel / r.n AS selection_rate, r.tp / nullif(r.positives, 0) AS true_positive_rate,
 (r.sel - r.tp) / nullif(r.n - r.positives, 0) AS false_positive_rate, r.tp / nullif(r.sel, 0) AS precision,
 r.sel / r.n - t.sel / t.n AS selection_rate_gap, r.tp / nullif(r.positives, 0) - t.tp / nullif(t.positives, 0) AS true_positive_rate_gap,
 (r.sel - r.tp) / nullif(r.n - r.positives, 0) - (t.sel - t.tp) / nullif(t.n - t.positives, 0) AS false_positive_rate_gap, auc
FROM r CROSS JOIN t LEFT JOIN a ON a.g = r.g"""


@query("group_metrics", norm_sql(_RATES, ints=["n", "positives"], strs=["CODE_GENDER"], dbls=[
    "selection_rate", "true_positive_rate", "false_positive_rate", "precision", "selection_rate_gap", "true_positive_rate_gap", "false_positive_rate_gap", "auc"],
    prefix=A.cte("application")))
def group_metrics(spark, sf_dir):
    """Rates and AUC by gender; the bootstrap intervals are a query of their own."""
    return tidy(FA.group_metrics(_by_gender(spark, sf_dir), "CODE_GENDER", replicates=1).drop("auc_low", "auc_high"))


def _by_gender(spark, sf_dir):
    app = A.adapter(spark, sf_dir, "application")
    return app.select(F.col("SK_ID_CURR").alias("id"), "CODE_GENDER", F.col("TARGET").alias("label"), (F.lit(1.0) - F.col("EXT_SOURCE_2")).alias("score"))


@query("group_intervals")
def group_intervals(spark, sf_dir):
    """Bootstrap intervals of the AUC by gender (the draws hash with Spark's own function: no SQL; tested by brute force)."""
    return tidy(FA.group_metrics(_by_gender(spark, sf_dir), "CODE_GENDER").select("CODE_GENDER", "auc", "auc_low", "auc_high"))
