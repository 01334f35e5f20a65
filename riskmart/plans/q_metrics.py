"""Catalogue entries: evaluation metrics on the label/score adapter ``scored_events``."""

from __future__ import annotations

from riskmart.operators import metrics as MT
from riskmart.plans.registry import query
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A

_STEP = (MT.GRID_STOP - MT.GRID_START) / (MT.GRID_POINTS - 1)

# Shared oracle statements (DuckDB): distinct-score groups with cumulative counts, the threshold
# grid (same arithmetic as numpy's linspace), the brute-force sweep and the chosen threshold.
_CURVE = """
SELECT score, pos, neg,
 sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_cum,
 sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum
FROM (SELECT CAST(score AS DOUBLE) AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored_events WHERE score IS NOT NULL GROUP BY score) g"""
_TOT = "SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS P, " \
       "CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS N FROM scored_events"
_GRID = (f"SELECT range AS i, CASE WHEN range = {MT.GRID_POINTS - 1} THEN {MT.GRID_STOP:.17e} "
         f"ELSE range * {_STEP:.17e} + {MT.GRID_START:.17e} END AS threshold FROM range({MT.GRID_POINTS})")
_SWEEP = """
SELECT i, threshold, tp, fp, tp / (tp + fp + 1e-9) AS precision, tp / (P + 1e-9) AS recall_eps, tp / P AS recall,
 CASE WHEN tp = 0 THEN 0e0 ELSE (5e0 * tp) / ((5e0 * tp + 4e0 * (P - tp)) + fp) END AS f_beta
FROM (SELECT g.i, g.threshold, CAST(count_if(s.label = 1 AND s.score >= g.threshold) AS DOUBLE) AS tp,
  CAST(count_if(s.label <> 1 AND s.score >= g.threshold) AS DOUBLE) AS fp
  FROM grid g, scored_events s GROUP BY g.i, g.threshold) c, tot"""
_BEST = """
SELECT coalesce(b.threshold, 5e-1) AS threshold, b.f_beta, b.recall, b.precision,
 CASE WHEN b.i IS NULL THEN 0 ELSE 1 END AS found
FROM (SELECT 1 AS one) o LEFT JOIN (SELECT * FROM sweep WHERE recall >= 7e-1 ORDER BY f_beta DESC, i ASC LIMIT 1) b ON TRUE"""

_PREFIX = A.cte("scored_events", extra=(("curve", _CURVE), ("tot", _TOT), ("grid", _GRID), ("sweep", _SWEEP),
                                         ("best", _BEST)))


def _scored(spark, sf_dir):
    return A.adapter(spark, sf_dir, "scored_events")


def _cm_sql(t: str) -> str:
    return (f"SELECT count_if(label <> 1 AND NOT (score >= {t})) AS true_negatives, "
            f"count_if(label <> 1 AND score >= {t}) AS false_positives, "
            f"count_if(label = 1 AND NOT (score >= {t})) AS false_negatives, "
            f"count_if(label = 1 AND score >= {t}) AS true_positives FROM scored_events")


_CM_COLS = ["true_negatives", "false_positives", "false_negatives", "true_positives"]


@query("confusion_matrix", norm_sql(_cm_sql("5e-1"), ints=_CM_COLS, prefix=_PREFIX))
def confusion_matrix(spark, sf_dir):
    return tidy(MT.confusion_matrix(_scored(spark, sf_dir), threshold=0.5))


@query("brier_score", norm_sql("SELECT avg((score - label) * (score - label)) AS brier_score FROM scored_events",
                               dbls=["brier_score"], prefix=_PREFIX))
def brier_score(spark, sf_dir):
    return tidy(MT.brier_score(_scored(spark, sf_dir)))


def _rates_sql(t: str) -> str:
    return f"""
SELECT {t} AS threshold, round(tp / (tp + fp + 1e-9), 4) AS precision_default, round(tp / (tp + fn + 1e-9), 4) AS recall_default,
 round(2 * tp / (2 * tp + fp + fn + 1e-9), 4) AS f1_default, true_positives, false_positives, true_negatives, false_negatives,
 round(tp / (tp + fn + 1e-9), 4) AS default_catch_rate, round(fp / (fp + tn + 1e-9), 4) AS false_alarm_rate
FROM (SELECT *, CAST(true_positives AS DOUBLE) AS tp, CAST(false_positives AS DOUBLE) AS fp,
  CAST(false_negatives AS DOUBLE) AS fn, CAST(true_negatives AS DOUBLE) AS tn FROM ({_cm_sql(t)}) m) r"""


_RATE_DBLS = ["threshold", "precision_default", "recall_default", "f1_default", "default_catch_rate", "false_alarm_rate"]


@query("threshold_metrics", norm_sql(_rates_sql("5e-1"), ints=_CM_COLS, dbls=_RATE_DBLS, prefix=_PREFIX))
def threshold_metrics(spark, sf_dir):
    return tidy(MT.threshold_metrics(_scored(spark, sf_dir), threshold=0.5))


_AUC_SQL = "SELECT sum(neg * ((pos_cum - pos) + pos / 2e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc FROM curve"
_AP_SQL = "SELECT sum(pos * (pos_cum / CAST(pos_cum + neg_cum AS DOUBLE))) / CAST(sum(pos) AS DOUBLE) AS average_precision FROM curve"


@query("roc_auc", norm_sql(_AUC_SQL, dbls=["roc_auc"], prefix=_PREFIX))
def roc_auc(spark, sf_dir):
    return tidy(MT.roc_auc(_scored(spark, sf_dir)))


@query("average_precision", norm_sql(_AP_SQL, dbls=["average_precision"], prefix=_PREFIX))
def average_precision(spark, sf_dir):
    return tidy(MT.average_precision(_scored(spark, sf_dir)))


@query("roc_curve", norm_sql("SELECT score AS threshold, neg_cum / N AS fpr, pos_cum / P AS tpr FROM curve, tot",
                             dbls=["threshold", "fpr", "tpr"], prefix=_PREFIX))
def roc_curve(spark, sf_dir):
    return tidy(MT.roc_curve(_scored(spark, sf_dir)))


@query("pr_curve", norm_sql(
    "SELECT score AS threshold, pos_cum / CAST(pos_cum + neg_cum AS DOUBLE) AS precision, pos_cum / P AS recall, "
    "P / (P + N) AS base_rate FROM curve, tot",
    dbls=["threshold", "precision", "recall", "base_rate"], prefix=_PREFIX))
def pr_curve(spark, sf_dir):
    return tidy(MT.pr_curve(_scored(spark, sf_dir)))


@query("threshold_sweep", norm_sql("SELECT * FROM sweep", ints=["i", "tp", "fp"],
                                   dbls=["threshold", "precision", "recall_eps", "recall", "f_beta"], prefix=_PREFIX))
def threshold_sweep(spark, sf_dir):
    return tidy(MT.threshold_sweep(_scored(spark, sf_dir)))


@query("optimal_threshold", norm_sql("SELECT * FROM best", ints=["found"],
                                     dbls=["threshold", "f_beta", "recall", "precision"], prefix=_PREFIX))
def optimal_threshold(spark, sf_dir):
    return tidy(MT.optimal_threshold(_scored(spark, sf_dir)))


def _report_sql(t: str) -> str:
    return f"""
SELECT class_name, precision, recall, f1, support FROM (
 SELECT 1 AS o, 'Repay' AS class_name, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM k
 UNION ALL SELECT 2, 'Default', p1, r1, f1, s1 FROM k
 UNION ALL SELECT 3, 'accuracy', NULL, NULL, (tp + tn) / (s0 + s1), s0 + s1 FROM k
 UNION ALL SELECT 4, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM k
 UNION ALL SELECT 5, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
   (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM k) u"""


def _report_cte(t: str) -> tuple[tuple[str, str], ...]:
    base = f"""SELECT tp, fp, fn, tn, tn + fp AS s0, tp + fn AS s1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS r0,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r1
  FROM (SELECT CAST(true_positives AS DOUBLE) AS tp, CAST(false_positives AS DOUBLE) AS fp,
   CAST(false_negatives AS DOUBLE) AS fn, CAST(true_negatives AS DOUBLE) AS tn FROM ({_cm_sql(t)}) m) c"""
    k = """SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f0,
  CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1 FROM kb"""
    return (("kb", base), ("k", k))


_T_OPT = "(SELECT threshold FROM best)"


@query("classification_report", norm_sql(
    _report_sql(_T_OPT), strs=["class_name"], dbls=["precision", "recall", "f1", "support"],
    prefix=A.cte("scored_events", extra=(("curve", _CURVE), ("tot", _TOT), ("grid", _GRID), ("sweep", _SWEEP),
                                         ("best", _BEST)) + _report_cte(_T_OPT))))
def classification_report(spark, sf_dir):
    """Report at the optimal threshold (as the reference prints it)."""
    df = _scored(spark, sf_dir)
    t = float(MT.optimal_threshold(df).first()["threshold"])
    return tidy(MT.classification_report(df, threshold=t))


@query("full_evaluation", norm_sql(
    f"SELECT round(a.roc_auc, 4) AS roc_auc, round(p.average_precision, 4) AS pr_auc, round(b.brier_score, 4) AS brier_score, "
    f"r.*, r.threshold AS optimal_threshold FROM ({_AUC_SQL}) a, ({_AP_SQL}) p, "
    f"(SELECT avg((score - label) * (score - label)) AS brier_score FROM scored_events) b, ({_rates_sql(_T_OPT)}) r",
    ints=_CM_COLS, dbls=["roc_auc", "pr_auc", "brier_score", "optimal_threshold"] + _RATE_DBLS, prefix=_PREFIX))
def full_evaluation(spark, sf_dir):
    return tidy(MT.full_evaluation(_scored(spark, sf_dir)))
