"""Hyper-parameter search for the boosted model, re-aimed to Spark ML.

Candidates come from a low-discrepancy (golden-ratio / R_d) sequence over the configured ranges -
integer, uniform and log-uniform - so a search is reproducible and spreads evenly with few trials.
Each candidate is scored by the stratified k-fold exact ROC-AUC of :func:`training.cross_validate`
(each fit a distributed job; fold fits run concurrently). The search stops at ``n_trials`` or when
the time budget is spent, and returns the trials as a DataFrame plus the best row.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.operators import prep as R
from riskmart.operators import training as TR


@dataclass(frozen=True)
class Dim:
    name: str
    low: float
    high: float
    kind: str = "float"   # "int", "float" or "log"


# Fixed values (must equal the reference): the search ranges of the two booster families.
BOOSTED_SPACE = (
    Dim("n_estimators", 200, 1200, "int"),
    Dim("max_depth", 3, 9, "int"),
    Dim("learning_rate", 0.01, 0.3, "log"),
    Dim("subsample", 0.5, 1.0),
    Dim("colsample_bytree", 0.5, 1.0),
    Dim("min_child_weight", 1, 20, "int"),
    Dim("gamma", 0.0, 5.0),
    Dim("reg_alpha", 1e-4, 10.0, "log"),
    Dim("reg_lambda", 1e-4, 10.0, "log"),
)
LEAFWISE_SPACE = (
    Dim("n_estimators", 200, 1200, "int"),
    Dim("learning_rate", 0.01, 0.3, "log"),
    Dim("num_leaves", 20, 300, "int"),
    Dim("max_depth", 3, 12, "int"),
    Dim("min_child_samples", 20, 200, "int"),
    Dim("subsample", 0.5, 1.0),
    Dim("colsample_bytree", 0.5, 1.0),
    Dim("reg_alpha", 1e-4, 10.0, "log"),
    Dim("reg_lambda", 1e-4, 10.0, "log"),
)
SPACES = {"xgboost": BOOSTED_SPACE, "lightgbm": LEAFWISE_SPACE}
N_TRIALS, TIMEOUT_SECONDS = 100, 3600


def _alphas(d: int) -> list[float]:
    """R_d sequence increments: powers of 1/phi_d, phi_d the unique positive root of x^(d+1) = x + 1."""
    phi = 2.0
    for _ in range(64):
        phi = (1 + phi) ** (1.0 / (d + 1))
    return [(1.0 / phi) ** (j + 1) % 1.0 for j in range(d)]


def candidates(n_trials: int, space: Sequence[Dim] = BOOSTED_SPACE, seed: int = 42) -> list[dict]:
    """Reproducible candidate parameter sets spread evenly over ``space``."""
    alphas = _alphas(len(space))
    start = (seed * 0.6180339887498949) % 1.0
    out = []
    for i in range(n_trials):
        params = {}
        for dim, a in zip(space, alphas):
            u = (start + (i + 1) * a) % 1.0
            if dim.kind == "log":
                v = math.exp(math.log(dim.low) + u * (math.log(dim.high) - math.log(dim.low)))
            else:
                v = dim.low + u * (dim.high - dim.low)
            params[dim.name] = int(min(dim.high, math.floor(v + 0.5))) if dim.kind == "int" else v
        out.append(params)
    return out


def boosted_estimator(p: Mapping[str, float], weight_col: str | None, seed: int = 42,
                      validation_col: str | None = "is_validation", rows: float = 1.0) -> GBTClassifier:
    """Map a candidate onto Spark's GBT: rounds, depth, step, row sampling, per-node feature share,
    minimum rows per node, minimum gain. (L1/L2 leaf penalties have no Spark GBT counterpart.)
    ``gamma`` is a loss reduction summed over the rows while Spark's minimum gain is one per row, so it is
    divided by ``rows``, the training rows of a fit.
    Rounds stop early on the fold's validation share, as in :func:`training.cross_validate`."""
    kw = {"weightCol": weight_col} if weight_col else {}
    if validation_col:
        kw["validationIndicatorCol"] = validation_col
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=int(p["n_estimators"]),
                         maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                         subsamplingRate=float(p["subsample"]), featureSubsetStrategy=str(float(p["colsample_bytree"])),
                         minInstancesPerNode=int(p["min_child_weight"]), minInfoGain=float(p["gamma"]) / max(1.0, rows), seed=seed, **kw)


def search_input(master: DataFrame, threshold: float = R.HIGH_MISSING_THRESHOLD) -> DataFrame:
    """T-14: invalid rows removed and high-missing columns dropped before the search."""
    return R.remove_high_missing_columns(R.remove_invalid_rows(master), threshold)


def run_search(dev: DataFrame, n_trials: int = N_TRIALS, timeout_s: float = TIMEOUT_SECONDS,
               space: Sequence[Dim] = BOOSTED_SPACE, cfg: TR.ModelConfig | None = None, parallelism: int = 8,
               label: str = "TARGET", id_col: str = "SK_ID_CURR", chunk: int = 8) -> tuple[DataFrame, dict]:
    """Trials table ``(trial, params, cv_auc_mean, cv_auc_std, n_folds, seconds, error)`` and the best trial, which
    also tells how many of the candidates were tried and whether the time budget ended the search. A candidate with a failed fold
    has no mean and is never the best; if all have failed, that is raised.

    Candidates are evaluated in chunks through :func:`training.cross_validate`: the preprocessing
    is fitted once per fold for the whole chunk and every (candidate, fold) fit runs concurrently.
    No new chunk starts once the time budget is spent."""
    cfg = cfg or TR.ModelConfig()
    weight = "weight" if "weight" in dev.columns else None
    cands = candidates(n_trials, space, cfg.seed)
    fit_rows = dev.count() * (cfg.n_folds - 1) / cfg.n_folds * (1 - cfg.validation_fraction)
    rows = []
    t_start = time.monotonic()
    for start in range(0, len(cands), max(1, chunk)):
        if time.monotonic() - t_start > timeout_s:
            break
        t0 = time.monotonic()
        batch = {f"trial_{i}": boosted_estimator(cands[i], weight, cfg.seed, rows=fit_rows)
                 for i in range(start, min(start + chunk, len(cands)))}
        scores = TR.cross_validate(dev, cfg, label, id_col, parallelism=parallelism, models=batch, report=True)
        per = {r["model"]: r for r in scores.groupBy("model").agg(
            F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"), F.count("auc").alias("n"), F.min("error").alias("error")).collect()}
        spent = round((time.monotonic() - t0) / len(batch), 3)
        for name in batch:
            i = int(name.split("_")[1])
            r = per.get(name)
            whole = r and r["error"] is None
            rows.append((i, json.dumps(cands[i], sort_keys=True), r["m"] if whole else None, r["s"] if whole else None,
                         int(r["n"]) if r else 0, spent, r["error"] if r else None))
    if rows and all(r[2] is None for r in rows):
        raise TR.FoldError(f"none of {len(rows)} candidates has a value; trial {rows[0][0]}: {rows[0][-1]}")
    spark = dev.sparkSession
    trials = spark.createDataFrame(rows, "trial int, params string, cv_auc_mean double, cv_auc_std double, "
                                         "n_folds int, seconds double, error string")
    best = trials.agg(F.max_by(F.struct("trial", "params", "cv_auc_mean"),
                               F.struct(F.coalesce("cv_auc_mean", F.lit(-1.0)), -F.col("trial"))).alias("b")).first()["b"]
    return trials, {"trial": best["trial"], "params": json.loads(best["params"]), "cv_auc_mean": best["cv_auc_mean"],
                    "tried": len(rows), "stopped_early": len(rows) < len(cands)}
