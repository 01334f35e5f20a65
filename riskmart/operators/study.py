"""Adaptive parameter search: Parzen-density proposals, median pruning, trials as a table.

A trial is a parameter set and its value per fold; its value is their mean. Once ``STARTUP`` trials have ended, the
next proposal draws candidates from the density of the good trials' parameters and takes the one with the
largest ratio to the density of the others. Trials run in batches: all of a batch are proposed from the trials
ended before, so a study is reproducible whatever runs first. The folds of a trial are distributed Spark
jobs that carry the trial's tag; a trial whose running mean falls below the median of the ended trials at the same
fold is pruned, and the jobs of its other folds are cancelled by tag.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from statistics import NormalDist, median
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.search import N_TRIALS, SPACES, TIMEOUT_SECONDS, Dim, candidates
from riskmart.session import written

# Fixed values (must equal the reference): trials before the sampler adapts and before anything is pruned, 10 each.
STARTUP = 10
#: Candidates drawn per parameter; share and largest number of trials that count as good.
DRAWS, GOOD_SHARE, GOOD_MOST = 24, 0.1, 25
#: Folds a trial always runs.
WARMUP = 1


@dataclass
class Trial:
    number: int
    params: dict
    folds: list[float | None] = field(default_factory=list)
    pruned: bool = False
    saved: int = 0
    seconds: float = 0.0
    error: str | None = None

    @property
    def value(self) -> float | None:
        known = [x for x in self.folds if x is not None]
        return sum(known) / len(known) if known else None


def to_unit(dim: Dim, v: float) -> float:
    lo, hi, x = (math.log(z) for z in (dim.low, dim.high, v)) if dim.kind == "log" else (dim.low, dim.high, v)
    return (x - lo) / (hi - lo) if hi > lo else 0.5


def from_unit(dim: Dim, u: float) -> float:
    if dim.kind == "log":
        return math.exp(math.log(dim.low) + u * (math.log(dim.high) - math.log(dim.low)))
    v = dim.low + u * (dim.high - dim.low)
    return int(min(dim.high, math.floor(v + 0.5))) if dim.kind == "int" else v


class Parzen:
    """Mixture of normal densities cut off at 0 and 1: one per point, as wide as the larger gap to its neighbours, and
    a flat-ish one for the whole range."""

    def __init__(self, points: Sequence[float]):
        xs = sorted(points)
        ends = [0.0, *xs, 1.0]
        least = 1.0 / min(100, len(xs) + 2)
        self.parts = [(x, min(1.0, max(x - ends[i], ends[i + 2] - x, least))) for i, x in enumerate(xs)] + [(0.5, 1.0)]

    def density(self, u: float) -> float:
        total = 0.0
        for m, s in self.parts:
            n = NormalDist(m, s)
            total += n.pdf(u) / (n.cdf(1) - n.cdf(0))
        return total / len(self.parts)

    def draw(self, rng: random.Random) -> float:
        n = NormalDist(*self.parts[rng.randrange(len(self.parts))])
        a, b = n.cdf(0), n.cdf(1)
        return min(1.0, max(0.0, n.inv_cdf(min(1 - 1e-12, max(1e-12, a + rng.random() * (b - a))))))


def propose(done: Sequence[Trial], space: Sequence[Dim], number: int, seed: int, startup: int = STARTUP) -> dict:
    """Parameters of trial ``number`` from the trials that have ended (pruned ones count by the folds they ran).
    The first ``startup`` come from the low-discrepancy sequence."""
    known = sorted((t for t in done if t.value is not None), key=lambda t: (-t.value, t.number))
    if number < startup or len(known) < 2:
        return candidates(number + 1, space, seed)[number]
    n_good = min(math.ceil(GOOD_SHARE * len(known)), GOOD_MOST)
    out = {}
    for dim in space:
        good, rest = (Parzen([to_unit(dim, t.params[dim.name]) for t in part]) for part in (known[:n_good], known[n_good:]))
        rng = random.Random(f"{seed}:{number}:{dim.name}")
        draws = [good.draw(rng) for _ in range(DRAWS)]
        out[dim.name] = from_unit(dim, max(draws, key=lambda u: good.density(u) / rest.density(u)))
    return out


def falls_behind(folds: Sequence[float], done: Sequence[Trial], startup: int = STARTUP, warmup: int = WARMUP) -> bool:
    """Whether a trial with these fold values so far is below the median of the unpruned ended trials at that fold."""
    k = len(folds)
    peers = [sum(t.folds[:k]) / k for t in done if not t.pruned and len(t.folds) >= k and None not in t.folds[:k]]
    return k > warmup and len(peers) >= max(1, startup) and sum(folds) / k < median(peers)


def _run_trial(spark: SparkSession, trial: Trial, objective: Callable[[Mapping, int], float], n_folds: int, done: Sequence[Trial],
               startup: int, warmup: int, tag: str) -> Trial:
    began, sc = time.monotonic(), spark.sparkContext

    def fold(k: int) -> float:
        sc.addJobTag(tag)
        try:
            return objective(trial.params, k)
        finally:
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(max_workers=n_folds) as pool:
        futures = [pool.submit(fold, k) for k in range(n_folds)]
        for k, f in enumerate(futures):
            try:
                trial.folds.append(f.result())
            except Exception as e:  # noqa: BLE001 - a failing parameter set is a result of the study, not its end
                trial.folds.append(None)
                trial.error = f"{type(e).__name__}: {e}"[:500]
                continue
            if None not in trial.folds and k + 1 < n_folds and falls_behind(trial.folds, done, startup, warmup):
                trial.pruned, trial.saved = True, n_folds - k - 1
                for rest in futures[k + 1:]:
                    rest.cancel()
                sc.cancelJobsWithTag(tag)
                break
    trial.seconds = round(time.monotonic() - began, 3)
    return trial


def run_study(spark: SparkSession, objective: Callable[[Mapping, int], float], space: Sequence[Dim], *, n_trials: int, n_folds: int,
              seed: int = 42, batch: int = 4, timeout_s: float = math.inf, startup: int = STARTUP, warmup: int = WARMUP) -> list[Trial]:
    """The trials in order. ``objective(params, fold)`` gives the value of a fold (larger is better); what it raises counts as
    no value. No new batch starts once the time is spent."""
    done: list[Trial] = []
    began = time.monotonic()
    while len(done) < n_trials and time.monotonic() - began <= timeout_s:
        numbers = range(len(done), min(n_trials, len(done) + batch))
        ended = list(done)
        trials = [Trial(i, propose(ended, space, i, seed, startup)) for i in numbers]
        with ThreadPoolExecutor(max_workers=len(trials)) as pool:
            done += pool.map(lambda t: _run_trial(spark, t, objective, n_folds, ended, startup, warmup, f"study-{id(trials)}-{t.number}"), trials)
    return done


def trials_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """(trial, params, mean, std, n_folds, pruned, folds_saved, seconds, error): one row per trial."""
    rows = []
    for t in trials:
        known = [x for x in t.folds if x is not None]
        std = math.sqrt(sum((x - t.value) ** 2 for x in known) / len(known)) if known else None
        rows.append((t.number, json.dumps(t.params, sort_keys=True), t.value, std, len(known), t.pruned, t.saved, t.seconds, t.error))
    return spark.createDataFrame(rows, "trial int, params string, cv_auc_mean double, cv_auc_std double, n_folds int, pruned boolean, "
                                       "folds_saved int, seconds double, error string")


def fold_means(folds: DataFrame) -> DataFrame:
    """(trial, cv_auc_mean, cv_auc_std, n_folds) of a table (trial, fold, auc)."""
    return folds.groupBy("trial").agg(F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std"), F.count("auc").alias("n_folds"))


def best_trial(means: DataFrame) -> DataFrame:
    """The row with the largest mean; of equal ones the first trial. Trials without a value never win."""
    order = F.struct("cv_auc_mean", -F.col("trial"))
    return (means.where("cv_auc_mean IS NOT NULL").agg(F.max_by(F.struct(*means.columns), order).alias("b")).where("b IS NOT NULL").select("b.*"))


def family_objective(dev: DataFrame, family: str, cfg=None, label: str = "TARGET", id_col: str = "SK_ID_CURR",
                     exclude: Sequence[str] = ()) -> Callable[[Mapping, int], float]:
    """Objective of a study over a booster family: exact AUC on a fold's rows of a model fitted on the other folds, all
    rounds (no early stopping inside folds). The preprocessing is fitted once per fold, and the fold's vectors are
    written to the shared folder for all trials."""
    from riskmart.operators import boosting as B
    from riskmart.operators import metrics as MT
    from riskmart.operators import prep as R
    from riskmart.operators import splits as S
    from riskmart.operators import training as TR
    from riskmart.operators.booster_stage import Booster

    cfg = cfg or TR.ModelConfig()
    folded = written(S.stratified_folds(dev, label, id_col, cfg.n_folds, test_fraction=0.0, seed=cfg.seed), "study-folds")
    drop = {*exclude, id_col, label, "label", "weight", "fold"}
    names = [c for c in folded.columns if c not in drop]
    base = replace(B.family_params(family, cfg.boosters), patience=None, seed=cfg.seed)
    locks = [Lock() for _ in range(cfg.n_folds)]
    held: dict[int, tuple[DataFrame, DataFrame]] = {}

    def vectors(k: int) -> tuple[DataFrame, DataFrame]:
        with locks[k]:
            if k not in held:
                train = folded.where(F.col("fold") != k)
                prep = R.build_preprocessor(train.select(*names))[0].fit(train)
                held[k] = tuple(written(prep.transform(part).select(id_col, F.col(label).cast("double").alias("label"), "features"), "study-vectors")
                                for part in (train, folded.where(F.col("fold") == k)))
        return held[k]

    def objective(params: Mapping, k: int) -> float:
        train, test = vectors(k)
        model = Booster(params_json=json.dumps(asdict(B.with_config(base, family, params))), idCol=id_col).fit(train)
        return MT.roc_auc(TR.predict_proba(model, test, ["label"]), "label", "score").first()[0]

    return objective


def tune_family(dev: DataFrame, family: str, cfg=None, *, n_trials: int = N_TRIALS, timeout_s: float = TIMEOUT_SECONDS, batch: int = 2,
                space: Sequence[Dim] | None = None, **kw) -> tuple[DataFrame, dict]:
    """Adaptive search of a family over its ranges: the trials table, and the best trial with what the study has spent."""
    from riskmart.operators import training as TR

    cfg = cfg or TR.ModelConfig()
    trials = run_study(dev.sparkSession, family_objective(dev, family, cfg, **kw), space or SPACES[family], n_trials=n_trials, n_folds=cfg.n_folds,
                       seed=cfg.seed, batch=batch, timeout_s=timeout_s)
    whole = [t for t in trials if t.value is not None and not t.pruned]
    best = max(whole, key=lambda t: (t.value, -t.number), default=None)
    return trials_table(dev.sparkSession, trials), {
        "trial": best and best.number, "params": best and best.params, "cv_auc_mean": best and best.value, "tried": len(trials),
        "pruned": sum(t.pruned for t in trials), "folds_saved": sum(t.saved for t in trials), "stopped_early": len(trials) < n_trials}
