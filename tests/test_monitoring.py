"""Calibration, drift, metrics by group and the adaptive search against brute force."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmart.operators import calibration as CA
from riskmart.operators import drift as DR
from riskmart.operators import fairness as FA
from riskmart.operators import study as ST
from riskmart.operators.search import LEAFWISE_SPACE, Dim, candidates


def sequential_pav(rows):
    """[(low, high, pos, n)] of (score, label) rows."""
    out = []
    for s in sorted({s for s, _ in rows}):
        ys = [y for t, y in rows if t == s]
        cur = [s, s, sum(ys), len(ys)]
        while out and out[-1][2] * cur[3] >= cur[2] * out[-1][3]:
            last = out.pop()
            cur = [last[0], cur[1], last[2] + cur[2], last[3] + cur[3]]
        out.append(cur)
    return out


def test_isotonic_equals_sequential(spark):
    rng = random.Random(1)
    rows = [(i, s := round(rng.random(), 3), int(rng.random() < s ** 2)) for i in range(3000)]
    odd = [(-1, None, 1), (-2, 0.5, None), (-3, float("nan"), 1)]
    df = spark.createDataFrame(rows + odd, "id int, score double, label int").repartition(7)
    got = [(r.low, r.high, r.n, r.value) for r in CA.isotonic_blocks(df).orderBy("low").collect()]
    want = sequential_pav([(s, y) for _, s, y in rows])
    assert [g[:3] for g in got] == [(a, b, n) for a, b, _, n in want] and len(got) > 8
    assert np.allclose([g[3] for g in got], [p / n for *_, p, n in want])
    out = {r.id: r.calibrated for r in CA.calibrate(df, CA.isotonic_blocks(df)).collect()}
    assert out[-1] is None and out[-3] is None and 0 <= out[-2] <= 1
    for i, s, _ in rows[:200]:
        assert out[i] == pytest.approx(next(p / n for a, b, p, n in want if a <= s <= b))
    none = df.limit(0)
    assert CA.isotonic_blocks(none).count() == 0
    assert CA.calibrate(df.limit(1), CA.isotonic_blocks(none)).first()["calibrated"] is None


def test_pooling_is_associative():
    rng = np.random.default_rng(2)
    s, pos, n = np.arange(300.0), rng.integers(0, 4, 300), np.full(300, 4)
    whole = CA.pooled(s, s, pos, n)
    parts = [CA.pooled(s[a:a + 37], s[a:a + 37], pos[a:a + 37], n[a:a + 37]) for a in range(0, 300, 37)]
    merged = CA.pooled(*(np.concatenate(x) for x in zip(*parts)))
    assert all((a == b).all() for a, b in zip(whole, merged))


def psi(expected, actual):
    e, a = (np.maximum(np.array(x) / max(1, sum(x)), DR.FLOOR) for x in (expected, actual))
    return float(((a - e) * np.log(a / e)).sum())


def test_drift_of_batches_windows_and_streams(spark, scratch):
    rng = np.random.default_rng(4)
    ref = [(None if rng.random() < 0.1 else float(rng.normal()), float(rng.integers(3)), None) for _ in range(800)]
    schema = "x double, k double, never double"
    profile = DR.reference_profile(spark.createDataFrame(ref, schema), ["x", "k", "never"])
    start = datetime(2024, 1, 1)
    new = [(start + timedelta(minutes=int(rng.integers(180))), None if rng.random() < 0.3 else float(rng.normal() + 0.5), float(rng.integers(3)), None) for _ in range(900)]
    new.append((None, 1.0, 1.0, None))
    df = spark.createDataFrame(new, "at timestamp, x double, k double, never double")

    def bins(rows, i, f):
        e = profile.edges[f]
        return [sum((0 if r[i] is None else 1 + sum(v <= r[i] for v in e)) == b for r in rows) for b in range(len(e) + 2)]

    profile.save(spark, f"{scratch}/profile")
    profile = DR.Profile.load(spark, f"{scratch}/profile")
    got = {r.feature: (r.psi, r.status) for r in DR.psi_by_feature(df, profile).collect()}
    for i, f in enumerate(["x", "k", "never"]):
        assert got[f][0] == pytest.approx(psi(bins(ref, i, f), bins(new, i + 1, f)), abs=1e-9)
    assert got["never"] == (0.0, "stable") and got["x"][1] != "stable"

    by_hour = {(r.window_start, r.feature): r.psi for r in DR.psi_by_window(df, profile, "at", "1 hour").collect()}
    assert len(by_hour) == 9
    for h in range(3):
        own = [r for r in new if r[0] and r[0].hour == h]
        assert by_hour[start + timedelta(hours=h), "x"] == pytest.approx(psi(bins(ref, 0, "x"), bins(own, 1, "x")), abs=1e-9)

    # the stream appends closed windows only, once, also over a restart
    df.where("at IS NOT NULL").orderBy("at").coalesce(1).write.parquet(f"{scratch}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{scratch}/in")
    for _ in range(2):
        DR.stream_drift(read(), profile, "at", "1 hour", "0 seconds", f"{scratch}/counts", f"{scratch}/ckpt").awaitTermination()
        late = [(start + timedelta(hours=9), 0.0, 0.0, None)]
        spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    closed = {(r.window_start, r.feature): r.psi for r in DR.psi_of_counts(spark.read.parquet(f"{scratch}/counts"), profile).collect()}
    assert closed == {k: pytest.approx(v) for k, v in by_hour.items()}


def test_group_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [None, "a", "a", "b"][rng.integers(4)], int(rng.random() < 0.3), round(float(rng.random()), 2)) for i in range(500)] + [(900, "c", 1, 0.9)]
    rows += [(901, "a", None, 0.5), (902, "a", 1, None)]
    df = spark.createDataFrame(rows, "id long, g string, label int, score double")
    got = {r.g: r for r in FA.group_metrics(df, "g", replicates=20, level=0.8).collect()}
    weights = {(r.id, r.k): r.w for r in df.select("id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
               .withColumn("w", FA.poisson_weight(F.col("id"), F.col("k"))).collect()}
    drawn = [w for (_, k), w in weights.items() if k]
    assert abs(np.mean(drawn) - 1) < 0.05 and abs(np.var(drawn) - 1) < 0.1

    def auc(own, k):
        pos, neg = ([(s, weights[i, k]) for i, _, y, s in own if y == c] for c in (1, 0))
        total = sum(a * b for _, a in pos for _, b in neg)
        return sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg) / total if total else None

    for g in (None, "a", "b", "c"):
        own = [r for r in rows if r[1] == g and r[2] is not None and r[3] is not None]
        draws = sorted(x for x in (auc(own, k) for k in range(1, 21)) if x is not None)
        r = got[g]
        assert r.n == len(own) and r.selection_rate == pytest.approx(sum(s >= 0.5 for *_, s in own) / len(own))
        if g == "c":
            assert r.auc is None and r.auc_low is None and r.false_positive_rate is None
        else:
            assert r.auc == pytest.approx(auc(own, 0)) and (r.auc_low, r.auc_high) == (pytest.approx(draws[2]), pytest.approx(draws[-3]))
    assert FA.group_metrics(df.limit(0), "g", replicates=2).count() == 0


# ------------------------------------------------------------------ adaptive search

SPACE = (Dim("x", -2.0, 3.0), Dim("rate", 1e-3, 1.0, "log"), Dim("depth", 2, 9, "int"))


def surface(p, _=0):
    return -(p["x"] - 1.3) ** 2 - 0.4 * (math.log10(p["rate"]) + 1.5) ** 2 - 0.05 * (p["depth"] - 6) ** 2


def reference_density(points, u):
    """Mean of cut-off normal densities, computed with error functions alone."""
    xs = sorted(points)
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    total = 0.0
    for i in range(len(xs) + 1):
        if i < len(xs):
            left, right = xs[i] - (xs[i - 1] if i else 0.0), (xs[i + 1] if i + 1 < len(xs) else 1.0) - xs[i]
            m, s = xs[i], min(1.0, max(left, right, 1 / min(100, len(xs) + 2)))
        else:
            m, s = 0.5, 1.0
        total += math.exp(-((u - m) / s) ** 2 / 2) / (s * math.sqrt(2 * math.pi)) / (cdf((1 - m) / s) - cdf(-m / s))
    return total / (len(xs) + 1)


def test_proposals_equal_a_reference_computation():
    done = [ST.Trial(i, p, [surface(p)]) for i, p in enumerate(candidates(25, SPACE, 7))]
    p = ST.propose(done, SPACE, 25, 7)
    ranked = sorted(done, key=lambda t: -t.value)
    for dim in SPACE:
        good, rest = ([ST.to_unit(dim, t.params[dim.name]) for t in part] for part in (ranked[:3], ranked[3:]))
        rng, parzen = random.Random(f"7:25:{dim.name}"), ST.Parzen(good)
        draws = [parzen.draw(rng) for _ in range(ST.DRAWS)]
        best = max(draws, key=lambda u: reference_density(good, u) / reference_density(rest, u))
        assert p[dim.name] == ST.from_unit(dim, best)
        for u in (0.0, 0.31, 1.0):
            assert parzen.density(u) == pytest.approx(reference_density(good, u))
    steps = np.linspace(0, 1, 20001)
    assert np.mean([ST.Parzen([0.02, 0.5, 0.5]).density(u) for u in steps]) == pytest.approx(1, abs=1e-3)
    assert ST.propose([], LEAFWISE_SPACE, 3, 42) == candidates(4, LEAFWISE_SPACE, 42)[3]


def test_study_beats_the_fixed_sequence(spark):
    gains = []
    for seed in range(5):
        trials = ST.run_study(spark, surface, SPACE, n_trials=60, n_folds=1, seed=seed, batch=1)
        assert [t.number for t in trials] == list(range(60)) and not any(t.pruned for t in trials)
        gains.append(max(t.value for t in trials) - max(surface(p) for p in candidates(60, SPACE, seed)))
    assert sum(g > 0 for g in gains) >= 4, gains
    again = ST.run_study(spark, surface, SPACE, n_trials=60, n_folds=1, seed=4, batch=1)
    assert [t.params for t in again] == [t.params for t in trials]


def test_pruning_saves_folds_and_cancels_jobs(spark):
    def objective(p, fold):
        spark.range(10).count()
        if fold == 3 and surface(p) < -3:
            spark.range(1, 2_000_000_000).selectExpr("sum(sqrt(id))").collect()       # runs for a while
        return surface(p) + 0.01 * fold

    trials = ST.run_study(spark, objective, SPACE, n_trials=24, n_folds=4, seed=1, batch=1, startup=6)
    cut = [t for t in trials if t.pruned]
    assert cut and all(t.saved == 4 - len(t.folds) and t.saved > 0 and t.number >= 6 for t in cut)
    table = {r.trial: r for r in ST.trials_table(spark, trials).collect()}
    assert sum(r.folds_saved for r in table.values()) == sum(t.saved for t in cut)
    whole = [t for t in trials if not t.pruned]
    for t in cut:
        k = len(t.folds)
        peers = [sum(o.folds[:k]) / k for o in whole if o.number < t.number]
        assert t.value < float(np.median(peers))
    assert json.loads(table[0].params) == candidates(1, SPACE, 1)[0]


def test_failing_trials_are_recorded(spark):
    def objective(p, fold):
        if p["x"] < 0.5:
            raise ValueError("no")
        return p["x"]

    trials = ST.run_study(spark, objective, SPACE, n_trials=4, n_folds=2, batch=2)
    table = ST.trials_table(spark, trials)
    assert table.where("error LIKE 'ValueError%' AND cv_auc_mean IS NULL").count() == sum(t.params["x"] < 0.5 for t in trials) > 0
    best = ST.best_trial(table.select("trial", "cv_auc_mean")).first()
    assert best["cv_auc_mean"] == max(t.value for t in trials if t.value is not None)
    assert ST.best_trial(table.where("false").select("trial", "cv_auc_mean")).count() == 0


def test_tune_family(spark):
    from riskmart.operators import training as TR

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    rows = [(i, int(x[i, 0] + 0.3 * rng.normal() > 0.8), float(x[i, 0]), float(x[i, 1]), "fm"[i % 2]) for i in range(300)]
    dev = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, a double, b double, CODE_GENDER string")
    space = (Dim("n_estimators", 1, 2, "int"), Dim("learning_rate", 0.2, 0.6, "log"), Dim("max_depth", 1, 2, "int"), Dim("reg_lambda", 0.1, 2.0, "log"))
    table, best = ST.tune_family(dev, "xgboost", TR.ModelConfig(n_folds=2), n_trials=2, space=space)
    assert best["tried"] == 2 and not best["stopped_early"] and table.count() == 2
    assert best["cv_auc_mean"] == table.agg(F.max("cv_auc_mean")).first()[0] > 0.9
