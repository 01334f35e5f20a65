"""Metrics against brute-force definitions on small fixtures; running totals against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskmart.operators import metrics as MT
from riskmart.plans import ranking as RK


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(800) < 0.2).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(800) * 0.7, 0, 1), 2)  # ties on purpose
    pdf = pd.DataFrame({"label": y, "score": s})
    return spark.createDataFrame(pdf), pdf


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def brute_ap(y, s):
    total = 0.0
    for t in np.unique(s):
        sel = s >= t
        tp = (y[sel] == 1).sum()
        total += (y[s == t] == 1).sum() / y.sum() * tp / sel.sum()
    return total


def test_auc_and_ap(scored):
    df, pdf = scored
    y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    assert MT.roc_auc(df).first()[0] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert MT.average_precision(df).first()[0] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_confusion_cells_sum_to_n(scored):
    df, pdf = scored
    r = MT.confusion_matrix(df, threshold=0.4).first()
    assert sum(r) == len(pdf)
    assert r["true_positives"] == int(((pdf.score >= 0.4) & (pdf.label == 1)).sum())


def test_sweep_matches_brute_force_and_is_monotone(scored):
    df, pdf = scored
    sweep = MT.threshold_sweep(df).orderBy("i").toPandas()
    grid = np.linspace(0.01, 0.99, 200)
    assert np.array_equal(sweep["threshold"].to_numpy(), grid)
    tp = [int(((pdf.score >= t) & (pdf.label == 1)).sum()) for t in grid]
    assert sweep["tp"].tolist() == tp
    assert (np.diff(sweep["recall"].to_numpy()) <= 1e-15).all()


def test_optimal_threshold_first_maximum(scored):
    df, pdf = scored
    y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    best, best_t = -1.0, 0.5
    for t in np.linspace(0.01, 0.99, 200):
        p = (s >= t).astype(int)
        tp = ((p == 1) & (y == 1)).sum()
        if tp / y.sum() < 0.7:
            continue
        fp, fn = ((p == 1) & (y == 0)).sum(), ((p == 0) & (y == 1)).sum()
        f2 = 0.0 if tp == 0 else 5 * tp / (5 * tp + 4 * fn + fp)
        if f2 > best:
            best, best_t = f2, t
    assert MT.optimal_threshold(df).first()["threshold"] == pytest.approx(best_t, abs=0)


def test_curves_are_monotone(scored):
    df, _ = scored
    roc = MT.roc_curve(df).orderBy(F.desc("threshold")).toPandas()
    assert (np.diff(roc["fpr"]) >= 0).all() and (np.diff(roc["tpr"]) >= 0).all()
    assert roc["tpr"].iloc[-1] == pytest.approx(1.0)


def test_report_rows(scored):
    df, _ = scored
    rep = {r["class_name"]: r for r in MT.classification_report(df, threshold=0.5).collect()}
    assert set(rep) == {"Repay", "Default", "accuracy", "macro avg", "weighted avg"}
    assert rep["Repay"]["support"] + rep["Default"]["support"] == rep["accuracy"]["support"]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_running_totals_match_pandas(spark, bits):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.random(500), "w": rng.integers(0, 5, 500)})
    pdf = pdf.drop_duplicates(["g", "v"])
    df = spark.createDataFrame(pdf)
    out = RK.running_totals(df, "v", ["w"], RK.unit_bucket(F.col("v"), bits), descending=True, groups=["g"]).toPandas()
    exp = pdf.sort_values(["g", "v"], ascending=[True, False]).assign(c=lambda d: d.groupby("g")["w"].cumsum())
    m = out.merge(exp, on=["g", "v"])
    assert len(m) == len(pdf) and (m["w_cum"] == m["c"]).all()


def test_rank_within_matches_row_number(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 400), "h": rng.integers(0, 2**32, 400), "id": np.arange(400)})
    df = spark.createDataFrame(pdf)
    out = RK.rank_within(df, ["g"], ["h", "id"], RK.hash32_bucket(F.col("h"), 4), total_col="n").toPandas()
    exp = pdf.sort_values(["g", "h", "id"]).assign(r=lambda d: d.groupby("g").cumcount() + 1)
    m = out.merge(exp, on="id")
    assert (m["rank"] == m["r"]).all()
    assert (m["n"] == m["g_x"].map(pdf["g"].value_counts())).all()


def test_running_totals_adaptive_buckets_crowded_scores(spark):
    """Scores crowded into a tiny range still get balanced buckets and exact sums."""
    rng = np.random.default_rng(2)
    v = 0.5 + rng.random(3000) * 1e-7
    pdf = pd.DataFrame({"v": v, "w": rng.integers(0, 3, 3000)}).drop_duplicates("v")
    df = spark.createDataFrame(pdf)
    tagged = RK.adaptive_buckets(df, "v", n_buckets=64)
    sizes = [r[1] for r in tagged.groupBy("_bkt").count().collect()]
    assert len(sizes) > 32 and max(sizes) < len(pdf) / 8
    out = RK.running_totals(df, "v", ["w"], descending=True).toPandas()
    exp = pdf.sort_values("v", ascending=False).assign(c=lambda d: d["w"].cumsum())
    m = out.merge(exp, on="v")
    assert (m["w_cum"] == m["c"]).all()


def test_one_class_input_is_undefined_not_an_error(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, score double")
    assert MT.roc_auc(df).first()[0] is None and MT.average_precision(df).first()[0] is None
    assert MT.optimal_threshold(df).first()["threshold"] == 0.5


def test_rows_without_score_or_label_count_nowhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None), (None, 0.7), (0, 0.8)], "label int, score double")
    known = df.dropna()
    for fn in (MT.confusion_matrix, MT.roc_auc, MT.average_precision, MT.classification_report, MT.full_evaluation):
        assert fn(df).collect() == fn(known).collect()
    assert (MT.threshold_sweep(df).orderBy("i").collect() == MT.threshold_sweep(known).orderBy("i").collect())


def test_metrics_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    df = spark.range(500).selectExpr("cast(id % 3 = 0 as int) AS label", "id % 41 / 41D AS score")
    for fn in (MT.roc_auc, MT.average_precision, MT.roc_curve, MT.pr_curve, MT.threshold_sweep, MT.full_evaluation):
        fn(df).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
