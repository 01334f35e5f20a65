"""Entry 2 end to end on the sf0.001 adapter tables: validate (skipped: tiny data), build, split,
compare by CV, final fit, test metrics, artifacts; then reload, score and attribute the hold-out."""

import pytest
from pyspark.sql import functions as F

from riskmart.operators import scoring as SC
from riskmart.operators import training as TR
from riskmart.plans import train_run
from riskmart.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("family", ["random_forest"])
def test_train_then_explain(spark, scratch, family):
    tables = A.loan_tables(spark, SF)
    cfg = TR.ModelConfig(n_folds=3, rf_trees=10, models=(family,))
    meta = train_run.train(tables, scratch, cfg, validate=False)
    assert meta["best_model"] == family and 0.0 <= meta["test_roc_auc"] <= 1.0
    assert len(meta["cv"]) == 1 and meta["n_features"] > 100

    model, loaded = TR.load_artifacts(scratch)
    assert loaded["feature_names"][:3] == meta.get("feature_names", loaded["feature_names"])[:3]
    contribs, importance = train_run.explain_holdout(tables, scratch, cfg)
    n_test = contribs.select("id").distinct().count()
    assert n_test > 0 and importance.count() == len(loaded["feature_names"])
    gap = contribs.groupBy("id").agg(
        F.abs(F.sum("contribution") + F.first("base_value") - F.first("margin")).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-6

    from riskmart.plans import master as M
    scored = SC.score_with_model(M.build_master(tables).where("CODE_GENDER <> 'XNA'"), model)
    assert scored.where(F.col("probability").isNull()).count() == 0
    assert set(r[0] for r in scored.select("risk_band").distinct().collect()) <= {
        "Very Low", "Low", "Medium", "High", "Very High"}
