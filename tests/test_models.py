"""Model fits on a small frame: tree attribution completeness, artifacts round trip, search, caching."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskmart.operators import attribution as AT
from riskmart.operators import search as SE
from riskmart.operators import tree_attribution as TA


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=300)) > 0).astype(float)
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, c double, d double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).cache()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_contributions_complete(frame, kind):
    est = (RandomForestClassifier(numTrees=5, maxDepth=4, seed=3) if kind == "forest"
           else GBTClassifier(maxIter=5, maxDepth=3, seed=3))
    model = est.fit(frame)
    bg = AT.background_sample(frame, "id", 20)
    rows = frame.where("id < 15")
    contrib = TA.tree_contributions(model, kind, rows, bg, ["a", "b", "c", "d"], "id")
    gaps = AT.completeness_gap(contrib).agg(F.max("gap")).first()[0]
    assert gaps < 1e-9
    # the boosted margin equals Spark's raw prediction (class-1 side)
    if kind == "boosted":
        from pyspark.ml.functions import vector_to_array
        raw = {r[0]: r[1] for r in model.transform(rows).select("id", vector_to_array("rawPrediction")[1]).collect()}
        ours = {r[0]: r[1] for r in contrib.groupBy("id").agg(F.first("margin")).collect()}
        assert all(abs(raw[k] - ours[k]) < 1e-9 for k in raw)
    # the forest's margin equals Spark's own probability of class 1
    if kind == "forest":
        from pyspark.ml.functions import vector_to_array
        spark_p = {r[0]: r[1] for r in model.transform(rows).select("id", vector_to_array("probability")[1]).collect()}
        ours = {r[0]: r[1] for r in contrib.groupBy("id").agg(F.first("margin")).collect()}
        assert all(abs(spark_p[k] - ours[k]) < 1e-9 for k in spark_p)


def test_candidates_within_ranges():
    cands = SE.candidates(50)
    assert len({tuple(sorted(c.items())) for c in cands}) == 50
    for c in cands:
        for d in SE.BOOSTED_SPACE:
            assert d.low <= c[d.name] <= d.high


def test_search_runs(spark):
    from riskmart.sources import adapters as A
    from riskmart.plans import master as M
    from riskmart.operators import training as TR

    master = M.build_master(A.loan_tables(spark, "/root/testdata/sf0.001"))
    dev = TR.prepare_training_frame(SE.search_input(master)).select(
        "SK_ID_CURR", "TARGET", "label", "weight", "EXT_SOURCE_MEAN", "CREDIT_INCOME_RATIO", "CODE_GENDER").cache()
    space = (SE.Dim("n_estimators", 2, 4, "int"), SE.Dim("max_depth", 2, 3, "int"),
             SE.Dim("learning_rate", 0.05, 0.3, "log"), SE.Dim("subsample", 0.8, 1.0),
             SE.Dim("colsample_bytree", 0.5, 1.0), SE.Dim("min_child_weight", 1, 3, "int"), SE.Dim("gamma", 0.0, 0.1))
    cfg = TR.ModelConfig(n_folds=3)
    trials, best = SE.run_search(dev, n_trials=2, space=space, cfg=cfg)
    assert trials.count() == 2 and best["trial"] in (0, 1)
    assert best["tried"] == 2 and not best["stopped_early"]


def test_every_candidate_splits_its_first_tree(frame):
    """The configured range of gamma is a loss sum: as a gain per row it would forbid all splits."""
    n = frame.count()
    for p in SE.candidates(8):
        p.update(n_estimators=1, max_depth=3, min_child_weight=1)
        model = SE.boosted_estimator(p, None, validation_col=None, rows=n).fit(frame)
        assert model.trees[0].numNodes > 1, p


def test_artifacts_round_trip(spark, scratch, frame):
    from pyspark.ml import Pipeline
    from riskmart.operators import training as TR

    model = Pipeline(stages=[GBTClassifier(maxIter=3, maxDepth=2)]).fit(frame)
    TR.save_artifacts(model, ["a", "b", "c", "d"], {"best_model": "gbt"}, scratch, "v2")
    loaded, meta = TR.load_artifacts(scratch, ("v3", "v2"))
    assert meta["feature_names"] == ["a", "b", "c", "d"] and meta["threshold"] == 0.5
    assert TR.model_info(f"{scratch}/nothing")["status"] == "model not found"


def test_cached_master_and_missing_files(spark, scratch):
    from riskmart.plans import master as M
    from riskmart.sources import adapters as A
    from riskmart.sources import tables as TB

    raw = f"{scratch}/raw"
    for name, df in A.loan_tables(spark, "/root/testdata/sf0.001").items():
        df.write.parquet(f"{raw}/{name}.parquet")
    with pytest.raises(TB.MissingTableError):
        TB.load_table(spark, scratch, "application")
    built = M.load_or_build_master(spark, raw, f"{scratch}/cache", validate=False)
    again = M.load_or_build_master(spark, raw, f"{scratch}/cache", validate=False)
    assert built.count() == again.count() == 150
    with pytest.raises(Exception):
        M.load_or_build_master(spark, raw, f"{scratch}/cache2", validate=True)  # min-row checks fail on tiny data


def test_cache_key_tells_inputs_apart():
    from riskmart.plans import master as M

    long = "s3://bucket/" + "x" * 200
    keys = {M._source_key(p, f) for p in ("s3://b/raw-v1", "s3://b/raw_v1", "a" + long, "b" + long) for f in ("csv", "parquet")}
    assert len(keys) == 8 and M._source_key("s3://b/raw/", "csv") == M._source_key("s3://b/raw", "csv")


def test_csv_reader_nulls_tokens(spark, scratch):
    from riskmart.sources import tables as TB

    p = f"{scratch}/bureau_balance.csv"
    with open(p, "w") as fh:
        fh.write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,NaN\n1,-2,XNA\n2,,C\n")
    df = TB.load_table(spark, scratch, "bureau_balance", fmt="csv") if False else TB.read_csv_table(
        spark, p, TB.SCHEMAS["bureau_balance"])
    rows = df.orderBy("SK_ID_BUREAU", F.desc("MONTHS_BALANCE")).collect()
    assert rows[0]["STATUS"] is None and rows[1]["STATUS"] == "XNA" and rows[2]["MONTHS_BALANCE"] is None


def test_tree_shap_equals_brute_force_shapley(frame):
    import itertools
    import math

    model = GBTClassifier(maxIter=4, maxDepth=3, seed=5).fit(frame)
    trees, weights = TA.tree_tables(model, "boosted")
    data = np.asarray([r["features"].toArray() for r in frame.select("features").limit(12).collect()])
    x, Z = data[0], data[1:]

    def f(M):
        return sum(w * TA._predict_tree(t, M) for t, w in zip(trees, weights))

    n = 4
    brute = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for S in itertools.combinations(others, k):
                coef = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                with_i, without = Z.copy(), Z.copy()
                for j in S:
                    with_i[:, j] = x[j]
                    without[:, j] = x[j]
                with_i[:, i] = x[i]
                brute[i] += coef * (f(with_i).mean() - f(without).mean())
    phi = np.zeros(n)
    for t, w in zip(trees, weights):
        TA._tree_shap(t, x, Z, phi, float(w))
    assert np.allclose(phi, brute, atol=1e-12)


def test_load_config(scratch):
    from riskmart.operators import training as TR

    p = f"{scratch}/cfg.yaml"
    with open(p, "w") as fh:
        fh.write("cv:\n  n_splits: 3\n  random_state: 7\nrandom_forest:\n  n_estimators: 20\n"
                 "threshold:\n  beta: 2.0\n  min_recall: 0.7\n")
    cfg, doc = TR.load_config(p)
    assert cfg.n_folds == 3 and cfg.seed == 7 and cfg.rf_trees == 20 and cfg.lr_c == 0.01
    assert doc["threshold"]["min_recall"] == 0.7


def test_hot_applicant_pack_and_plan(spark):
    """One applicant holds a third of the rows: results stay exact and the plan pre-aggregates
    map-side (partial HashAggregate below the shuffle)."""
    from riskmart.operators import packs as P

    rows = [(1 if i % 3 == 0 else 1000 + i, i, float(i % 50), float(i % 7)) for i in range(30000)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double")
    df = (df.withColumn("AMT_INSTALMENT", F.lit(10.0)).withColumn("AMT_PAYMENT", F.lit(9.0))
          .withColumn("NUM_INSTALMENT_VERSION", F.lit(1.0)).repartition(8))
    out = P.installment_features(df)
    hot = out.where("SK_ID_CURR = 1").first()
    assert hot["INSTAL_COUNT"] == 10000 and hot["INSTAL_NUM_UNIQUE_LOANS"] == 10000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan or "Partial" in plan


def test_vector_contributions_match_fitted_logistic_margin(frame):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    lr = LogisticRegression(regParam=0.01, maxIter=50).fit(frame)
    contrib = AT.vector_contributions(frame, "features", ["a", "b", "c", "d"], lr.coefficients.toArray().tolist(),
                                      float(lr.intercept), "id")
    ours = {r[0]: r[1] for r in contrib.groupBy("id").agg(F.first("margin")).collect()}
    raw = {r[0]: r[1] for r in lr.transform(frame).select("id", vector_to_array("rawPrediction")[1]).collect()}
    assert all(abs(ours[k] - raw[k]) < 1e-9 for k in raw)
    assert AT.completeness_gap(contrib).agg(F.max("gap")).first()[0] < 1e-9


def test_csv_tables_build_the_same_master(spark, scratch):
    from riskmart.plans import master as M
    from riskmart.sources import adapters as A
    from riskmart.sources import tables as TB

    raw = f"{scratch}/csv"
    loan = A.loan_tables(spark, "/root/testdata/sf0.001")
    for name, df in loan.items():
        df.write.option("header", True).csv(f"{raw}/{TB.RAW_FILES[name]}")
    from_csv = M.build_master(TB.load_all(spark, raw, fmt="csv"))
    from_parquet = M.build_master(loan)
    cols = ["SK_ID_CURR", "BUREAU_LOAN_COUNT", "PREV_APP_COUNT", "INSTAL_COUNT", "POS_COUNT", "CC_COUNT",
            "EXT_SOURCE_MEAN"]
    a = sorted(tuple(r) for r in from_csv.select(*cols).collect())
    b = sorted(tuple(r) for r in from_parquet.select(*cols).collect())
    assert len(a) == len(b) == 150
    for x, y in zip(a, b):
        assert x[:6] == y[:6]
        assert (x[6] is None and y[6] is None) or abs(x[6] - y[6]) < 1e-12


def test_tree_shap_of_a_deep_tree_takes_one_walk():
    """A depth-8 tree over many features: contributions add up for every row, in a walk over the nodes (by sets of path
    features it took 3^8 masks a leaf)."""
    import time

    rng = np.random.default_rng(2)
    n, inner = 2 ** 9 - 1, np.arange(2 ** 9 - 1) < 2 ** 8 - 1
    t = {"feature": np.where(inner, rng.integers(0, 60, n), -1), "threshold": rng.normal(size=n) / 2, "value": rng.normal(size=n), "root": 0,
         "left": np.where(inner, 2 * np.arange(n) + 1, -1), "right": np.where(inner, 2 * np.arange(n) + 2, -1)}
    X, Z, phi = rng.normal(size=(1000, 60)), rng.normal(size=(100, 60)), np.zeros((1000, 60))
    t0 = time.monotonic()
    TA._tree_shap_batch(t, X, Z, phi, 0.5)
    assert time.monotonic() - t0 < 8
    assert np.allclose(phi.sum(axis=1), 0.5 * (TA._predict_tree(t, X) - TA._predict_tree(t, Z).mean()), atol=1e-12)


def test_the_split_is_read_from_few_written_parts(spark):
    from riskmart.operators import training as TR
    from riskmart.plans import q_training as Q

    dev, test = Q._split_master(spark, "/root/testdata/sf0.001")
    for df in (dev, test):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and df.inputFiles()
    assert dev.count() + test.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey % 97 <> 0").count()
    df = spark.range(9000).repartition(50)
    many = TR.spread(df, "id", "spread")
    assert len(many.inputFiles()) == 5 and sorted(r.id for r in many.collect()) == list(range(9000))


def test_a_counted_table_is_written_once(spark, monkeypatch):
    from riskmart.operators import training as TR

    calls = []
    monkeypatch.setattr(TR, "written", lambda df, name, _w=TR.written: calls.append(name) or _w(df, name))
    out = TR.spread(spark.range(9000).repartition(50), "id", "spread", 9000)
    assert calls == ["spread"] and len(out.inputFiles()) == 5 and sorted(r.id for r in out.collect()) == list(range(9000))


def test_a_failed_fold_is_no_result(spark):
    """A fit that fails in one fold, or a held-out fold of one class: cross-validation raises, a mean of the other folds is no result."""
    from pyspark.ml.classification import LogisticRegression
    from riskmart.operators import training as TR

    class Fails(LogisticRegression):
        def _fit(self, df):
            if df.where("SK_ID_CURR = 7").isEmpty():
                raise ValueError("no fit without row 7")
            return super()._fit(df)

    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(i % 3 == 0), float(rng.normal() + i % 3)) for i in range(90)]
    dev = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, label double, x double")
    cfg, models = TR.ModelConfig(n_folds=3), {"fails": Fails(maxIter=3), "works": LogisticRegression(maxIter=3)}
    with pytest.raises(TR.FoldError, match="1 of 6 folds.*fails, fold .*no fit without row 7"):
        TR.cross_validate(dev, cfg, models=models)
    table = TR.comparison_table(TR.cross_validate(dev, cfg, models=models, report=True))
    got = {r["model"]: r for r in table.collect()}
    assert got["works"]["n_folds"] == 3 and got["works"]["is_best"] == 1 and got["works"]["cv_auc_mean"] is not None
    assert [got["fails"][c] for c in ("cv_auc_mean", "cv_auc_std", "cv_auc_min", "cv_auc_max", "n_folds", "position")] == [None] * 4 + [2, 2]
    one = dev.where("TARGET = 0 OR SK_ID_CURR = 3")                     # a single positive row: two folds hold none
    with pytest.raises(TR.FoldError, match="both classes"):
        TR.cross_validate(one, cfg, models={"works": LogisticRegression(maxIter=3)})
