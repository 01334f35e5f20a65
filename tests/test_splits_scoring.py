"""Splits, folds, weights; scoring rules; constraints; attribution completeness; streaming job."""

import math
import time

import pytest
from pyspark.sql import functions as F

from riskmart.functions import expr as X
from riskmart.operators import attribution as AT
from riskmart.operators import quality as Q
from riskmart.operators import scoring as SC
from riskmart.operators import splits as S
from riskmart.sources import adapters as A

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def app(spark):
    return A.adapter(spark, SF, "application").select("SK_ID_CURR", "TARGET").cache()


def test_split_is_stratified_and_reproducible(app):
    s1 = S.stratified_split(app)
    s2 = S.stratified_split(app)
    a = {r[0]: r[1] for r in s1.select("SK_ID_CURR", "split").collect()}
    assert a == {r[0]: r[1] for r in s2.select("SK_ID_CURR", "split").collect()}
    rates = {r["split"]: r["default_rate"] for r in S.split_summary(s1).collect()}
    assert abs(rates["test"] - rates["train"]) < 0.01


def test_folds_disjoint_complete_balanced(app):
    folds = S.stratified_folds(app)
    dev = S.stratified_split(app).where("split = 'train'")
    assert folds.count() == dev.count() == folds.select("SK_ID_CURR").distinct().count()
    sizes = [r[1] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2


def test_hash_has_no_overflow(spark):
    df = spark.createDataFrame([(2**62,), (-5,), (7,)], "x long")
    vals = [r[0] for r in df.select(S.hash32("x", 0)).collect()]
    assert vals[2] == (7 * 2654435761) % 2**32 and all(0 <= v < 2**32 for v in vals)


def test_class_weights_balanced(app):
    w = {r["TARGET"]: r for r in S.class_weights(app).collect()}
    n = sum(r["n_rows"] for r in w.values())
    assert w[1]["weight"] == pytest.approx(n / (2 * w[1]["n_rows"]))


def test_bands_and_recommendations(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.0999, 0.1, 0.25, 0.449, 0.45, 0.65, 0.99, 1.5)], "p double")
    got = [(r[0], r[1]) for r in df.select(X.band_of("p"), X.recommendation_of("p")).collect()]
    assert [g[0] for g in got] == ["Very Low", "Very Low", "Low", "Medium", "Medium", "High", "Very High", "Very High",
                                   "Very High"]
    assert got[0][1] == "Approve" and got[-1][1] == "Decline recommended"


def test_row_constraints_reasons(spark):
    req = spark.createDataFrame(
        [(1, 50_000.0, 200_000.0, 10_000.0, None, 0.6, 30, 2.0, "F", "Working", "Higher education", "Married", "With parents"),
         (2, 500.0, 200_000.0, None, 0.5, 0.6, 15, None, "XNA", "Student", None, None, None)],
        "id long, amt_income_total double, amt_credit double, amt_annuity double, ext_source_2 double, ext_source_3 double, "
        "age_years int, employed_years double, code_gender string, name_income_type string, name_education_type string, "
        "name_family_status string, name_housing_type string")
    out = {r["id"]: r for r in Q.row_constraints(req).collect()}
    assert out[1]["is_valid"] == 1 and out[1]["ext_source_2"] == 0.5
    assert out[2]["n_reasons"] == 5
    assert "amt_annuity: missing" in out[2]["reasons"] and "code_gender: not allowed" in out[2]["reasons"]


def test_linear_attribution_completeness(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 2.0), (3, -1.0, 4.0)], "id long, a double, b double")
    contrib = AT.linear_contributions(df, {"a": 0.5, "b": -2.0}, 0.25, "id")
    gaps = [r["gap"] for r in AT.completeness_gap(contrib).collect()]
    assert max(gaps) < 1e-12
    top = AT.top_factors_per_row(contrib, k=1).where("id = 3").first()
    assert top["feature"] == "b" and top["direction"] == "decreases_risk"


def test_streaming_scoring_job(spark, scratch):
    from riskmart.streaming.scoring_stream import start_scoring_stream

    req = A.adapter(spark, SF, "requests")
    src = f"{scratch}/in"
    req.repartition(3).write.parquet(src)
    q = start_scoring_stream(spark, src, f"{scratch}/out", {"EXT_SOURCE_MEAN": -2.0}, 0.1,
                             checkpoint_dir=f"{scratch}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/out")
    assert out.count() == req.count()
    valid = out.where("is_valid = 1")
    assert valid.where(F.col("probability").isNull()).count() == 0
    assert out.where("is_valid = 0 AND probability IS NOT NULL").count() == 0


def test_no_decision_without_a_score(spark):
    from riskmart.functions import expr as X

    df = spark.createDataFrame([(None,), (0.1,)], "p double")
    rows = df.select("p", X.band_of("p").alias("band"), X.recommendation_of("p").alias("rec")).collect()
    assert rows[0].band is None and rows[0].rec is None and rows[1].band and rows[1].rec
