"""Preprocessing stages: drop-missing, XNA filter, capping, imputers, encoder, persistence, exact quantiles."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskmart.operators import prep as R
from riskmart.operators.quantiles import exact_quantiles


@pytest.fixture
def frame(spark):
    rows = [(1, 80_000.0, 300_000.0, 0.5, "F", "Working", None), (2, 1e9, 400_000.0, 0.4, "XNA", "Pensioner", None),
            (3, 60_000.0, None, None, "M", None, None), (4, 70_000.0, 350_000.0, 0.7, None, "Working", 3.0)]
    return spark.createDataFrame(rows, "SK_ID_CURR long, AMT_INCOME_TOTAL double, AMT_CREDIT double, EXT_SOURCE_2 double, "
                                       "CODE_GENDER string, NAME_INCOME_TYPE string, MOSTLY_EMPTY double")


def test_drop_high_missing(frame):
    assert "MOSTLY_EMPTY" not in R.remove_high_missing_columns(frame, 0.4).columns
    assert "MOSTLY_EMPTY" in R.remove_high_missing_columns(frame, 0.9).columns
    assert "EXT_SOURCE_2" in R.remove_high_missing_columns(frame, 0.25).columns  # 1 of 4 missing: not above


def test_remove_invalid_rows(frame, spark):
    ids = {r[0] for r in R.remove_invalid_rows(frame).select("SK_ID_CURR").collect()}
    assert ids == {1, 3, 4}  # NULL gender kept
    other = spark.createDataFrame([(1,)], "x int")
    assert R.remove_invalid_rows(other).count() == 1


def test_cap_outliers_lowers_extreme_keeps_median(frame):
    capped = R.cap_outliers(frame)
    mx = capped.agg({"AMT_INCOME_TOTAL": "max"}).first()[0]
    assert mx < 1e9
    vals = sorted(r[0] for r in capped.select("AMT_INCOME_TOTAL").collect())
    assert vals[1] == 70_000.0 and vals[0] == 60_000.0


def test_imputers_scaler_encoder_and_unknown(frame, spark, scratch):
    num, cat = ["AMT_CREDIT", "EXT_SOURCE_2"], ["NAME_INCOME_TYPE", "CODE_GENDER"]
    pipe, names = R.build_preprocessor(frame.select(*num, *cat), exclude=())
    assert names == num + cat
    model = pipe.fit(frame)
    unseen = spark.createDataFrame([(None, 0.9, "Student", "F")], "AMT_CREDIT double, EXT_SOURCE_2 double, "
                                                                  "NAME_INCOME_TYPE string, CODE_GENDER string")
    row = model.transform(unseen).first()
    vec = row["features"].toArray()
    assert not np.isnan(vec).any()
    assert vec[2] == -1.0  # unseen category
    model.write().overwrite().save(f"{scratch}/prep")
    again = PipelineModel.load(f"{scratch}/prep")
    assert np.allclose(again.transform(unseen).first()["features"].toArray(), vec)


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert R.column_modes(df, ["c"]) == {"c": "a"}


def test_population_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = R.PopulationScaler(inputCols=["a", "b"]).fit(df).transform(df).collect()
    assert [r["a"] for r in out] == [-1.0, 1.0] and [r["b"] for r in out] == [0.0, 0.0]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.lognormal(10, 2, 3000)
    b = np.round(rng.normal(0, 1, 3000), 1)  # many ties
    pdf_rows = [(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(pdf_rows, "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.01, 0.5, 0.99])
    bb = np.array([r[1] for r in pdf_rows if r[1] is not None])
    for p, v in zip([0.01, 0.5, 0.99], got["a"]):
        assert v == pytest.approx(np.quantile(a, p), rel=1e-12)
    for p, v in zip([0.01, 0.5, 0.99], got["b"]):
        assert v == pytest.approx(np.quantile(bb, p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_of_many_rows_with_infinities(spark):
    df = spark.range(120_001).selectExpr(
        "CASE WHEN id % 40000 = 7 THEN double('inf') WHEN id % 50000 = 9 THEN double('-inf') ELSE pmod(id * 7919, 120001) / 8e0 END AS a",
        "double(id % 3) AS ties", "cast(NULL AS double) AS nothing", "CASE WHEN id = 5 THEN 2e0 END AS one")
    got = exact_quantiles(df, df.columns, [0.0, 0.25, 0.5, 0.999, 1.0])
    a = np.sort([r.a for r in df.select("a").collect()])
    assert got["a"][0] == -np.inf and got["a"][4] == np.inf
    assert got["a"][1:4] == pytest.approx(np.quantile(a[np.isfinite(a) | True], [0.25, 0.5, 0.999]).tolist())
    assert got["ties"] == [0.0, 0.0, 1.0, 2.0, 2.0] and got["nothing"] == [None] * 5 and got["one"] == [2.0] * 5


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "id int, c string")
    out = {r["id"]: r for r in R.one_hot_drop_first(df).collect()}
    assert set(out[1].asDict()) == {"id", "c_y", "c_z"}
    assert out[3]["c_y"] == 0 and out[3]["c_z"] == 0 and out[2]["c_y"] == 1


def test_large_vocabulary_is_encoded_whole(spark):
    df = spark.range(50_000).selectExpr("format_string('v%06d', id) AS c", "cast(null as string) AS nothing", "id")
    model = R.OrdinalIndexer(inputCols=["c", "nothing"]).fit(df)
    seen = spark.createDataFrame([("v000000",), ("v049999",), ("other",), (None,)], "c string").withColumn("nothing", F.lit("x"))
    out = [tuple(r) for r in model.transform(seen).collect()]
    assert out == [(0.0, -1.0), (49_999.0, -1.0), (-1.0, -1.0), (-1.0, -1.0)]
    assert model.transform(df).where("c <> id").count() == 0
