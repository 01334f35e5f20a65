"""Catalogue entries: splits, class weights and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.operators import prep as R
from riskmart.operators import splits as S
from riskmart.plans.registry import query
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A

_APP = A.cte("application")
_H = f"(xor(SK_ID_CURR, {S.SEED}) * 2654435761) % 4294967296"
_RANKED = f"""SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY {_H}, SK_ID_CURR) AS rn,
 count(*) OVER (PARTITION BY TARGET) AS n_cls FROM application"""
_SPLIT = f"""SELECT SK_ID_CURR, TARGET, CASE WHEN rn <= round(1.5e-1 * n_cls) THEN 'test' ELSE 'train' END AS split
 FROM ({_RANKED}) r"""


def _app(spark, sf_dir):
    return A.adapter(spark, sf_dir, "application")


@query("stratified_split", norm_sql(_SPLIT, ints=["SK_ID_CURR", "TARGET"], strs=["split"], prefix=_APP))
def stratified_split(spark, sf_dir):
    return tidy(S.stratified_split(_app(spark, sf_dir).select("SK_ID_CURR", "TARGET")))


@query("stratified_folds", norm_sql(
    f"SELECT SK_ID_CURR, TARGET, (rn - round(1.5e-1 * n_cls) - 1) % {S.N_FOLDS} AS fold FROM ({_RANKED}) r "
    f"WHERE rn > round(1.5e-1 * n_cls)", ints=["SK_ID_CURR", "TARGET", "fold"], prefix=_APP))
def stratified_folds(spark, sf_dir):
    return tidy(S.stratified_folds(_app(spark, sf_dir).select("SK_ID_CURR", "TARGET")))


@query("class_weights", norm_sql(
    "SELECT TARGET, count(*) AS n_rows, (SELECT CAST(count(*) AS DOUBLE) FROM application) / "
    "((SELECT CAST(count(DISTINCT TARGET) AS DOUBLE) FROM application) * count(*)) AS weight FROM application GROUP BY TARGET",
    ints=["TARGET", "n_rows"], dbls=["weight"], prefix=_APP))
def class_weights(spark, sf_dir):
    return tidy(S.class_weights(_app(spark, sf_dir)))


@query("split_summary", norm_sql(
    f"SELECT split, count(*) AS n_rows, avg(TARGET) AS default_rate FROM ({_SPLIT}) s GROUP BY split",
    ints=["n_rows"], strs=["split"], dbls=["default_rate"], prefix=_APP))
def split_summary(spark, sf_dir):
    return tidy(S.split_summary(S.stratified_split(_app(spark, sf_dir).select("SK_ID_CURR", "TARGET"))))


@query("remove_invalid_rows", norm_sql(
    "SELECT SK_ID_CURR, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'",
    ints=["SK_ID_CURR"], strs=["CODE_GENDER"], prefix=_APP))
def remove_invalid_rows(spark, sf_dir):
    return tidy(R.remove_invalid_rows(_app(spark, sf_dir)).select("SK_ID_CURR", "CODE_GENDER"))


_APP_COLS = A.adapter_columns("application")
_NULLSHARE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS null_fraction FROM application"
    for c in _APP_COLS)


@query("high_missing_columns", norm_sql(
    f"SELECT column_name, null_fraction, CASE WHEN null_fraction > {R.HIGH_MISSING_THRESHOLD!r} THEN 1 ELSE 0 END AS dropped "
    f"FROM ({_NULLSHARE}) s", ints=["dropped"], strs=["column_name"], dbls=["null_fraction"], prefix=_APP))
def high_missing_columns(spark, sf_dir):
    app = _app(spark, sf_dir)
    model = R.DropHighMissing().fit(app)
    st = model.stats
    rows = [(c, float(st["shares"][c]), int(c in st["drop"])) for c in app.columns]
    # the report is one small row per column of the fitted frame
    return tidy(spark.createDataFrame(rows, "column_name string, null_fraction double, dropped int"))


_CAP_COLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE"]


@query("cap_outliers", norm_sql(
    "SELECT SK_ID_CURR, " + ", ".join(
        f"CASE WHEN {c} > (SELECT quantile_cont({c}, 0.99) FROM application) "
        f"THEN (SELECT quantile_cont({c}, 0.99) FROM application) ELSE {c} END AS {c}" for c in _CAP_COLS)
    + " FROM application", ints=["SK_ID_CURR"], dbls=_CAP_COLS, prefix=_APP))
def cap_outliers(spark, sf_dir):
    return tidy(R.cap_outliers(_app(spark, sf_dir).select("SK_ID_CURR", *_CAP_COLS)))


_IMPUTE_COLS = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


@query("median_impute", norm_sql(
    "SELECT SK_ID_CURR, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM application)) AS {c}" for c in _IMPUTE_COLS)
    + " FROM application", ints=["SK_ID_CURR"], dbls=_IMPUTE_COLS, prefix=_APP))
def median_impute(spark, sf_dir):
    df = _app(spark, sf_dir).select("SK_ID_CURR", *_IMPUTE_COLS)
    return tidy(R.MedianImputer(inputCols=_IMPUTE_COLS).fit(df).transform(df))


_SCALE_COLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH", "FLAG_MOBIL", "EXT_SOURCE_1"]


@query("standard_scale", norm_sql(
    "SELECT SK_ID_CURR, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM application)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1e0 "
        f"ELSE stddev_pop({c}) END FROM application) AS {c}" for c in _SCALE_COLS)
    + " FROM application", ints=["SK_ID_CURR"], dbls=_SCALE_COLS, prefix=_APP))
def standard_scale(spark, sf_dir):
    df = _app(spark, sf_dir).select("SK_ID_CURR", *_SCALE_COLS)
    return tidy(R.PopulationScaler(inputCols=_SCALE_COLS).fit(df).transform(df))


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM application WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"


@query("mode_impute", norm_sql(
    f"SELECT SK_ID_CURR, coalesce(OCCUPATION_TYPE, {_mode_sql('OCCUPATION_TYPE')}) AS OCCUPATION_TYPE, "
    f"coalesce(CODE_GENDER, {_mode_sql('CODE_GENDER')}) AS CODE_GENDER FROM application",
    ints=["SK_ID_CURR"], strs=["OCCUPATION_TYPE", "CODE_GENDER"], prefix=_APP))
def mode_impute(spark, sf_dir):
    df = _app(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "CODE_GENDER")
    return tidy(R.ModeImputer(inputCols=["OCCUPATION_TYPE", "CODE_GENDER"]).fit(df).transform(df))


def _ordinal_sql(c: str, fit_from: str) -> str:
    return (f"coalesce((SELECT CAST(k.i AS DOUBLE) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM "
            f"(SELECT DISTINCT {c} AS v FROM {fit_from} WHERE {c} IS NOT NULL) d) k WHERE k.v = a.{c}), -1e0)")


@query("ordinal_encode", norm_sql(
    f"SELECT SK_ID_CURR, {_ordinal_sql('OCCUPATION_TYPE', 'application')} AS OCCUPATION_TYPE, "
    f"{_ordinal_sql('CODE_GENDER', 'application')} AS CODE_GENDER FROM application a",
    ints=["SK_ID_CURR"], dbls=["OCCUPATION_TYPE", "CODE_GENDER"], prefix=_APP))
def ordinal_encode(spark, sf_dir):
    df = _app(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "CODE_GENDER")
    return tidy(R.OrdinalIndexer(inputCols=["OCCUPATION_TYPE", "CODE_GENDER"]).fit(df).transform(df))


@query("ordinal_unknown", norm_sql(
    f"SELECT SK_ID_CURR, {_ordinal_sql('CODE_GENDER', 'fitted')} AS CODE_GENDER FROM application a",
    ints=["SK_ID_CURR"], dbls=["CODE_GENDER"],
    prefix=A.cte("application", extra=(("fitted", "SELECT * FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'"),))))
def ordinal_unknown(spark, sf_dir):
    """Fit on valid rows, apply to all: the unseen code XNA encodes to -1 instead of failing."""
    df = _app(spark, sf_dir).select("SK_ID_CURR", "CODE_GENDER")
    model = R.OrdinalIndexer(inputCols=["CODE_GENDER"]).fit(R.remove_invalid_rows(df))
    return tidy(model.transform(df))


@query("fill_missing_legacy", norm_sql(
    "SELECT SK_ID_CURR, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM application)) AS {c}"
                                      for c in ["AMT_ANNUITY", "EXT_SOURCE_1", "DAYS_BIRTH"])
    + f", coalesce(OCCUPATION_TYPE, {_mode_sql('OCCUPATION_TYPE')}) AS OCCUPATION_TYPE FROM application",
    ints=["SK_ID_CURR"], strs=["OCCUPATION_TYPE"], dbls=["AMT_ANNUITY", "EXT_SOURCE_1", "DAYS_BIRTH"], prefix=_APP))
def fill_missing_legacy(spark, sf_dir):
    out = R.fill_missing_legacy(_app(spark, sf_dir))
    return tidy(out.select(F.col("SK_ID_CURR").cast("long").alias("SK_ID_CURR"), "AMT_ANNUITY", "EXT_SOURCE_1",
                           "DAYS_BIRTH", "OCCUPATION_TYPE"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_DUMMIES = ([("CODE_GENDER", v) for v in ("M", "XNA")] + [("FLAG_OWN_CAR", "Y"), ("FLAG_OWN_REALTY", "Y")]
            + [("OCCUPATION_TYPE", v) for v in _SEGMENTS[1:]])


@query("one_hot_drop_first", norm_sql(
    "SELECT SK_ID_CURR, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, v in _DUMMIES)
    + " FROM application", ints=["SK_ID_CURR"] + [f"{c}_{v}" for c, v in _DUMMIES], prefix=_APP))
def one_hot_drop_first(spark, sf_dir):
    df = _app(spark, sf_dir).select("SK_ID_CURR", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "OCCUPATION_TYPE")
    return tidy(R.one_hot_drop_first(df))


_DEV_RANKED = f"""SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY
 (xor(SK_ID_CURR, {S.SEED + 1}) * 2654435761) % 4294967296, SK_ID_CURR) AS rn2, count(*) OVER (PARTITION BY TARGET) AS n2
 FROM ({_SPLIT}) s WHERE split = 'train'"""


@query("validation_indicator", norm_sql(
    f"SELECT SK_ID_CURR, TARGET, CASE WHEN rn2 <= round(1e-1 * n2) THEN 1 ELSE 0 END AS is_validation FROM ({_DEV_RANKED}) d",
    ints=["SK_ID_CURR", "TARGET", "is_validation"], prefix=_APP))
def validation_indicator(spark, sf_dir):
    """T-3: a stratified 10 % of the development rows marked for early stopping (second seed)."""
    dev = S.stratified_split(_app(spark, sf_dir).select("SK_ID_CURR", "TARGET")).where(F.col("split") == "train")
    out = S.validation_indicator(dev.drop("split"))
    return tidy(out.select("SK_ID_CURR", "TARGET", F.col("is_validation").cast("int").alias("is_validation")))
