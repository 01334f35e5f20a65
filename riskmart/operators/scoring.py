"""Scoring and decisioning.

All rules are projections of built-in expressions over a batch (or a streaming micro-batch):
request -> model features, alignment to the model's feature list, probability, decision, risk band,
recommendation, affordability ratios and rule-based risk drivers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions import expr as X
from riskmart.operators.packs import EMPLOYMENT_SENTINEL

# Fixed values (must equal the reference): one-hot columns of the request categories; the first
# category of each list is the base level and gets no column.
REQUEST_CATEGORIES = {
    "name_income_type": ("NAME_INCOME_TYPE", ["Commercial associate", "Pensioner", "State servant", "Unemployed", "Working"]),
    "name_education_type": ("NAME_EDUCATION_TYPE", ["Academic degree", "Higher education", "Incomplete higher",
                                                    "Lower secondary", "Secondary / secondary special"]),
    "name_family_status": ("NAME_FAMILY_STATUS", ["Civil marriage", "Married", "Separated", "Single / not married", "Widow"]),
    "name_housing_type": ("NAME_HOUSING_TYPE", ["Co-op apartment", "House / apartment", "Municipal apartment",
                                                "Office apartment", "Rented apartment", "With parents"]),
}

# Fixed values (must equal the reference): rule-based risk driver thresholds.
DTI_LIMIT, EXT_SCORE_FLOOR, BURDEN_LIMIT = 4.0, 0.4, 0.5
DEFAULT_THRESHOLD = 0.5


def request_features(requests: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Q-5: request fields -> the model's application features (age+1 in the tenure ratio everywhere)."""
    inc, cred, ann = F.col("amt_income_total"), F.col("amt_credit"), F.col("amt_annuity")
    age, emp = F.col("age_years"), F.col("employed_years")
    e2, e3 = F.col("ext_source_2"), F.col("ext_source_3")
    cols = [F.col(k) for k in keep if k in requests.columns]
    cols += [
        inc.alias("AMT_INCOME_TOTAL"), cred.alias("AMT_CREDIT"), ann.alias("AMT_ANNUITY"),
        (-(age * 365).cast("int")).alias("DAYS_BIRTH"),
        F.when(emp > 0, -(emp * 365).cast("int")).otherwise(F.lit(EMPLOYMENT_SENTINEL)).alias("DAYS_EMPLOYED"),
        e2.alias("EXT_SOURCE_2"), e3.alias("EXT_SOURCE_3"),
        F.col("code_gender").alias("CODE_GENDER"),
        X.plus_one_ratio(cred, inc).alias("CREDIT_INCOME_RATIO"),
        X.plus_one_ratio(ann, inc).alias("ANNUITY_INCOME_RATIO"),
        X.plus_one_ratio(cred, ann).alias("CREDIT_TERM_MONTHS"),
        age.cast("double").alias("AGE_YEARS"),
        emp.alias("EMPLOYED_YEARS"),
        X.flag(emp == 0).alias("IS_UNEMPLOYED"),
        X.plus_one_ratio(emp, age).alias("EMPLOYMENT_AGE_RATIO"),
        (e2 * e3).alias("EXT_SOURCE_PRODUCT"),
        ((e2 + e3) / 2).alias("EXT_SOURCE_MEAN"),
    ]
    for field, (prefix, _) in REQUEST_CATEGORIES.items():
        if field in requests.columns:
            cols.append(F.col(field).alias(prefix))
    return requests.select(*cols)


def request_one_hot(requests: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Q-6: categorical request fields -> 0/1 columns, first category as the base level."""
    cols = [F.col(k) for k in keep if k in requests.columns]
    cols.append(X.flag_eq("code_gender", "M").alias("CODE_GENDER_M"))
    for field, (prefix, values) in REQUEST_CATEGORIES.items():
        for v in values[1:]:
            cols.append(X.flag_eq(field, v).alias(f"{prefix}_{v}"))
    return requests.select(*cols)


def align_features(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = ("id",),
                   fill=0) -> tuple[DataFrame, list[str]]:
    """Q-1: exactly the model's features in order; missing ones are the constant ``fill``.

    Returns the aligned frame and the list of input columns that the model does not use."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep if k in present]
    cols += [F.col(f"`{f}`") if f in present else F.lit(fill).alias(f) for f in feature_names]
    extra = [c for c in df.columns if c not in set(feature_names) and c not in set(keep)]
    return df.select(*cols), extra


def linear_margin(coefficients: Mapping[str, float], intercept: float, fill_missing: float = 0.0) -> Column:
    """intercept + sum(coef * x) with missing inputs treated as ``fill_missing``."""
    terms = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(fill_missing)) * F.lit(float(w))
             for f, w in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def decide(df: DataFrame, prob_col: str = "probability", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Q-2..Q-4: 0/1 decision at the threshold, risk band, band text, recommendation; all NULL where the
    probability is NULL (a rejected request has no decision)."""
    p = F.col(prob_col)
    return df.select("*", F.when(p >= threshold, 1).when(p.isNotNull(), 0).alias("prediction"),
                     X.band_of(p, 2).alias("risk_band"), X.band_of(p, 3).alias("risk_text"),
                     X.recommendation_of(p, 1).alias("recommendation"))


def score_linear(df: DataFrame, coefficients: Mapping[str, float], intercept: float,
                 keep: Sequence[str] = ("SK_ID_CURR",), threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Score with a fixed linear (logistic) model: probability, decision, band, recommendation."""
    prob = sigmoid(linear_margin(coefficients, intercept))
    return decide(df.select(*[F.col(k) for k in keep], prob.alias("probability")), "probability", threshold)


def score_with_model(df: DataFrame, model, keep: Sequence[str] = ("SK_ID_CURR",),
                     threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Q-2 with a fitted Spark ML pipeline: probability of class 1 from the probability vector."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return decide(out.select(*[F.col(k) for k in keep],
                             vector_to_array("probability")[1].alias("probability")), "probability", threshold)


def affordability(requests: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Q-7: debt-to-income = credit / (income + 1); monthly burden = annuity / (income / 12 + 1)."""
    inc = F.col("amt_income_total")
    return requests.select(*[F.col(k) for k in keep],
                           X.plus_one_ratio("amt_credit", inc).alias("debt_to_income"),
                           X.plus_one_ratio("amt_annuity", inc / 12).alias("monthly_burden"))


def risk_drivers(requests: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Q-8: rule-based drivers. The debt-to-income rule divides by income without the +1."""
    inc = F.col("amt_income_total")
    burden = X.plus_one_ratio("amt_annuity", inc / 12)
    rules = [
        ("Debt-to-Income Ratio", X.safe_div("amt_credit", inc) > DTI_LIMIT),
        ("External Score 2", F.col("ext_source_2") < EXT_SCORE_FLOOR),
        ("External Score 3", F.col("ext_source_3") < EXT_SCORE_FLOOR),
        ("Employment Status", F.col("employed_years") == 0),
        ("Monthly Burden", burden > BURDEN_LIMIT),
    ]
    names = [F.when(cond, F.lit(name)) for name, cond in rules]
    n = reduce(lambda a, b: a + b, [X.flag(cond) for _, cond in rules])
    return requests.select(*[F.col(k) for k in keep], n.alias("n_drivers"), F.concat_ws("; ", *names).alias("drivers"))
