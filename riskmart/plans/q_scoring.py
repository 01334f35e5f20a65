"""Catalogue entries: expression primitives, scoring rules, attribution, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.functions import expr as X
from riskmart.operators import attribution as AT
from riskmart.operators import packs as P
from riskmart.operators import scoring as SC
from riskmart.operators import training as TR
from riskmart.plans import master as M
from riskmart.plans.q_features import APPLICATION_SQL, MASTER_SQL, MASTER_SQL_PREFIX
from riskmart.plans.registry import clip_sql, div_sql, query, ratio_sql
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A


def _t(spark, sf_dir, name):
    return A.adapter(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# Expression primitives (P-1..P-9, P-5, P-6)
# ---------------------------------------------------------------------------

@query("ratio_plus_one", norm_sql(
    f"SELECT SK_ID_CURR, SK_ID_PREV, MONTHS_BALANCE, {ratio_sql('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL')} AS utilization_raw, "
    f"{ratio_sql('AMT_PAYMENT_TOTAL_CURRENT', 'AMT_BALANCE')} AS payment_rate_raw FROM credit_card",
    ints=["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"], dbls=["utilization_raw", "payment_rate_raw"],
    prefix=A.cte("credit_card")))
def ratio_plus_one(spark, sf_dir):
    """n / (d + 1) with IEEE results for a zero denominator (balance = -1 gives +-inf or NULL)."""
    cc = _t(spark, sf_dir, "credit_card")
    return tidy(cc.select("SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE",
                          X.plus_one_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL").alias("utilization_raw"),
                          X.plus_one_ratio("AMT_PAYMENT_TOTAL_CURRENT", "AMT_BALANCE").alias("payment_rate_raw")))


@query("equality_flags", norm_sql(
    "SELECT SK_ID_PREV, " + ", ".join(
        f"CASE WHEN NAME_CONTRACT_STATUS = '{v}' THEN 1 ELSE 0 END AS {n}" for n, v in
        [("IS_APPROVED", "Approved"), ("IS_REFUSED", "Refused"), ("IS_CANCELLED", "Canceled"), ("IS_UNUSED", "Unused offer")])
    + ", CASE WHEN NAME_CONTRACT_TYPE = 'Cash loans' THEN 1 ELSE 0 END AS IS_CASH_LOAN FROM previous",
    ints=["SK_ID_PREV", "IS_APPROVED", "IS_REFUSED", "IS_CANCELLED", "IS_UNUSED", "IS_CASH_LOAN"],
    prefix=A.cte("previous")))
def equality_flags(spark, sf_dir):
    prev = _t(spark, sf_dir, "previous")
    return tidy(prev.select("SK_ID_PREV", X.flag_eq("NAME_CONTRACT_STATUS", "Approved").alias("IS_APPROVED"),
                            X.flag_eq("NAME_CONTRACT_STATUS", "Refused").alias("IS_REFUSED"),
                            X.flag_eq("NAME_CONTRACT_STATUS", "Canceled").alias("IS_CANCELLED"),
                            X.flag_eq("NAME_CONTRACT_STATUS", "Unused offer").alias("IS_UNUSED"),
                            X.flag_eq("NAME_CONTRACT_TYPE", "Cash loans").alias("IS_CASH_LOAN")))


@query("threshold_flags", norm_sql(
    "SELECT SK_ID_PREV, NUM_INSTALMENT_NUMBER, "
    "CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN 1 ELSE 0 END AS IS_LATE, "
    "CASE WHEN AMT_INSTALMENT - AMT_PAYMENT > 0 THEN 1 ELSE 0 END AS IS_UNDERPAYMENT, "
    "CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT >= 30 THEN 1 ELSE 0 END AS IS_LATE_30 FROM installments",
    ints=["SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "IS_LATE", "IS_UNDERPAYMENT", "IS_LATE_30"],
    prefix=A.cte("installments")))
def threshold_flags(spark, sf_dir):
    """Strict and non-strict threshold flags; a missing input gives 0, never NULL."""
    ins = _t(spark, sf_dir, "installments")
    dpd = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return tidy(ins.select("SK_ID_PREV", "NUM_INSTALMENT_NUMBER", X.flag_gt(dpd, 0).alias("IS_LATE"),
                           X.flag_gt(F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"), 0).alias("IS_UNDERPAYMENT"),
                           X.flag_ge(dpd, 30).alias("IS_LATE_30")))


@query("membership_flags", norm_sql(
    "SELECT SK_ID_BUREAU, MONTHS_BALANCE, CASE WHEN STATUS IN ('1', '2', '3', '4', '5') THEN 1 ELSE 0 END AS IS_DPD, "
    "CASE WHEN STATUS IN ('3', '4', '5') THEN 1 ELSE 0 END AS IS_SEVERE_DPD FROM bureau_balance",
    ints=["SK_ID_BUREAU", "MONTHS_BALANCE", "IS_DPD", "IS_SEVERE_DPD"], prefix=A.cte("bureau_balance")))
def membership_flags(spark, sf_dir):
    bb = _t(spark, sf_dir, "bureau_balance")
    return tidy(bb.select("SK_ID_BUREAU", "MONTHS_BALANCE", X.flag_in("STATUS", P.DPD_CODES).alias("IS_DPD"),
                          X.flag_in("STATUS", P.SEVERE_DPD_CODES).alias("IS_SEVERE_DPD")))


@query("status_map", norm_sql(
    "SELECT SK_ID_BUREAU, MONTHS_BALANCE, STATUS, CASE STATUS WHEN 'C' THEN 0 WHEN 'X' THEN -1 WHEN '0' THEN 0 "
    "WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 WHEN '5' THEN 5 END AS STATUS_NUMERIC FROM bureau_balance",
    ints=["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS_NUMERIC"], strs=["STATUS"], prefix=A.cte("bureau_balance")))
def status_map(spark, sf_dir):
    bb = _t(spark, sf_dir, "bureau_balance")
    return tidy(bb.select("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS",
                          X.code_map("STATUS", P.STATUS_CODES).alias("STATUS_NUMERIC")))


@query("sentinel_null", norm_sql(
    "SELECT SK_ID_CURR, CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS IS_UNEMPLOYED, "
    "NULLIF(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED FROM application",
    ints=["SK_ID_CURR", "IS_UNEMPLOYED", "DAYS_EMPLOYED"], prefix=A.cte("application")))
def sentinel_null(spark, sf_dir):
    """The flag is taken before the sentinel becomes NULL."""
    app = _t(spark, sf_dir, "application")
    return tidy(app.select("SK_ID_CURR", X.flag_eq("DAYS_EMPLOYED", P.EMPLOYMENT_SENTINEL).alias("IS_UNEMPLOYED"),
                           X.sentinel_null("DAYS_EMPLOYED", P.EMPLOYMENT_SENTINEL).alias("DAYS_EMPLOYED")))


@query("clip_bounds", norm_sql(
    f"SELECT SK_ID_CURR, SK_ID_PREV, MONTHS_BALANCE, "
    f"{clip_sql(ratio_sql('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL'), '0e0', '1e0')} AS UTILIZATION, "
    f"{clip_sql(ratio_sql('AMT_PAYMENT_TOTAL_CURRENT', 'AMT_BALANCE'), '0e0', '2e0')} AS PAYMENT_RATE, "
    f"{clip_sql('AMT_DRAWINGS_ATM_CURRENT', hi='1e3')} AS ATM_CAPPED FROM credit_card",
    ints=["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"], dbls=["UTILIZATION", "PAYMENT_RATE", "ATM_CAPPED"],
    prefix=A.cte("credit_card")))
def clip_bounds(spark, sf_dir):
    """Both-sided and upper-only clipping; NULL stays NULL, +-inf clip to the bounds."""
    cc = _t(spark, sf_dir, "credit_card")
    return tidy(cc.select("SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE",
                          X.clip(X.plus_one_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"), 0.0, 1.0).alias("UTILIZATION"),
                          X.clip(X.plus_one_ratio("AMT_PAYMENT_TOTAL_CURRENT", "AMT_BALANCE"), 0.0, 2.0).alias("PAYMENT_RATE"),
                          X.clip("AMT_DRAWINGS_ATM_CURRENT", upper=1e3).alias("ATM_CAPPED")))


_EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


@query("row_stats", norm_sql(
    "SELECT SK_ID_CURR, EXT_SOURCE_MEAN, EXT_SOURCE_MIN, EXT_SOURCE_STD, "
    "greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MAX FROM appf",
    ints=["SK_ID_CURR"], dbls=["EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_STD", "EXT_SOURCE_MAX"],
    prefix=A.cte("application", extra=(("appf", APPLICATION_SQL),))))
def row_stats(spark, sf_dir):
    """Row-wise mean / min / max / sample std over present values (std NULL -> 0)."""
    app = _t(spark, sf_dir, "application")
    return tidy(app.select("SK_ID_CURR", X.row_mean(_EXT).alias("EXT_SOURCE_MEAN"), X.row_min(_EXT).alias("EXT_SOURCE_MIN"),
                           F.coalesce(X.row_std(_EXT), F.lit(0.0)).alias("EXT_SOURCE_STD"),
                           X.row_max(_EXT).alias("EXT_SOURCE_MAX")))


@query("row_flag_sum", norm_sql(
    "SELECT SK_ID_CURR, FLAG_DOCUMENT_2 + FLAG_DOCUMENT_3 AS DOCS_PROVIDED_COUNT, "
    "FLAG_MOBIL + FLAG_EMP_PHONE + FLAG_EMAIL AS CONTACT_CHANNELS_COUNT FROM application",
    ints=["SK_ID_CURR", "DOCS_PROVIDED_COUNT", "CONTACT_CHANNELS_COUNT"], prefix=A.cte("application")))
def row_flag_sum(spark, sf_dir):
    """Flags chosen by name prefix (FLAG_DOCUMENT_*) and by a fixed list (those present)."""
    app = _t(spark, sf_dir, "application")
    docs = X.prefixed(app.columns, [P.DOCUMENT_FLAG_PREFIX])
    contacts = [c for c in P.CONTACT_FLAGS if c in app.columns]
    return tidy(app.select("SK_ID_CURR", X.row_sum(docs).alias("DOCS_PROVIDED_COUNT"),
                           X.row_sum(contacts).alias("CONTACT_CHANNELS_COUNT")))


# ---------------------------------------------------------------------------
# Scoring (Q-1..Q-8)
# ---------------------------------------------------------------------------

# Fixed coefficients of the demonstration scorer over master features (chosen here, not fitted).
SCORE_INTERCEPT = -0.5
SCORE_COEFFICIENTS = {
    "EXT_SOURCE_MEAN": -2.5, "CREDIT_INCOME_RATIO": 0.15, "ANNUITY_INCOME_RATIO": 1.2, "AGE_YEARS": -0.02,
    "IS_UNEMPLOYED": 0.3, "BUREAU_DEBT_CREDIT_RATIO": 0.8, "PREV_REFUSED_RATIO": 0.9, "INSTAL_LATE_RATIO": 1.1,
    "CC_UTILIZATION_MEAN": 0.7, "POS_DPD_RATIO": 0.6,
}


def _margin_sql(coefs: dict, intercept: float) -> str:
    s = f"{intercept!r}"
    for f, w in coefs.items():
        s = f"({s} + coalesce(CAST({f} AS DOUBLE), 0e0) * {float(w)!r})"
    return s


def _band_sql(p: str, field: int) -> str:
    parts = " ".join(f"WHEN {p} >= {lo!r} AND {p} < {hi!r} THEN '{(lo, hi, *rest)[field]}'"
                     for lo, hi, *rest in X.RISK_BANDS)
    fallback = "Very High" if field == 2 else "Very high default risk."
    return f"CASE {parts} ELSE '{fallback}' END"


def _rec_sql(p: str) -> str:
    parts = " ".join(f"WHEN {p} < {cut!r} THEN '{name}'" for cut, name in X.RECOMMENDATIONS if cut is not None)
    return f"CASE {parts} ELSE '{X.RECOMMENDATIONS[-1][1]}' END"


def _decide_sql(inner: str, keep: str) -> str:
    return (f"SELECT {keep}, probability, CASE WHEN probability >= 5e-1 THEN 1 ELSE 0 END AS prediction, "
            f"{_band_sql('probability', 2)} AS risk_band, {_band_sql('probability', 3)} AS risk_text, "
            f"{_rec_sql('probability')} AS recommendation FROM ({inner}) s")


_SCORE_SQL = _decide_sql(f"SELECT SK_ID_CURR, 1e0 / (1e0 + exp(-{_margin_sql(SCORE_COEFFICIENTS, SCORE_INTERCEPT)})) "
                         f"AS probability FROM ({MASTER_SQL}) mm", "SK_ID_CURR")
_DECIDE_STRS = ["risk_band", "risk_text", "recommendation"]


@query("score_applications", norm_sql(_SCORE_SQL, ints=["SK_ID_CURR", "prediction"], strs=_DECIDE_STRS,
                                      dbls=["probability"], prefix=MASTER_SQL_PREFIX))
def score_applications(spark, sf_dir):
    """Master table -> probability (fixed linear scorer) -> decision, band, recommendation."""
    master = M.build_master(A.loan_tables(spark, sf_dir))
    return tidy(SC.score_linear(master, SCORE_COEFFICIENTS, SCORE_INTERCEPT))


@query("risk_bands", norm_sql(
    f"SELECT id, score, {_band_sql('score', 2)} AS risk_band, {_band_sql('score', 3)} AS risk_text FROM scored_events",
    ints=["id"], strs=["risk_band", "risk_text"], dbls=["score"], prefix=A.cte("scored_events")))
def risk_bands(spark, sf_dir):
    ev = _t(spark, sf_dir, "scored_events")
    return tidy(ev.select("id", "score", X.band_of("score", 2).alias("risk_band"), X.band_of("score", 3).alias("risk_text")))


@query("recommendations", norm_sql(
    f"SELECT id, {_rec_sql('score')} AS recommendation FROM scored_events",
    ints=["id"], strs=["recommendation"], prefix=A.cte("scored_events")))
def recommendations(spark, sf_dir):
    ev = _t(spark, sf_dir, "scored_events")
    return tidy(ev.select("id", X.recommendation_of("score", 1).alias("recommendation")))


_REQ_FEATURES_SQL = f"""
SELECT id, amt_income_total AS AMT_INCOME_TOTAL, amt_credit AS AMT_CREDIT, amt_annuity AS AMT_ANNUITY,
 -CAST(trunc(age_years * 365) AS INT) AS DAYS_BIRTH,
 CASE WHEN employed_years > 0 THEN -CAST(trunc(employed_years * 365) AS INT) ELSE 365243 END AS DAYS_EMPLOYED,
 ext_source_2 AS EXT_SOURCE_2, ext_source_3 AS EXT_SOURCE_3, code_gender AS CODE_GENDER,
 {ratio_sql('amt_credit', 'amt_income_total')} AS CREDIT_INCOME_RATIO,
 {ratio_sql('amt_annuity', 'amt_income_total')} AS ANNUITY_INCOME_RATIO,
 {ratio_sql('amt_credit', 'amt_annuity')} AS CREDIT_TERM_MONTHS,
 CAST(age_years AS DOUBLE) AS AGE_YEARS, employed_years AS EMPLOYED_YEARS,
 CASE WHEN employed_years = 0 THEN 1 ELSE 0 END AS IS_UNEMPLOYED,
 {ratio_sql('employed_years', 'age_years')} AS EMPLOYMENT_AGE_RATIO,
 ext_source_2 * ext_source_3 AS EXT_SOURCE_PRODUCT, (ext_source_2 + ext_source_3) / 2 AS EXT_SOURCE_MEAN,
 name_income_type AS NAME_INCOME_TYPE, name_education_type AS NAME_EDUCATION_TYPE,
 name_family_status AS NAME_FAMILY_STATUS, name_housing_type AS NAME_HOUSING_TYPE
FROM valid"""
_VALID = ("valid", "SELECT id, amt_income_total, amt_credit, amt_annuity, coalesce(ext_source_2, 5e-1) AS ext_source_2, "
                   "coalesce(ext_source_3, 5e-1) AS ext_source_3, age_years, coalesce(employed_years, 0e0) AS employed_years, "
                   "coalesce(code_gender, 'F') AS code_gender, name_income_type, name_education_type, name_family_status, "
                   "name_housing_type FROM requests")
_REQF_INTS = ["id", "DAYS_BIRTH", "DAYS_EMPLOYED", "IS_UNEMPLOYED"]
_REQF_STRS = ["CODE_GENDER", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE"]
_REQF_DBLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "EXT_SOURCE_2", "EXT_SOURCE_3", "CREDIT_INCOME_RATIO",
              "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "AGE_YEARS", "EMPLOYED_YEARS", "EMPLOYMENT_AGE_RATIO",
              "EXT_SOURCE_PRODUCT", "EXT_SOURCE_MEAN"]


def _requests(spark, sf_dir):
    from riskmart.operators.quality import with_defaults
    return with_defaults(_t(spark, sf_dir, "requests"))


@query("request_features", norm_sql(_REQ_FEATURES_SQL, ints=_REQF_INTS, strs=_REQF_STRS, dbls=_REQF_DBLS,
                                    prefix=A.cte("requests", extra=(_VALID,))))
def request_features(spark, sf_dir):
    return tidy(SC.request_features(_requests(spark, sf_dir)))


_ONE_HOT = [("CODE_GENDER_M", "code_gender", "M")] + [
    (f"{prefix}_{v}", field, v) for field, (prefix, values) in SC.REQUEST_CATEGORIES.items() for v in values[1:]]


@query("request_one_hot", norm_sql(
    "SELECT id, " + ", ".join(f"CASE WHEN {field} = '{v}' THEN 1 ELSE 0 END AS \"{name}\"" for name, field, v in _ONE_HOT)
    + " FROM valid", ints=["id"] + [n for n, _, _ in _ONE_HOT], prefix=A.cte("requests", extra=(_VALID,))))
def request_one_hot(spark, sf_dir):
    return tidy(SC.request_one_hot(_requests(spark, sf_dir)))


_ALIGN_FEATURES = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_MEAN", "CREDIT_INCOME_RATIO", "AMT_GOODS_PRICE",
                   "BUREAU_LOAN_COUNT", "EXT_SOURCE_1", "IS_UNEMPLOYED"]


@query("align_features", norm_sql(
    "SELECT id, AMT_INCOME_TOTAL, AMT_CREDIT, EXT_SOURCE_MEAN, CREDIT_INCOME_RATIO, 0 AS AMT_GOODS_PRICE, "
    f"0 AS BUREAU_LOAN_COUNT, 0 AS EXT_SOURCE_1, IS_UNEMPLOYED FROM ({_REQ_FEATURES_SQL}) rf",
    ints=["id", "AMT_GOODS_PRICE", "BUREAU_LOAN_COUNT", "EXT_SOURCE_1", "IS_UNEMPLOYED"],
    dbls=["AMT_INCOME_TOTAL", "AMT_CREDIT", "EXT_SOURCE_MEAN", "CREDIT_INCOME_RATIO"],
    prefix=A.cte("requests", extra=(_VALID,))))
def align_features(spark, sf_dir):
    """Request features aligned to a model's feature list: absent features become 0, extras are dropped."""
    feats = SC.request_features(_requests(spark, sf_dir))
    aligned, _extra = SC.align_features(feats, _ALIGN_FEATURES)
    return tidy(aligned)


@query("affordability", norm_sql(
    f"SELECT id, {ratio_sql('amt_credit', 'amt_income_total')} AS debt_to_income, "
    f"{ratio_sql('amt_annuity', '(amt_income_total / 12)')} AS monthly_burden FROM requests",
    ints=["id"], dbls=["debt_to_income", "monthly_burden"], prefix=A.cte("requests")))
def affordability(spark, sf_dir):
    return tidy(SC.affordability(_t(spark, sf_dir, "requests")))


def _drivers_sql() -> str:
    dti = div_sql("CAST(amt_credit AS DOUBLE)", "CAST(amt_income_total AS DOUBLE)")
    burden = ratio_sql("amt_annuity", "(amt_income_total / 12)")
    rules = [("Debt-to-Income Ratio", f"{dti} > 4e0"), ("External Score 2", "ext_source_2 < 4e-1"),
             ("External Score 3", "ext_source_3 < 4e-1"), ("Employment Status", "employed_years = 0"),
             ("Monthly Burden", f"{burden} > 5e-1")]
    n = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for _, c in rules)
    names = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in rules)
    return f"SELECT id, {n} AS n_drivers, concat_ws('; ', {names}) AS drivers FROM requests"


@query("risk_drivers", norm_sql(_drivers_sql(), ints=["id", "n_drivers"], strs=["drivers"], prefix=A.cte("requests")))
def risk_drivers(spark, sf_dir):
    return tidy(SC.risk_drivers(_t(spark, sf_dir, "requests")))


# ---------------------------------------------------------------------------
# Attribution (X-2..X-8) with a fixed linear model over master features
# ---------------------------------------------------------------------------

_ATTR_FEATURES = (["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "GOODS_CREDIT_RATIO", "AGE_YEARS",
                   "IS_UNEMPLOYED", "EMPLOYED_YEARS", "EMPLOYMENT_AGE_RATIO", "EXT_SOURCE_MEAN", "EXT_SOURCE_MIN",
                   "EXT_SOURCE_STD", "EXT_SOURCE_PRODUCT", "DOCS_PROVIDED_COUNT", "CONTACT_CHANNELS_COUNT"]
                  + ["BUREAU_LOAN_COUNT", "BUREAU_ACTIVE_RATIO", "BUREAU_DEBT_CREDIT_RATIO", "BUREAU_BB_DPD_RATIO_MEAN",
                     "PREV_APP_COUNT", "PREV_APPROVED_RATIO", "PREV_REFUSED_RATIO", "PREV_CREDIT_RATIO",
                     "INSTAL_LATE_RATIO", "INSTAL_UNDERPAYMENT_RATIO", "INSTAL_PAYMENT_PERC_MEAN",
                     "POS_DPD_RATIO", "POS_COMPLETED_RATIO", "CC_UTILIZATION_MEAN", "CC_PAYS_ABOVE_MIN_RATIO",
                     "CC_DPD_RATIO"])
# coefficient rule: alternating signs with magnitudes 0.1..0.9 (a demonstration model)
ATTR_COEFFICIENTS = {f: ((-1) ** i) * (0.1 + 0.1 * ((i * 7) % 9)) for i, f in enumerate(_ATTR_FEATURES)}
ATTR_INTERCEPT = -1.0


def _contrib_sql() -> str:
    means = ", ".join(f"avg(coalesce(CAST({f} AS DOUBLE), 0e0)) AS m_{f}" for f in _ATTR_FEATURES)
    base = " + ".join([f"{ATTR_INTERCEPT!r}"] + [f"{ATTR_COEFFICIENTS[f]!r} * m_{f}" for f in _ATTR_FEATURES])
    margin = _margin_sql(ATTR_COEFFICIENTS, ATTR_INTERCEPT)
    parts = [f"SELECT SK_ID_CURR AS id, '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), 0e0) AS value, "
             f"(coalesce(CAST({f} AS DOUBLE), 0e0) - m_{f}) * {ATTR_COEFFICIENTS[f]!r} AS contribution, "
             f"{base} AS base_value, {margin} AS margin FROM mm, mu" for f in _ATTR_FEATURES]
    return f"WITH mm AS ({MASTER_SQL}), mu AS (SELECT {means} FROM mm) " + " UNION ALL ".join(parts)


_CONTRIB = ("contrib", _contrib_sql())
_ATTR_PREFIX = MASTER_SQL_PREFIX.rstrip() + ",\n" + f"{_CONTRIB[0]} AS ({_CONTRIB[1]})\n"


def _contribs(spark, sf_dir):
    master = M.build_master(A.loan_tables(spark, sf_dir))
    return AT.linear_contributions(master, ATTR_COEFFICIENTS, ATTR_INTERCEPT, "SK_ID_CURR")


@query("linear_contributions", norm_sql("SELECT * FROM contrib", ints=["id"], strs=["feature"],
                                        dbls=["value", "contribution", "base_value", "margin"], prefix=_ATTR_PREFIX))
def linear_contributions(spark, sf_dir):
    return tidy(_contribs(spark, sf_dir))


_IMP = "SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM contrib GROUP BY feature"


@query("global_importance", norm_sql(_IMP, strs=["feature"], dbls=["mean_abs_contribution"], prefix=_ATTR_PREFIX))
def global_importance(spark, sf_dir):
    return tidy(AT.global_importance(_contribs(spark, sf_dir)))


@query("top_features", norm_sql(f"SELECT * FROM ({_IMP}) g ORDER BY mean_abs_contribution DESC, feature LIMIT {AT.TOP_FEATURES}",
                                strs=["feature"], dbls=["mean_abs_contribution"], prefix=_ATTR_PREFIX))
def top_features(spark, sf_dir):
    return tidy(AT.top_features(_contribs(spark, sf_dir)))


@query("top_factors_per_row", norm_sql(
    f"SELECT id, rank, feature, round(contribution, 4) AS contribution, CASE WHEN contribution > 0 THEN 'increases_risk' "
    f"ELSE 'decreases_risk' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, "
    f"feature) AS rank FROM contrib) r WHERE rank <= {AT.RESPONSE_FACTORS}",
    ints=["id", "rank"], strs=["feature", "direction"], dbls=["contribution"], prefix=_ATTR_PREFIX))
def top_factors_per_row(spark, sf_dir):
    return tidy(AT.top_factors_per_row(_contribs(spark, sf_dir)))


@query("contribution_pairs", norm_sql(
    f"SELECT id, feature, value, contribution FROM contrib WHERE feature IN (SELECT feature FROM ({_IMP}) g "
    f"ORDER BY mean_abs_contribution DESC, feature LIMIT {AT.SUMMARY_FEATURES})",
    ints=["id"], strs=["feature"], dbls=["value", "contribution"], prefix=_ATTR_PREFIX))
def contribution_pairs(spark, sf_dir):
    return tidy(AT.contribution_pairs(_contribs(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Model comparison on a per-fold score table derived from events (T-9, Q-9)
# ---------------------------------------------------------------------------

_FOLD_SCORES = ("fold_scores", "SELECT event_type AS model, event_id % 5 AS fold, avg(value) / 5e2 AS auc "
                               "FROM events GROUP BY event_type, event_id % 5")


def _fold_scores(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 5).alias("fold")).agg(
        (F.avg("value") / 500.0).alias("auc"))


_CMP = """SELECT model, avg(auc) AS cv_auc_mean, stddev_pop(auc) AS cv_auc_std, min(auc) AS cv_auc_min,
 max(auc) AS cv_auc_max, count(auc) AS n_folds FROM fold_scores GROUP BY model"""
_CMP_RANKED = f"""SELECT *, rank() OVER (ORDER BY cv_auc_mean DESC NULLS LAST) AS position,
 CASE WHEN rank() OVER (ORDER BY cv_auc_mean DESC NULLS LAST) = 1 THEN 1 ELSE 0 END AS is_best FROM ({_CMP}) c"""
_CMP_DBLS = ["cv_auc_mean", "cv_auc_std", "cv_auc_min", "cv_auc_max"]


@query("model_comparison", norm_sql(_CMP_RANKED, ints=["n_folds", "position", "is_best"], strs=["model"], dbls=_CMP_DBLS,
                                    prefix=f"WITH {_FOLD_SCORES[0]} AS ({_FOLD_SCORES[1]})\n"))
def model_comparison(spark, sf_dir):
    return tidy(TR.comparison_table(_fold_scores(spark, sf_dir)))


@query("best_model", norm_sql(f"SELECT model, cv_auc_mean FROM ({_CMP_RANKED}) r WHERE position = 1",
                              strs=["model"], dbls=["cv_auc_mean"], prefix=f"WITH {_FOLD_SCORES[0]} AS ({_FOLD_SCORES[1]})\n"))
def best_model(spark, sf_dir):
    return tidy(TR.best_of(TR.comparison_table(_fold_scores(spark, sf_dir))).select("model", "cv_auc_mean"))


@query("background_sample", norm_sql(
    f"SELECT SK_ID_CURR, EXT_SOURCE_MEAN, AGE_YEARS FROM appf ORDER BY (xor(SK_ID_CURR, 42) * 2654435761) % 4294967296, "
    f"SK_ID_CURR LIMIT {AT.BACKGROUND_ROWS}", ints=["SK_ID_CURR"], dbls=["EXT_SOURCE_MEAN", "AGE_YEARS"],
    prefix=A.cte("application", extra=(("appf", APPLICATION_SQL),))))
def background_sample(spark, sf_dir):
    """X-1: the reproducible 100-row background set for attribution."""
    feats = P.application_features(_t(spark, sf_dir, "application"))
    return tidy(AT.background_sample(feats, "SK_ID_CURR").select("SK_ID_CURR", "EXT_SOURCE_MEAN", "AGE_YEARS"))
