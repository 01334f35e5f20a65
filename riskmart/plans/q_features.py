"""Catalogue entries: sources, joins, aggregations and feature packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmart.operators import packs as P
from riskmart.plans import master as M
from riskmart.plans.registry import clip_sql, query, ratio_sql
from riskmart.plans.tidy import norm_sql, tidy
from riskmart.sources import adapters as A
from riskmart.sources import tables as TB

# ---------------------------------------------------------------------------
# S-IN-1 / S-IN-3
# ---------------------------------------------------------------------------

_SCAN_INTS = ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE",
              "CREDIT_DAY_OVERDUE", "CNT_CREDIT_PROLONG"]
_SCAN_DBLS = ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
              "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_MAX_OVERDUE"]


@query("scan_table", norm_sql("SELECT * FROM bureau", ints=_SCAN_INTS, strs=["CREDIT_ACTIVE"],
                              dbls=_SCAN_DBLS, prefix=A.cte("bureau")))
def scan_table(spark, sf_dir):
    """Read one table with NaN turned into NULL at the source."""
    return tidy(TB.nan_to_null(A.adapter(spark, sf_dir, "bureau")))


_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in A.LOAN_TABLES)


@query("table_row_counts", norm_sql(_COUNTS_SQL, ints=["n_rows"], strs=["table_name"],
                                    prefix=A.cte(*A.LOAN_TABLES)))
def table_row_counts(spark, sf_dir):
    return tidy(TB.table_row_counts(A.loan_tables(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Packs
# ---------------------------------------------------------------------------

_BB_INNER = """
SELECT SK_ID_BUREAU, count(MONTHS_BALANCE) AS BB_MONTHS_COUNT, max(s) AS BB_STATUS_MAX, avg(s) AS BB_STATUS_MEAN,
 coalesce(sum(dpd), 0) AS BB_DPD_MONTHS, coalesce(sum(sev), 0) AS BB_SEVERE_DPD_MONTHS, avg(dpd) AS BB_DPD_RATIO
FROM (SELECT SK_ID_BUREAU, MONTHS_BALANCE,
  CASE STATUS WHEN 'C' THEN 0 WHEN 'X' THEN -1 WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2
   WHEN '3' THEN 3 WHEN '4' THEN 4 WHEN '5' THEN 5 END AS s,
  CASE WHEN STATUS IN ('1', '2', '3', '4', '5') THEN 1 ELSE 0 END AS dpd,
  CASE WHEN STATUS IN ('3', '4', '5') THEN 1 ELSE 0 END AS sev
  FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL) t
GROUP BY SK_ID_BUREAU"""

_BB_INTS = ["SK_ID_BUREAU", "BB_MONTHS_COUNT", "BB_STATUS_MAX", "BB_DPD_MONTHS", "BB_SEVERE_DPD_MONTHS"]
_BB_DBLS = ["BB_STATUS_MEAN", "BB_DPD_RATIO"]


@query("bureau_balance_features", norm_sql(_BB_INNER, ints=_BB_INTS, dbls=_BB_DBLS,
                                           prefix=A.cte("bureau_balance")))
def bureau_balance_features(spark, sf_dir):
    return tidy(P.bureau_balance_features(A.adapter(spark, sf_dir, "bureau_balance")))


_BJ_INNER = "SELECT b.*, bb.BB_MONTHS_COUNT, bb.BB_STATUS_MAX, bb.BB_STATUS_MEAN, bb.BB_DPD_MONTHS, " \
            "bb.BB_SEVERE_DPD_MONTHS, bb.BB_DPD_RATIO FROM bureau b LEFT JOIN bb ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU"


@query("bureau_balance_join", norm_sql(
    _BJ_INNER, ints=_SCAN_INTS + _BB_INTS[1:], strs=["CREDIT_ACTIVE"], dbls=_SCAN_DBLS + _BB_DBLS,
    prefix=A.cte("bureau", "bureau_balance", extra=(("bb", _BB_INNER),))))
def bureau_balance_join(spark, sf_dir):
    t = A.loan_tables(spark, sf_dir, ("bureau", "bureau_balance"))
    return tidy(P.bureau_with_balance(t["bureau"], t["bureau_balance"]))


_BUREAU_AGG = """
SELECT SK_ID_CURR, count(SK_ID_BUREAU) AS BUREAU_LOAN_COUNT,
 coalesce(sum(CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END), 0) AS BUREAU_ACTIVE_COUNT,
 coalesce(sum(CASE WHEN CREDIT_ACTIVE = 'Closed' THEN 1 ELSE 0 END), 0) AS BUREAU_CLOSED_COUNT,
 coalesce(sum(CASE WHEN CREDIT_ACTIVE = 'Bad debt' THEN 1 ELSE 0 END), 0) AS BUREAU_BAD_DEBT_COUNT,
 coalesce(sum(CASE WHEN CREDIT_ACTIVE = 'Sold' THEN 1 ELSE 0 END), 0) AS BUREAU_SOLD_COUNT,
 avg(CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END) AS BUREAU_ACTIVE_RATIO,
 coalesce(sum(AMT_CREDIT_SUM), 0) AS BUREAU_CREDIT_SUM, avg(AMT_CREDIT_SUM) AS BUREAU_CREDIT_MEAN,
 max(AMT_CREDIT_SUM) AS BUREAU_CREDIT_MAX,
 coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS BUREAU_DEBT_SUM, avg(AMT_CREDIT_SUM_DEBT) AS BUREAU_DEBT_MEAN,
 coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) AS BUREAU_OVERDUE_SUM, max(AMT_CREDIT_SUM_OVERDUE) AS BUREAU_OVERDUE_MAX,
 coalesce(sum(AMT_CREDIT_SUM_LIMIT), 0) AS BUREAU_LIMIT_SUM, max(AMT_CREDIT_MAX_OVERDUE) AS BUREAU_MAX_OVERDUE_EVER,
 max(CREDIT_DAY_OVERDUE) AS BUREAU_DPD_MAX, avg(CREDIT_DAY_OVERDUE) AS BUREAU_DPD_MEAN,
 avg(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MEAN, min(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MIN,
 avg(DAYS_CREDIT_ENDDATE) AS BUREAU_ENDDATE_MEAN, max(DAYS_CREDIT_ENDDATE) AS BUREAU_ENDDATE_MAX,
 coalesce(sum(CNT_CREDIT_PROLONG), 0) AS BUREAU_CNT_PROLONG_SUM,
 coalesce(sum(BB_DPD_MONTHS), 0) AS BUREAU_BB_DPD_MONTHS_SUM, avg(BB_DPD_RATIO) AS BUREAU_BB_DPD_RATIO_MEAN,
 max(BB_STATUS_MAX) AS BUREAU_BB_STATUS_MAX, coalesce(sum(BB_SEVERE_DPD_MONTHS), 0) AS BUREAU_BB_SEVERE_DPD_SUM,
 avg(BB_MONTHS_COUNT) AS BUREAU_BB_MONTHS_MEAN
FROM bj WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

BUREAU_FEATURES_SQL = f"""
SELECT g.*, {ratio_sql('BUREAU_DEBT_SUM', 'BUREAU_CREDIT_SUM')} AS BUREAU_DEBT_CREDIT_RATIO,
 {ratio_sql('BUREAU_OVERDUE_SUM', 'BUREAU_DEBT_SUM')} AS BUREAU_OVERDUE_DEBT_RATIO
FROM ({_BUREAU_AGG}) g"""

BUREAU_CTES = (("bb", _BB_INNER), ("bj", _BJ_INNER))
BUREAU_INTS = ["BUREAU_LOAN_COUNT", "BUREAU_ACTIVE_COUNT", "BUREAU_CLOSED_COUNT", "BUREAU_BAD_DEBT_COUNT",
               "BUREAU_SOLD_COUNT", "BUREAU_DPD_MAX", "BUREAU_DAYS_CREDIT_MIN", "BUREAU_ENDDATE_MAX",
               "BUREAU_CNT_PROLONG_SUM", "BUREAU_BB_DPD_MONTHS_SUM", "BUREAU_BB_STATUS_MAX",
               "BUREAU_BB_SEVERE_DPD_SUM"]
BUREAU_DBLS = ["BUREAU_ACTIVE_RATIO", "BUREAU_CREDIT_SUM", "BUREAU_CREDIT_MEAN", "BUREAU_CREDIT_MAX",
               "BUREAU_DEBT_SUM", "BUREAU_DEBT_MEAN", "BUREAU_OVERDUE_SUM", "BUREAU_OVERDUE_MAX",
               "BUREAU_LIMIT_SUM", "BUREAU_MAX_OVERDUE_EVER", "BUREAU_DPD_MEAN", "BUREAU_DAYS_CREDIT_MEAN",
               "BUREAU_ENDDATE_MEAN", "BUREAU_BB_DPD_RATIO_MEAN", "BUREAU_BB_MONTHS_MEAN",
               "BUREAU_DEBT_CREDIT_RATIO", "BUREAU_OVERDUE_DEBT_RATIO"]


@query("bureau_features", norm_sql(BUREAU_FEATURES_SQL, ints=["SK_ID_CURR"] + BUREAU_INTS, dbls=BUREAU_DBLS,
                                   prefix=A.cte("bureau", "bureau_balance", extra=BUREAU_CTES)))
def bureau_features(spark, sf_dir):
    t = A.loan_tables(spark, sf_dir, ("bureau", "bureau_balance"))
    return tidy(P.bureau_features(t["bureau"], t["bureau_balance"]))


@query("two_level_agg", norm_sql(
    "SELECT SK_ID_CURR, BUREAU_LOAN_COUNT, BUREAU_BB_DPD_MONTHS_SUM, BUREAU_BB_STATUS_MAX, "
    "BUREAU_BB_SEVERE_DPD_SUM, BUREAU_BB_DPD_RATIO_MEAN, BUREAU_BB_MONTHS_MEAN FROM (" + _BUREAU_AGG + ") g",
    ints=["SK_ID_CURR", "BUREAU_LOAN_COUNT", "BUREAU_BB_DPD_MONTHS_SUM", "BUREAU_BB_STATUS_MAX",
          "BUREAU_BB_SEVERE_DPD_SUM"],
    dbls=["BUREAU_BB_DPD_RATIO_MEAN", "BUREAU_BB_MONTHS_MEAN"],
    prefix=A.cte("bureau", "bureau_balance", extra=BUREAU_CTES)))
def two_level_agg(spark, sf_dir):
    """Monthly status -> credit -> applicant: the balance-derived columns of the bureau pack."""
    t = A.loan_tables(spark, sf_dir, ("bureau", "bureau_balance"))
    out = P.bureau_features(t["bureau"], t["bureau_balance"])
    return tidy(out.select("SK_ID_CURR", "BUREAU_LOAN_COUNT", "BUREAU_BB_DPD_MONTHS_SUM", "BUREAU_BB_STATUS_MAX",
                           "BUREAU_BB_SEVERE_DPD_SUM", "BUREAU_BB_DPD_RATIO_MEAN", "BUREAU_BB_MONTHS_MEAN"))


@query("agg_basic", norm_sql(
    """SELECT SK_ID_CURR, count(AMT_CREDIT_SUM) AS n_credit, count(DISTINCT CREDIT_ACTIVE) AS n_status,
     coalesce(sum(AMT_CREDIT_SUM), 0) AS sum_credit, avg(AMT_CREDIT_SUM) AS mean_credit,
     min(DAYS_CREDIT) AS min_days, max(DAYS_CREDIT) AS max_days, stddev_samp(AMT_CREDIT_SUM) AS std_credit,
     avg(CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END) AS active_ratio
     FROM bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    ints=["SK_ID_CURR", "n_credit", "n_status", "min_days", "max_days"],
    dbls=["sum_credit", "mean_credit", "std_credit", "active_ratio"], prefix=A.cte("bureau")))
def agg_basic(spark, sf_dir):
    """G-1..G-7 on one table: count, distinct count, null-safe sum, mean, min/max, sample std, flag mean."""
    from riskmart.functions import expr as X
    b = A.adapter(spark, sf_dir, "bureau")
    out = (b.where(F.col("SK_ID_CURR").isNotNull()).groupBy("SK_ID_CURR").agg(
        F.count("AMT_CREDIT_SUM").alias("n_credit"), F.countDistinct("CREDIT_ACTIVE").alias("n_status"),
        X.sum0("AMT_CREDIT_SUM").alias("sum_credit"), F.avg("AMT_CREDIT_SUM").alias("mean_credit"),
        F.min("DAYS_CREDIT").alias("min_days"), F.max("DAYS_CREDIT").alias("max_days"),
        F.stddev_samp("AMT_CREDIT_SUM").alias("std_credit"),
        F.avg(X.flag_eq("CREDIT_ACTIVE", "Active")).alias("active_ratio")))
    return tidy(out)


PREVIOUS_SQL = f"""
SELECT g.*, {ratio_sql('PREV_AMT_CREDIT_MEAN', 'PREV_AMT_APPLICATION_MEAN')} AS PREV_CREDIT_RATIO FROM (
SELECT SK_ID_CURR, count(SK_ID_PREV) AS PREV_APP_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END), 0) AS PREV_APPROVED_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END), 0) AS PREV_REFUSED_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Canceled' THEN 1 ELSE 0 END), 0) AS PREV_CANCELLED_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Unused offer' THEN 1 ELSE 0 END), 0) AS PREV_UNUSED_COUNT,
 avg(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END) AS PREV_APPROVED_RATIO,
 avg(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END) AS PREV_REFUSED_RATIO,
 coalesce(sum(CASE WHEN DAYS_DECISION >= -365 THEN 1 ELSE 0 END), 0) AS PREV_RECENT_APP_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_TYPE = 'Consumer loans' THEN 1 ELSE 0 END), 0) AS PREV_CONSUMER_LOAN_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_TYPE = 'Cash loans' THEN 1 ELSE 0 END), 0) AS PREV_CASH_LOAN_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_TYPE = 'Revolving loans' THEN 1 ELSE 0 END), 0) AS PREV_REVOLVING_COUNT,
 avg(AMT_CREDIT) AS PREV_AMT_CREDIT_MEAN, max(AMT_CREDIT) AS PREV_AMT_CREDIT_MAX,
 coalesce(sum(AMT_CREDIT), 0) AS PREV_AMT_CREDIT_SUM, avg(AMT_ANNUITY) AS PREV_AMT_ANNUITY_MEAN,
 avg(AMT_APPLICATION) AS PREV_AMT_APPLICATION_MEAN,
 avg(RATE_DOWN_PAYMENT) AS PREV_RATE_DOWN_PAYMENT_MEAN, max(RATE_DOWN_PAYMENT) AS PREV_RATE_DOWN_PAYMENT_MAX,
 avg(CNT_PAYMENT) AS PREV_CNT_PAYMENT_MEAN, max(CNT_PAYMENT) AS PREV_CNT_PAYMENT_MAX,
 avg(DAYS_DECISION) AS PREV_DAYS_DECISION_MEAN, max(DAYS_DECISION) AS PREV_DAYS_DECISION_MAX
FROM previous WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR) g"""
PREVIOUS_INTS = ["PREV_APP_COUNT", "PREV_APPROVED_COUNT", "PREV_REFUSED_COUNT", "PREV_CANCELLED_COUNT",
                 "PREV_UNUSED_COUNT", "PREV_RECENT_APP_COUNT", "PREV_CONSUMER_LOAN_COUNT", "PREV_CASH_LOAN_COUNT",
                 "PREV_REVOLVING_COUNT", "PREV_CNT_PAYMENT_MAX", "PREV_DAYS_DECISION_MAX"]
PREVIOUS_DBLS = ["PREV_APPROVED_RATIO", "PREV_REFUSED_RATIO", "PREV_AMT_CREDIT_MEAN", "PREV_AMT_CREDIT_MAX",
                 "PREV_AMT_CREDIT_SUM", "PREV_AMT_ANNUITY_MEAN", "PREV_AMT_APPLICATION_MEAN",
                 "PREV_RATE_DOWN_PAYMENT_MEAN", "PREV_RATE_DOWN_PAYMENT_MAX", "PREV_CNT_PAYMENT_MEAN",
                 "PREV_DAYS_DECISION_MEAN", "PREV_CREDIT_RATIO"]


@query("previous_features", norm_sql(PREVIOUS_SQL, ints=["SK_ID_CURR"] + PREVIOUS_INTS, dbls=PREVIOUS_DBLS,
                                     prefix=A.cte("previous")))
def previous_features(spark, sf_dir):
    return tidy(P.previous_features(A.adapter(spark, sf_dir, "previous")))


INSTALLMENT_SQL = f"""
SELECT SK_ID_CURR, INSTAL_COUNT, {clip_sql('INSTAL_DPD_MAX', hi=365)} AS INSTAL_DPD_MAX, INSTAL_DPD_MEAN,
 INSTAL_DPD_STD, INSTAL_LATE_COUNT, INSTAL_LATE_RATIO, INSTAL_AMT_PAYMENT_MEAN, INSTAL_AMT_PAYMENT_SUM,
 coalesce(INSTAL_DEFICIT_MEAN, 0e0) AS INSTAL_DEFICIT_MEAN, INSTAL_DEFICIT_SUM, INSTAL_DEFICIT_MAX,
 INSTAL_UNDERPAYMENT_COUNT, INSTAL_UNDERPAYMENT_RATIO, INSTAL_PAYMENT_PERC_MEAN, INSTAL_PAYMENT_PERC_MIN,
 INSTAL_VERSION_MAX, INSTAL_NUM_UNIQUE_LOANS FROM (
SELECT SK_ID_CURR, count(SK_ID_PREV) AS INSTAL_COUNT, max(dpd) AS INSTAL_DPD_MAX, avg(dpd) AS INSTAL_DPD_MEAN,
 stddev_samp(dpd) AS INSTAL_DPD_STD, coalesce(sum(late), 0) AS INSTAL_LATE_COUNT, avg(late) AS INSTAL_LATE_RATIO,
 avg(AMT_PAYMENT) AS INSTAL_AMT_PAYMENT_MEAN, coalesce(sum(AMT_PAYMENT), 0) AS INSTAL_AMT_PAYMENT_SUM,
 avg(deficit) AS INSTAL_DEFICIT_MEAN, coalesce(sum(deficit), 0) AS INSTAL_DEFICIT_SUM, max(deficit) AS INSTAL_DEFICIT_MAX,
 coalesce(sum(under), 0) AS INSTAL_UNDERPAYMENT_COUNT, avg(under) AS INSTAL_UNDERPAYMENT_RATIO,
 avg(perc) AS INSTAL_PAYMENT_PERC_MEAN, min(perc) AS INSTAL_PAYMENT_PERC_MIN,
 max(NUM_INSTALMENT_VERSION) AS INSTAL_VERSION_MAX, count(DISTINCT SK_ID_PREV) AS INSTAL_NUM_UNIQUE_LOANS
FROM (SELECT SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_VERSION, AMT_PAYMENT,
   DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS dpd,
   CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN 1 ELSE 0 END AS late,
   AMT_INSTALMENT - AMT_PAYMENT AS deficit,
   CASE WHEN AMT_INSTALMENT - AMT_PAYMENT > 0 THEN 1 ELSE 0 END AS under,
   {ratio_sql('AMT_PAYMENT', 'AMT_INSTALMENT')} AS perc
  FROM installments WHERE SK_ID_CURR IS NOT NULL) t
GROUP BY SK_ID_CURR) g"""
INSTALLMENT_INTS = ["INSTAL_COUNT", "INSTAL_DPD_MAX", "INSTAL_LATE_COUNT", "INSTAL_UNDERPAYMENT_COUNT",
                    "INSTAL_VERSION_MAX", "INSTAL_NUM_UNIQUE_LOANS"]
INSTALLMENT_DBLS = ["INSTAL_DPD_MEAN", "INSTAL_DPD_STD", "INSTAL_LATE_RATIO", "INSTAL_AMT_PAYMENT_MEAN",
                    "INSTAL_AMT_PAYMENT_SUM", "INSTAL_DEFICIT_MEAN", "INSTAL_DEFICIT_SUM", "INSTAL_DEFICIT_MAX",
                    "INSTAL_UNDERPAYMENT_RATIO", "INSTAL_PAYMENT_PERC_MEAN", "INSTAL_PAYMENT_PERC_MIN"]


@query("installment_features", norm_sql(INSTALLMENT_SQL, ints=["SK_ID_CURR"] + INSTALLMENT_INTS,
                                        dbls=INSTALLMENT_DBLS, prefix=A.cte("installments")))
def installment_features(spark, sf_dir):
    return tidy(P.installment_features(A.adapter(spark, sf_dir, "installments")))


POS_SQL = """
SELECT SK_ID_CURR, count(SK_ID_PREV) AS POS_COUNT, count(DISTINCT SK_ID_PREV) AS POS_UNIQUE_LOANS,
 max(SK_DPD) AS POS_DPD_MAX, avg(SK_DPD) AS POS_DPD_MEAN, max(SK_DPD_DEF) AS POS_DPD_DEF_MAX,
 avg(SK_DPD_DEF) AS POS_DPD_DEF_MEAN,
 coalesce(sum(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END), 0) AS POS_DPD_MONTHS,
 coalesce(sum(CASE WHEN SK_DPD > 30 THEN 1 ELSE 0 END), 0) AS POS_SEVERE_DPD_MONTHS,
 avg(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END) AS POS_DPD_RATIO,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Active' THEN 1 ELSE 0 END), 0) AS POS_ACTIVE_COUNT,
 coalesce(sum(CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END), 0) AS POS_COMPLETED_COUNT,
 avg(CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END) AS POS_COMPLETED_RATIO,
 max(MONTHS_BALANCE) AS POS_MONTHS_BALANCE_MAX, avg(MONTHS_BALANCE) AS POS_MONTHS_BALANCE_MEAN,
 avg(CNT_INSTALMENT_FUTURE) AS POS_CNT_INSTALMENT_FUTURE_MEAN
FROM pos_cash WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""
POS_INTS = ["POS_COUNT", "POS_UNIQUE_LOANS", "POS_DPD_MAX", "POS_DPD_DEF_MAX", "POS_DPD_MONTHS",
            "POS_SEVERE_DPD_MONTHS", "POS_ACTIVE_COUNT", "POS_COMPLETED_COUNT", "POS_MONTHS_BALANCE_MAX"]
POS_DBLS = ["POS_DPD_MEAN", "POS_DPD_DEF_MEAN", "POS_DPD_RATIO", "POS_COMPLETED_RATIO", "POS_MONTHS_BALANCE_MEAN",
            "POS_CNT_INSTALMENT_FUTURE_MEAN"]


@query("pos_cash_features", norm_sql(POS_SQL, ints=["SK_ID_CURR"] + POS_INTS, dbls=POS_DBLS,
                                     prefix=A.cte("pos_cash")))
def pos_cash_features(spark, sf_dir):
    return tidy(P.pos_cash_features(A.adapter(spark, sf_dir, "pos_cash")))


CC_SQL = f"""
SELECT g.*, {ratio_sql('CC_DRAWINGS_ATM_MEAN', 'CC_DRAWINGS_TOTAL_MEAN')} AS CC_ATM_DRAW_RATIO FROM (
SELECT SK_ID_CURR, count(SK_ID_PREV) AS CC_COUNT, count(DISTINCT SK_ID_PREV) AS CC_UNIQUE_CARDS,
 avg(util) AS CC_UTILIZATION_MEAN, max(util) AS CC_UTILIZATION_MAX, stddev_samp(util) AS CC_UTILIZATION_STD,
 avg(AMT_BALANCE) AS CC_AMT_BALANCE_MEAN, max(AMT_BALANCE) AS CC_AMT_BALANCE_MAX,
 avg(AMT_CREDIT_LIMIT_ACTUAL) AS CC_CREDIT_LIMIT_MEAN, avg(prate) AS CC_PAYMENT_RATE_MEAN,
 min(prate) AS CC_PAYMENT_RATE_MIN, avg(above) AS CC_PAYS_ABOVE_MIN_RATIO,
 avg(AMT_PAYMENT_TOTAL_CURRENT) AS CC_AMT_PAYMENT_MEAN, avg(AMT_DRAWINGS_ATM_CURRENT) AS CC_DRAWINGS_ATM_MEAN,
 avg(AMT_DRAWINGS_CURRENT) AS CC_DRAWINGS_TOTAL_MEAN, avg(CNT_DRAWINGS_ATM_CURRENT) AS CC_CNT_DRAWINGS_ATM,
 max(SK_DPD) AS CC_DPD_MAX, avg(SK_DPD) AS CC_DPD_MEAN, max(SK_DPD_DEF) AS CC_DPD_DEF_MAX,
 coalesce(sum(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END), 0) AS CC_DPD_MONTHS,
 coalesce(sum(CASE WHEN SK_DPD > 30 THEN 1 ELSE 0 END), 0) AS CC_SEVERE_DPD_MONTHS,
 avg(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END) AS CC_DPD_RATIO
FROM (SELECT c.*, {clip_sql(ratio_sql('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL'), '0e0', '1e0')} AS util,
   CASE WHEN AMT_PAYMENT_TOTAL_CURRENT > AMT_INST_MIN_REGULARITY THEN 1 ELSE 0 END AS above,
   {clip_sql(ratio_sql('AMT_PAYMENT_TOTAL_CURRENT', 'AMT_BALANCE'), '0e0', '2e0')} AS prate
  FROM credit_card c WHERE SK_ID_CURR IS NOT NULL) t
GROUP BY SK_ID_CURR) g"""
CC_INTS = ["CC_COUNT", "CC_UNIQUE_CARDS", "CC_DPD_MAX", "CC_DPD_DEF_MAX", "CC_DPD_MONTHS", "CC_SEVERE_DPD_MONTHS"]
CC_DBLS = ["CC_UTILIZATION_MEAN", "CC_UTILIZATION_MAX", "CC_UTILIZATION_STD", "CC_AMT_BALANCE_MEAN",
           "CC_AMT_BALANCE_MAX", "CC_CREDIT_LIMIT_MEAN", "CC_PAYMENT_RATE_MEAN", "CC_PAYMENT_RATE_MIN",
           "CC_PAYS_ABOVE_MIN_RATIO", "CC_AMT_PAYMENT_MEAN", "CC_DRAWINGS_ATM_MEAN", "CC_DRAWINGS_TOTAL_MEAN",
           "CC_CNT_DRAWINGS_ATM", "CC_DPD_MEAN", "CC_DPD_RATIO", "CC_ATM_DRAW_RATIO"]


@query("credit_card_features", norm_sql(CC_SQL, ints=["SK_ID_CURR"] + CC_INTS, dbls=CC_DBLS,
                                        prefix=A.cte("credit_card")))
def credit_card_features(spark, sf_dir):
    return tidy(P.credit_card_features(A.adapter(spark, sf_dir, "credit_card")))


# ---------------------------------------------------------------------------
# application pack
# ---------------------------------------------------------------------------

APP_RAW_INTS = ["SK_ID_CURR", "TARGET", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH",
                "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_EMAIL",
                "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
APP_RAW_DBLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1",
                "EXT_SOURCE_2", "EXT_SOURCE_3"]
APP_RAW_STRS = ["CODE_GENDER", "OCCUPATION_TYPE"]
APP_NEW_INTS = ["IS_UNEMPLOYED", "DOCS_PROVIDED_COUNT", "CONTACT_CHANNELS_COUNT"]
APP_NEW_DBLS = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_TERM_MONTHS", "GOODS_CREDIT_RATIO",
                "AGE_YEARS", "EMPLOYED_YEARS", "EMPLOYMENT_AGE_RATIO", "REGISTRATION_YEARS", "ID_PUBLISH_YEARS",
                "EXT_SOURCE_MEAN", "EXT_SOURCE_MIN", "EXT_SOURCE_STD", "EXT_SOURCE_PRODUCT",
                "CREDIT_INCOME_x_EXT2", "ANNUITY_INCOME_x_EXT2"]

_EXT_N = ("((CASE WHEN EXT_SOURCE_1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN EXT_SOURCE_2 IS NULL THEN 0 ELSE 1 END)"
          " + (CASE WHEN EXT_SOURCE_3 IS NULL THEN 0 ELSE 1 END))")
_EXT_SUM = "(coalesce(EXT_SOURCE_1, 0e0) + coalesce(EXT_SOURCE_2, 0e0) + coalesce(EXT_SOURCE_3, 0e0))"

APPLICATION_SQL = f"""
SELECT SK_ID_CURR, TARGET, CODE_GENDER, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE, DAYS_BIRTH,
 NULLIF(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED, DAYS_REGISTRATION, DAYS_ID_PUBLISH,
 EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3, FLAG_DOCUMENT_2, FLAG_DOCUMENT_3, FLAG_MOBIL, FLAG_EMP_PHONE, FLAG_EMAIL,
 CASE WHEN FLAG_OWN_CAR = 'Y' THEN 1 ELSE 0 END AS FLAG_OWN_CAR,
 CASE WHEN FLAG_OWN_REALTY = 'Y' THEN 1 ELSE 0 END AS FLAG_OWN_REALTY, OCCUPATION_TYPE,
 {ratio_sql('AMT_CREDIT', 'AMT_INCOME_TOTAL')} AS CREDIT_INCOME_RATIO,
 {ratio_sql('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} AS ANNUITY_INCOME_RATIO,
 {ratio_sql('AMT_CREDIT', 'AMT_ANNUITY')} AS CREDIT_TERM_MONTHS,
 {ratio_sql('AMT_GOODS_PRICE', 'AMT_CREDIT')} AS GOODS_CREDIT_RATIO,
 -DAYS_BIRTH / 365e0 AS AGE_YEARS,
 CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS IS_UNEMPLOYED,
 -NULLIF(DAYS_EMPLOYED, 365243) / 365e0 AS EMPLOYED_YEARS,
 {ratio_sql('(-NULLIF(DAYS_EMPLOYED, 365243) / 365e0)', '(-DAYS_BIRTH / 365e0)')} AS EMPLOYMENT_AGE_RATIO,
 -DAYS_REGISTRATION / 365e0 AS REGISTRATION_YEARS, -DAYS_ID_PUBLISH / 365e0 AS ID_PUBLISH_YEARS,
 CASE WHEN {_EXT_N} > 0 THEN {_EXT_SUM} / {_EXT_N} END AS EXT_SOURCE_MEAN,
 least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3) AS EXT_SOURCE_MIN,
 coalesce(CASE WHEN {_EXT_N} > 1 THEN sqrt((
   coalesce(power(EXT_SOURCE_1 - {_EXT_SUM} / {_EXT_N}, 2), 0e0) + coalesce(power(EXT_SOURCE_2 - {_EXT_SUM} / {_EXT_N}, 2), 0e0)
   + coalesce(power(EXT_SOURCE_3 - {_EXT_SUM} / {_EXT_N}, 2), 0e0)) / ({_EXT_N} - 1)) END, 0e0) AS EXT_SOURCE_STD,
 EXT_SOURCE_2 * EXT_SOURCE_3 AS EXT_SOURCE_PRODUCT,
 {ratio_sql('AMT_CREDIT', 'AMT_INCOME_TOTAL')} * EXT_SOURCE_2 AS CREDIT_INCOME_x_EXT2,
 {ratio_sql('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} * EXT_SOURCE_2 AS ANNUITY_INCOME_x_EXT2,
 FLAG_DOCUMENT_2 + FLAG_DOCUMENT_3 AS DOCS_PROVIDED_COUNT,
 FLAG_MOBIL + FLAG_EMP_PHONE + FLAG_EMAIL AS CONTACT_CHANNELS_COUNT
FROM application"""


@query("application_features", norm_sql(APPLICATION_SQL, ints=APP_RAW_INTS + APP_NEW_INTS, strs=APP_RAW_STRS,
                                        dbls=APP_RAW_DBLS + APP_NEW_DBLS, prefix=A.cte("application")))
def application_features(spark, sf_dir):
    return tidy(P.application_features(A.adapter(spark, sf_dir, "application")))


# ---------------------------------------------------------------------------
# Master table, joins, coverage
# ---------------------------------------------------------------------------

def _master_sql() -> str:
    blocks = [("bf", BUREAU_FEATURES_SQL, BUREAU_INTS + BUREAU_DBLS),
              ("pf", PREVIOUS_SQL, PREVIOUS_INTS + PREVIOUS_DBLS),
              ("inf", INSTALLMENT_SQL, INSTALLMENT_INTS + INSTALLMENT_DBLS),
              ("pcf", POS_SQL, POS_INTS + POS_DBLS),
              ("ccf", CC_SQL, CC_INTS + CC_DBLS)]
    sel = ["a.*"]
    for alias, _, cols in blocks:
        sel += [f"coalesce({alias}.{c}, 0) AS {c}" for c in cols]
    joins = " ".join(f"LEFT JOIN {alias} ON a.SK_ID_CURR = {alias}.SK_ID_CURR" for alias, _, _ in blocks)
    return f"SELECT {', '.join(sel)} FROM appf a {joins}"


MASTER_CTES = (("appf", APPLICATION_SQL),) + BUREAU_CTES + (
    ("bf", BUREAU_FEATURES_SQL), ("pf", PREVIOUS_SQL), ("inf", INSTALLMENT_SQL), ("pcf", POS_SQL), ("ccf", CC_SQL))
MASTER_INTS = APP_RAW_INTS + APP_NEW_INTS + BUREAU_INTS + PREVIOUS_INTS + INSTALLMENT_INTS + POS_INTS + CC_INTS
MASTER_DBLS = APP_RAW_DBLS + APP_NEW_DBLS + BUREAU_DBLS + PREVIOUS_DBLS + INSTALLMENT_DBLS + POS_DBLS + CC_DBLS
MASTER_SQL_PREFIX = A.cte(*A.LOAN_TABLES, extra=MASTER_CTES)
MASTER_SQL = _master_sql()


@query("master_features", norm_sql(MASTER_SQL, ints=MASTER_INTS, strs=APP_RAW_STRS, dbls=MASTER_DBLS,
                                   prefix=MASTER_SQL_PREFIX))
def master_features(spark, sf_dir):
    return tidy(M.build_master(A.loan_tables(spark, sf_dir)))


@query("zero_fill_prefix", norm_sql(
    "SELECT a.SK_ID_CURR, coalesce(pcf.POS_DPD_MEAN, 0) AS POS_DPD_MEAN, coalesce(pcf.POS_COUNT, 0) AS POS_COUNT, "
    "coalesce(ccf.CC_UTILIZATION_STD, 0) AS CC_UTILIZATION_STD, a.AMT_ANNUITY "
    "FROM application a LEFT JOIN pcf ON a.SK_ID_CURR = pcf.SK_ID_CURR LEFT JOIN ccf ON a.SK_ID_CURR = ccf.SK_ID_CURR",
    ints=["SK_ID_CURR", "POS_COUNT"], dbls=["POS_DPD_MEAN", "CC_UTILIZATION_STD", "AMT_ANNUITY"],
    prefix=A.cte("application", "pos_cash", "credit_card", extra=(("pcf", POS_SQL), ("ccf", CC_SQL)))))
def zero_fill_prefix(spark, sf_dir):
    """P-14: NULL -> 0 only in the prefixed columns (AMT_ANNUITY keeps its NULLs)."""
    t = A.loan_tables(spark, sf_dir, ("application", "pos_cash", "credit_card"))
    joined = (t["application"].select("SK_ID_CURR", "AMT_ANNUITY")
              .join(P.pos_cash_features(t["pos_cash"]).select("SK_ID_CURR", "POS_DPD_MEAN", "POS_COUNT"), "SK_ID_CURR", "left")
              .join(P.credit_card_features(t["credit_card"]).select("SK_ID_CURR", "CC_UTILIZATION_STD"), "SK_ID_CURR", "left"))
    return tidy(M.zero_fill_prefix(joined, ("POS_", "CC_")))


@query("no_history_anti", norm_sql(
    "SELECT SK_ID_CURR, TARGET FROM application a WHERE NOT EXISTS "
    "(SELECT 1 FROM bureau b WHERE b.SK_ID_CURR = a.SK_ID_CURR)",
    ints=["SK_ID_CURR", "TARGET"], prefix=A.cte("application", "bureau")))
def no_history_anti(spark, sf_dir):
    t = A.loan_tables(spark, sf_dir, ("application", "bureau"))
    return tidy(M.no_history(t["application"].select("SK_ID_CURR", "TARGET"), t["bureau"]))


_COVERAGE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(h.SK_ID_CURR) AS with_history, "
    f"count(*) - count(h.SK_ID_CURR) AS without_history, count(h.SK_ID_CURR) / count(*) AS coverage_ratio "
    f"FROM application a LEFT JOIN (SELECT DISTINCT SK_ID_CURR FROM {n}) h ON a.SK_ID_CURR = h.SK_ID_CURR"
    for n in ("bureau", "previous", "installments", "pos_cash", "credit_card"))


@query("history_coverage", norm_sql(_COVERAGE_SQL, ints=["with_history", "without_history"], strs=["table_name"],
                                    dbls=["coverage_ratio"], prefix=A.cte(*A.LOAN_TABLES)))
def history_coverage(spark, sf_dir):
    return tidy(M.history_coverage(A.loan_tables(spark, sf_dir)))
