"""Master table assembly on the sf0.001 adapter views: counts, keys, zero-fill, coverage."""

import pytest
from pyspark.sql import functions as F

from riskmart.operators import packs as P
from riskmart.plans import master as M
from riskmart.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return A.loan_tables(spark, SF)


@pytest.fixture(scope="module")
def master(tables):
    return M.build_master(tables).cache()


def test_row_count_and_keys(master, tables):
    n_app = tables["application"].count()
    assert master.count() == n_app
    assert master.select("SK_ID_CURR").distinct().count() == n_app
    assert master.where(F.col("TARGET").isNull()).count() == 0


def test_prefixed_columns_have_no_nulls(master):
    cols = [c for c in master.columns if c.startswith(P.FEATURE_PREFIXES)]
    assert len(cols) == 29 + 23 + 17 + 15 + 22  # bureau, previous, installments, pos, cards
    nulls = master.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    assert all(v == 0 for v in nulls)


def test_no_history_rows_are_zero(master, tables):
    without = M.no_history(tables["application"], tables["bureau"]).select("SK_ID_CURR")
    rows = master.join(without, "SK_ID_CURR", "left_semi").select("BUREAU_LOAN_COUNT", "BUREAU_CREDIT_SUM").collect()
    assert rows and all(r[0] == 0 and r[1] == 0 for r in rows)


def test_application_columns_kept_and_added(master, tables):
    for c in tables["application"].columns + ["CREDIT_INCOME_RATIO", "EXT_SOURCE_MEAN", "BUREAU_DEBT_CREDIT_RATIO",
                                               "INSTAL_DPD_MAX", "CC_ATM_DRAW_RATIO", "PREV_CREDIT_RATIO"]:
        assert c in master.columns


def test_ratios_in_unit_interval(master):
    for c in ["BUREAU_ACTIVE_RATIO", "PREV_APPROVED_RATIO", "INSTAL_LATE_RATIO", "POS_DPD_RATIO", "CC_DPD_RATIO",
              "CC_UTILIZATION_MAX", "CC_PAYS_ABOVE_MIN_RATIO"]:
        lo, hi = master.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo <= hi <= 1.0, c


def test_history_coverage_adds_up(tables):
    n_app = tables["application"].count()
    for r in M.history_coverage(tables).collect():
        assert r["with_history"] + r["without_history"] == n_app


def test_previous_ratio_and_cash_loans(spark):
    prev = spark.createDataFrame(
        [(7, 1, "Approved", "Cash loans", 100.0, None, 110.0, None, None, -10),
         (7, 2, "Refused", "Consumer loans", 50.0, 5.0, 60.0, 0.1, 12.0, -400),
         (7, 3, "Approved", "XNA", 80.0, 8.0, None, None, 24.0, -700)],
        "SK_ID_CURR long, SK_ID_PREV long, NAME_CONTRACT_STATUS string, NAME_CONTRACT_TYPE string, AMT_CREDIT double, "
        "AMT_ANNUITY double, AMT_APPLICATION double, RATE_DOWN_PAYMENT double, CNT_PAYMENT double, DAYS_DECISION long")
    r = P.previous_features(prev).first()
    assert r["PREV_APPROVED_RATIO"] == pytest.approx(2 / 3)
    assert r["PREV_CASH_LOAN_COUNT"] == 1 and r["PREV_RECENT_APP_COUNT"] == 1
    assert r["PREV_RATE_DOWN_PAYMENT_MEAN"] == pytest.approx(0.1)
    assert r["PREV_CREDIT_RATIO"] == pytest.approx((230 / 3) / (85 + 1))
