"""Feature packs on tiny hand-made tables (NULL rules, sentinels, two-level aggregation)."""

import math

import pytest

from riskmart.operators import packs as P

APP_SCHEMA = ("SK_ID_CURR long, TARGET int, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, "
              "AMT_GOODS_PRICE double, DAYS_BIRTH long, DAYS_EMPLOYED long, EXT_SOURCE_1 double, EXT_SOURCE_2 double, "
              "EXT_SOURCE_3 double, CODE_GENDER string, FLAG_DOCUMENT_2 int, FLAG_DOCUMENT_5 int, FLAG_PHONE int, "
              "FLAG_OWN_CAR string")


@pytest.fixture
def app(spark):
    rows = [
        (101, 0, 90_000.0, 450_000.0, 20_000.0, 400_000.0, -11000, -2000, 0.5, 0.6, 0.4, "F", 1, 0, 1, "Y"),
        (102, 1, 40_000.0, 200_000.0, 12_000.0, None, -16000, 365243, None, 0.3, 0.5, "M", 0, 0, None, "N"),
        (103, 0, 0.0, 100_000.0, None, 90_000.0, -9000, -100, None, None, None, "F", 1, 1, 0, None),
    ]
    return spark.createDataFrame(rows, APP_SCHEMA)


def _by_id(df, key="SK_ID_CURR"):
    return {r[key]: r for r in df.collect()}


def test_ratios_use_plus_one_denominator(app):
    out = _by_id(P.application_features(app))
    assert out[101]["CREDIT_INCOME_RATIO"] == pytest.approx(450_000 / 90_001)
    assert out[101]["ANNUITY_INCOME_RATIO"] == pytest.approx(20_000 / 90_001)
    assert out[101]["CREDIT_TERM_MONTHS"] == pytest.approx(450_000 / 20_001)
    # zero income: ratio is finite (denominator 1), missing annuity stays missing
    assert out[103]["CREDIT_INCOME_RATIO"] == pytest.approx(100_000.0)
    assert out[103]["CREDIT_TERM_MONTHS"] is None


def test_employment_sentinel(app):
    out = _by_id(P.application_features(app))
    assert out[102]["IS_UNEMPLOYED"] == 1 and out[101]["IS_UNEMPLOYED"] == 0
    assert out[102]["DAYS_EMPLOYED"] is None and out[102]["EMPLOYED_YEARS"] is None
    assert out[101]["EMPLOYED_YEARS"] == pytest.approx(2000 / 365)
    assert out[101]["AGE_YEARS"] > 0


def test_external_score_stats_skip_missing(app):
    out = _by_id(P.application_features(app))
    assert out[102]["EXT_SOURCE_MEAN"] == pytest.approx(0.4)
    assert out[102]["EXT_SOURCE_MIN"] == pytest.approx(0.3)
    assert out[102]["EXT_SOURCE_STD"] == pytest.approx(math.sqrt(0.02))
    assert out[103]["EXT_SOURCE_MEAN"] is None and out[103]["EXT_SOURCE_STD"] == 0.0


def test_flag_counts_and_yes_flags(app):
    out = _by_id(P.application_features(app))
    assert out[103]["DOCS_PROVIDED_COUNT"] == 2
    assert out[102]["CONTACT_CHANNELS_COUNT"] == 0
    assert out[101]["FLAG_OWN_CAR"] == 1 and out[103]["FLAG_OWN_CAR"] == 0
    assert "REGISTRATION_YEARS" in out[101] and out[101]["REGISTRATION_YEARS"] == 0.0


@pytest.fixture
def bureau(spark):
    rows = [(1, 11, "Active", 1000.0, 500.0, 0.0, None, None, 0, -100, 50.0, 0),
            (1, 12, "Closed", None, None, 0.0, 10.0, 5.0, 0, -300, -20.0, 1),
            (2, 21, "Bad debt", 2000.0, 2000.0, 100.0, 2000.0, 50.0, 45, -50, None, 0),
            (None, 99, "Active", 1.0, 1.0, 0.0, 1.0, 1.0, 0, -1, 1.0, 0)]
    return spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, AMT_CREDIT_SUM double, "
                                       "AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double, AMT_CREDIT_SUM_LIMIT double, "
                                       "AMT_CREDIT_MAX_OVERDUE double, CREDIT_DAY_OVERDUE long, DAYS_CREDIT long, "
                                       "DAYS_CREDIT_ENDDATE double, CNT_CREDIT_PROLONG long")


@pytest.fixture
def bureau_balance(spark):
    rows = [(11, -1, "0"), (11, -2, "2"), (12, -1, "X"), (21, -1, "4"), (21, -2, "5"), (21, -3, "1"), (21, -4, "Q")]
    return spark.createDataFrame(rows, "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")


def test_bureau_two_level(bureau, bureau_balance):
    out = _by_id(P.bureau_features(bureau, bureau_balance))
    assert set(out) == {1, 2}  # NULL applicant key dropped
    assert out[1]["BUREAU_LOAN_COUNT"] == 2 and out[2]["BUREAU_BAD_DEBT_COUNT"] == 1
    assert out[1]["BUREAU_ACTIVE_RATIO"] == pytest.approx(0.5)
    assert out[1]["BUREAU_CREDIT_SUM"] == pytest.approx(1000.0)
    assert out[2]["BUREAU_BB_SEVERE_DPD_SUM"] == 2
    assert out[2]["BUREAU_BB_STATUS_MAX"] == 5
    assert out[1]["BUREAU_BB_DPD_MONTHS_SUM"] == 1
    assert out[2]["BUREAU_BB_MONTHS_MEAN"] == pytest.approx(4.0)
    assert out[1]["BUREAU_DEBT_CREDIT_RATIO"] == pytest.approx(500 / 1001)
    for r in out.values():
        for c in ("BUREAU_ACTIVE_COUNT", "BUREAU_CLOSED_COUNT", "BUREAU_SOLD_COUNT", "BUREAU_CNT_PROLONG_SUM"):
            assert r[c] >= 0


def test_bureau_balance_unknown_status_is_null(bureau_balance):
    out = _by_id(P.bureau_balance_features(bureau_balance), "SK_ID_BUREAU")
    assert out[21]["BB_MONTHS_COUNT"] == 4
    assert out[21]["BB_STATUS_MEAN"] == pytest.approx((4 + 5 + 1) / 3)
    assert out[12]["BB_STATUS_MAX"] == -1


@pytest.fixture
def installments(spark):
    rows = [(1, 7, 1.0, -30.0, -25.0, 100.0, 100.0), (1, 7, 2.0, -60.0, -61.0, 100.0, 90.0),
            (1, 8, 1.0, -10.0, None, 50.0, None), (2, 9, 1.0, -900.0, 200.0, 10.0, 10.0)]
    return spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_VERSION double, "
                                       "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double")


def test_installments(installments):
    out = _by_id(P.installment_features(installments))
    assert out[1]["INSTAL_COUNT"] == 3 and out[1]["INSTAL_NUM_UNIQUE_LOANS"] == 2
    assert out[1]["INSTAL_LATE_COUNT"] == 1 and out[1]["INSTAL_LATE_RATIO"] == pytest.approx(1 / 3)
    assert out[1]["INSTAL_UNDERPAYMENT_COUNT"] == 1
    assert out[2]["INSTAL_DPD_MAX"] == 365  # 1100 days capped
    assert out[2]["INSTAL_DPD_MEAN"] == pytest.approx(1100.0)  # mean is not capped
    assert out[2]["INSTAL_DPD_STD"] is None  # one value
    assert out[1]["INSTAL_DEFICIT_MEAN"] == pytest.approx(5.0)


def test_credit_card_zero_denominators(spark):
    rows = [(1, 5, -1.0, 1000.0, 10.0, 100.0, 0.0, 20.0, 1.0, 0, 0, -1),
            (1, 5, 500.0, 0.0, None, 0.0, 50.0, None, None, 40, 1, -2),
            (1, 6, -1.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, -3)]
    cc = spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double, "
                                     "AMT_DRAWINGS_ATM_CURRENT double, AMT_DRAWINGS_CURRENT double, AMT_PAYMENT_TOTAL_CURRENT double, "
                                     "AMT_INST_MIN_REGULARITY double, CNT_DRAWINGS_ATM_CURRENT double, SK_DPD int, SK_DPD_DEF int, "
                                     "MONTHS_BALANCE int")
    r = P.credit_card_features(cc).collect()[0]
    # payment/(balance+1): 0/0 -> missing, 50/501, 0/0 -> missing; utilisation clipped to [0, 1]
    assert r["CC_PAYMENT_RATE_MEAN"] == pytest.approx(50 / 501)
    assert 0.0 <= r["CC_UTILIZATION_MAX"] <= 1.0
    assert r["CC_UNIQUE_CARDS"] == 2 and r["CC_SEVERE_DPD_MONTHS"] == 1


def test_approximate_distinct_option(installments):
    exact = {r["SK_ID_CURR"]: r["INSTAL_NUM_UNIQUE_LOANS"] for r in P.INSTALLMENTS.run(installments).collect()}
    approx = {r["SK_ID_CURR"]: r["INSTAL_NUM_UNIQUE_LOANS"]
              for r in P.INSTALLMENTS.run(installments, approx_distinct=True).collect()}
    assert exact == approx  # tiny counts are exact under HLL++


def test_nan_input_behaves_like_missing(spark, scratch):
    """NaN is the reference's missing marker: after the source conversion it is skipped by
    aggregates and compares false in flags (Spark would otherwise order NaN above every number)."""
    from riskmart.sources import tables as TB

    nan = float("nan")
    rows = [(1, 7, 1.0, -30.0, nan, 100.0, nan), (1, 8, 1.0, -10.0, -5.0, 100.0, 90.0)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_VERSION double, "
                                     "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, "
                                     "AMT_PAYMENT double")
    df.write.parquet(f"{scratch}/installments.parquet")
    r = P.installment_features(TB.load_table(spark, scratch, "installments")).first()
    assert r["INSTAL_LATE_COUNT"] == 1 and r["INSTAL_LATE_RATIO"] == pytest.approx(0.5)
    assert r["INSTAL_DPD_MAX"] == 5.0 and r["INSTAL_AMT_PAYMENT_MEAN"] == pytest.approx(90.0)
    assert r["INSTAL_UNDERPAYMENT_COUNT"] == 1
