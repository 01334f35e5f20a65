"""Feature packs: one row per applicant from each history table.

Each pack is declared as data - a key, derived per-row inputs, a list of ``(output, aggregate,
input)`` triples and post-aggregation ratios - and run by one generic runner:

    select(key, derived...) -> filter(key is not null) -> groupBy(key).agg(...) -> select(post...)

That is a single hash aggregation per pack: Spark plans a partial (map-side) aggregate before the
shuffle on the key and a final one after it, so a hot applicant holding a large share of the rows
is pre-combined inside every map task and never lands whole in one task. Only the columns a pack
names reach the parquet scan (column pruning), and the per-row derivations fuse into the scan's
codegen stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions import expr as X

KEY = "SK_ID_CURR"


# ---------------------------------------------------------------------------
# Declarative pack machinery
# ---------------------------------------------------------------------------

def _agg_column(fn: str, src: str, approx_distinct: bool = False) -> Column:
    c = F.col(src)
    if fn == "count":
        return F.count(c)
    if fn == "sum":
        return X.sum0(c)
    if fn == "mean":
        return F.avg(c)
    if fn == "max":
        return F.max(c)
    if fn == "min":
        return F.min(c)
    if fn == "std":
        return F.stddev_samp(c)
    if fn == "nunique":
        # exact by default; HyperLogLog++ (bounded state, no extra shuffle stage) on request
        return F.approx_count_distinct(c, 0.01) if approx_distinct else F.countDistinct(c)
    raise ValueError(f"unknown aggregate {fn!r}")


@dataclass(frozen=True)
class Pack:
    """A declarative aggregation pack."""

    name: str
    key: str
    derived: Callable[[Sequence[str]], dict[str, Column]]   # columns -> {name: per-row expression}
    aggs: Sequence[tuple[str, str, str]]                     # (output, aggregate, input)
    post: Callable[[], dict[str, Column]] = field(default=lambda: {})  # output overrides/additions

    def inputs(self, columns: Sequence[str]) -> list[str]:
        derived = self.derived(columns)
        needed = {src for _, _, src in self.aggs}
        return [c for c in columns if c in needed and c not in derived]

    def run(self, df: DataFrame, approx_distinct: bool = False) -> DataFrame:
        derived = self.derived(df.columns)
        base = [F.col(self.key)] + [F.col(c) for c in self.inputs(df.columns)]
        prepared = df.select(*base, *[e.alias(n) for n, e in derived.items()])
        grouped = (prepared.where(F.col(self.key).isNotNull())
                   .groupBy(self.key)
                   .agg(*[_agg_column(fn, src, approx_distinct).alias(out) for out, fn, src in self.aggs]))
        post = self.post()
        if not post:
            return grouped
        names = [out for out, _, _ in self.aggs]
        cols = [F.col(self.key)]
        cols += [post[n].alias(n) if n in post else F.col(n) for n in names]
        cols += [e.alias(n) for n, e in post.items() if n not in names]
        return grouped.select(*cols)

    @property
    def output_columns(self) -> list[str]:
        names = [out for out, _, _ in self.aggs]
        return names + [n for n in self.post() if n not in names]


# ---------------------------------------------------------------------------
# bureau_balance -> per credit (two-level aggregation, first level)
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference): bureau_balance STATUS code -> severity number.
STATUS_CODES = {"C": 0, "X": -1, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5}
DPD_CODES = ["1", "2", "3", "4", "5"]
SEVERE_DPD_CODES = ["3", "4", "5"]

BUREAU_BALANCE = Pack(
    name="bureau_balance",
    key="SK_ID_BUREAU",
    derived=lambda cols: {
        "STATUS_NUMERIC": X.code_map("STATUS", STATUS_CODES),
        "IS_DPD": X.flag_in("STATUS", DPD_CODES),
        "IS_SEVERE_DPD": X.flag_in("STATUS", SEVERE_DPD_CODES),
    },
    aggs=[
        ("BB_MONTHS_COUNT", "count", "MONTHS_BALANCE"),
        ("BB_STATUS_MAX", "max", "STATUS_NUMERIC"),
        ("BB_STATUS_MEAN", "mean", "STATUS_NUMERIC"),
        ("BB_DPD_MONTHS", "sum", "IS_DPD"),
        ("BB_SEVERE_DPD_MONTHS", "sum", "IS_SEVERE_DPD"),
        ("BB_DPD_RATIO", "mean", "IS_DPD"),
    ],
)


def bureau_balance_features(bureau_balance: DataFrame) -> DataFrame:
    """Per-credit monthly-status metrics (keyed by SK_ID_BUREAU)."""
    return BUREAU_BALANCE.run(bureau_balance)


def bureau_with_balance(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """J-1: bureau LEFT JOIN per-credit balance metrics on SK_ID_BUREAU (1 : 0..1)."""
    return bureau.join(bureau_balance_features(bureau_balance), "SK_ID_BUREAU", "left")


# ---------------------------------------------------------------------------
# bureau -> per applicant
# ---------------------------------------------------------------------------

BUREAU = Pack(
    name="bureau",
    key=KEY,
    derived=lambda cols: {
        "IS_ACTIVE": X.flag_eq("CREDIT_ACTIVE", "Active"),
        "IS_CLOSED": X.flag_eq("CREDIT_ACTIVE", "Closed"),
        "IS_BAD_DEBT": X.flag_eq("CREDIT_ACTIVE", "Bad debt"),
        "IS_SOLD": X.flag_eq("CREDIT_ACTIVE", "Sold"),
    },
    aggs=[
        ("BUREAU_LOAN_COUNT", "count", "SK_ID_BUREAU"),
        ("BUREAU_ACTIVE_COUNT", "sum", "IS_ACTIVE"),
        ("BUREAU_CLOSED_COUNT", "sum", "IS_CLOSED"),
        ("BUREAU_BAD_DEBT_COUNT", "sum", "IS_BAD_DEBT"),
        ("BUREAU_SOLD_COUNT", "sum", "IS_SOLD"),
        ("BUREAU_ACTIVE_RATIO", "mean", "IS_ACTIVE"),
        ("BUREAU_CREDIT_SUM", "sum", "AMT_CREDIT_SUM"),
        ("BUREAU_CREDIT_MEAN", "mean", "AMT_CREDIT_SUM"),
        ("BUREAU_CREDIT_MAX", "max", "AMT_CREDIT_SUM"),
        ("BUREAU_DEBT_SUM", "sum", "AMT_CREDIT_SUM_DEBT"),
        ("BUREAU_DEBT_MEAN", "mean", "AMT_CREDIT_SUM_DEBT"),
        ("BUREAU_OVERDUE_SUM", "sum", "AMT_CREDIT_SUM_OVERDUE"),
        ("BUREAU_OVERDUE_MAX", "max", "AMT_CREDIT_SUM_OVERDUE"),
        ("BUREAU_LIMIT_SUM", "sum", "AMT_CREDIT_SUM_LIMIT"),
        ("BUREAU_MAX_OVERDUE_EVER", "max", "AMT_CREDIT_MAX_OVERDUE"),
        ("BUREAU_DPD_MAX", "max", "CREDIT_DAY_OVERDUE"),
        ("BUREAU_DPD_MEAN", "mean", "CREDIT_DAY_OVERDUE"),
        ("BUREAU_DAYS_CREDIT_MEAN", "mean", "DAYS_CREDIT"),
        ("BUREAU_DAYS_CREDIT_MIN", "min", "DAYS_CREDIT"),
        ("BUREAU_ENDDATE_MEAN", "mean", "DAYS_CREDIT_ENDDATE"),
        ("BUREAU_ENDDATE_MAX", "max", "DAYS_CREDIT_ENDDATE"),
        ("BUREAU_CNT_PROLONG_SUM", "sum", "CNT_CREDIT_PROLONG"),
        ("BUREAU_BB_DPD_MONTHS_SUM", "sum", "BB_DPD_MONTHS"),
        ("BUREAU_BB_DPD_RATIO_MEAN", "mean", "BB_DPD_RATIO"),
        ("BUREAU_BB_STATUS_MAX", "max", "BB_STATUS_MAX"),
        ("BUREAU_BB_SEVERE_DPD_SUM", "sum", "BB_SEVERE_DPD_MONTHS"),
        ("BUREAU_BB_MONTHS_MEAN", "mean", "BB_MONTHS_COUNT"),
    ],
    post=lambda: {
        "BUREAU_DEBT_CREDIT_RATIO": X.plus_one_ratio("BUREAU_DEBT_SUM", "BUREAU_CREDIT_SUM"),
        "BUREAU_OVERDUE_DEBT_RATIO": X.plus_one_ratio("BUREAU_OVERDUE_SUM", "BUREAU_DEBT_SUM"),
    },
)


def bureau_features(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """Two-level aggregation: monthly status -> credit -> applicant."""
    return BUREAU.run(bureau_with_balance(bureau, bureau_balance))


# ---------------------------------------------------------------------------
# previous applications
# ---------------------------------------------------------------------------

PREVIOUS = Pack(
    name="previous",
    key=KEY,
    derived=lambda cols: {
        "IS_APPROVED": X.flag_eq("NAME_CONTRACT_STATUS", "Approved"),
        "IS_REFUSED": X.flag_eq("NAME_CONTRACT_STATUS", "Refused"),
        "IS_CANCELLED": X.flag_eq("NAME_CONTRACT_STATUS", "Canceled"),
        "IS_UNUSED": X.flag_eq("NAME_CONTRACT_STATUS", "Unused offer"),
        "IS_CONSUMER_LOAN": X.flag_eq("NAME_CONTRACT_TYPE", "Consumer loans"),
        "IS_CASH_LOAN": X.flag_eq("NAME_CONTRACT_TYPE", "Cash loans"),
        "IS_REVOLVING": X.flag_eq("NAME_CONTRACT_TYPE", "Revolving loans"),
        "WAS_RECENT_APP": X.flag_ge("DAYS_DECISION", -365),
    },
    aggs=[
        ("PREV_APP_COUNT", "count", "SK_ID_PREV"),
        ("PREV_APPROVED_COUNT", "sum", "IS_APPROVED"),
        ("PREV_REFUSED_COUNT", "sum", "IS_REFUSED"),
        ("PREV_CANCELLED_COUNT", "sum", "IS_CANCELLED"),
        ("PREV_UNUSED_COUNT", "sum", "IS_UNUSED"),
        ("PREV_APPROVED_RATIO", "mean", "IS_APPROVED"),
        ("PREV_REFUSED_RATIO", "mean", "IS_REFUSED"),
        ("PREV_RECENT_APP_COUNT", "sum", "WAS_RECENT_APP"),
        ("PREV_CONSUMER_LOAN_COUNT", "sum", "IS_CONSUMER_LOAN"),
        ("PREV_CASH_LOAN_COUNT", "sum", "IS_CASH_LOAN"),
        ("PREV_REVOLVING_COUNT", "sum", "IS_REVOLVING"),
        ("PREV_AMT_CREDIT_MEAN", "mean", "AMT_CREDIT"),
        ("PREV_AMT_CREDIT_MAX", "max", "AMT_CREDIT"),
        ("PREV_AMT_CREDIT_SUM", "sum", "AMT_CREDIT"),
        ("PREV_AMT_ANNUITY_MEAN", "mean", "AMT_ANNUITY"),
        ("PREV_AMT_APPLICATION_MEAN", "mean", "AMT_APPLICATION"),
        ("PREV_RATE_DOWN_PAYMENT_MEAN", "mean", "RATE_DOWN_PAYMENT"),
        ("PREV_RATE_DOWN_PAYMENT_MAX", "max", "RATE_DOWN_PAYMENT"),
        ("PREV_CNT_PAYMENT_MEAN", "mean", "CNT_PAYMENT"),
        ("PREV_CNT_PAYMENT_MAX", "max", "CNT_PAYMENT"),
        ("PREV_DAYS_DECISION_MEAN", "mean", "DAYS_DECISION"),
        ("PREV_DAYS_DECISION_MAX", "max", "DAYS_DECISION"),
    ],
    post=lambda: {
        "PREV_CREDIT_RATIO": X.plus_one_ratio("PREV_AMT_CREDIT_MEAN", "PREV_AMT_APPLICATION_MEAN"),
    },
)


def previous_features(previous: DataFrame) -> DataFrame:
    return PREVIOUS.run(previous)


# ---------------------------------------------------------------------------
# installment payments
# ---------------------------------------------------------------------------

INSTALLMENTS = Pack(
    name="installments",
    key=KEY,
    derived=lambda cols: {
        "PAYMENT_DPD": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
        "IS_LATE": X.flag_gt(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"), 0),
        "PAYMENT_DEFICIT": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
        "IS_UNDERPAYMENT": X.flag_gt(F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"), 0),
        "PAYMENT_PERC": X.plus_one_ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
    },
    aggs=[
        ("INSTAL_COUNT", "count", "SK_ID_PREV"),
        ("INSTAL_DPD_MAX", "max", "PAYMENT_DPD"),
        ("INSTAL_DPD_MEAN", "mean", "PAYMENT_DPD"),
        ("INSTAL_DPD_STD", "std", "PAYMENT_DPD"),
        ("INSTAL_LATE_COUNT", "sum", "IS_LATE"),
        ("INSTAL_LATE_RATIO", "mean", "IS_LATE"),
        ("INSTAL_AMT_PAYMENT_MEAN", "mean", "AMT_PAYMENT"),
        ("INSTAL_AMT_PAYMENT_SUM", "sum", "AMT_PAYMENT"),
        ("INSTAL_DEFICIT_MEAN", "mean", "PAYMENT_DEFICIT"),
        ("INSTAL_DEFICIT_SUM", "sum", "PAYMENT_DEFICIT"),
        ("INSTAL_DEFICIT_MAX", "max", "PAYMENT_DEFICIT"),
        ("INSTAL_UNDERPAYMENT_COUNT", "sum", "IS_UNDERPAYMENT"),
        ("INSTAL_UNDERPAYMENT_RATIO", "mean", "IS_UNDERPAYMENT"),
        ("INSTAL_PAYMENT_PERC_MEAN", "mean", "PAYMENT_PERC"),
        ("INSTAL_PAYMENT_PERC_MIN", "min", "PAYMENT_PERC"),
        ("INSTAL_VERSION_MAX", "max", "NUM_INSTALMENT_VERSION"),
        ("INSTAL_NUM_UNIQUE_LOANS", "nunique", "SK_ID_PREV"),
    ],
    post=lambda: {
        # DPD above a year is treated as a recording error: cap the maximum at 365.
        "INSTAL_DPD_MAX": X.clip("INSTAL_DPD_MAX", upper=365),
        "INSTAL_DEFICIT_MEAN": F.coalesce(F.col("INSTAL_DEFICIT_MEAN"), F.lit(0.0)),
    },
)


def installment_features(installments: DataFrame) -> DataFrame:
    return INSTALLMENTS.run(installments)


# ---------------------------------------------------------------------------
# POS / cash loan balances
# ---------------------------------------------------------------------------

POS_CASH = Pack(
    name="pos_cash",
    key=KEY,
    derived=lambda cols: {
        "IS_ACTIVE": X.flag_eq("NAME_CONTRACT_STATUS", "Active"),
        "IS_COMPLETED": X.flag_eq("NAME_CONTRACT_STATUS", "Completed"),
        "HAS_DPD": X.flag_gt("SK_DPD", 0),
        "HAS_SEVERE_DPD": X.flag_gt("SK_DPD", 30),
    },
    aggs=[
        ("POS_COUNT", "count", "SK_ID_PREV"),
        ("POS_UNIQUE_LOANS", "nunique", "SK_ID_PREV"),
        ("POS_DPD_MAX", "max", "SK_DPD"),
        ("POS_DPD_MEAN", "mean", "SK_DPD"),
        ("POS_DPD_DEF_MAX", "max", "SK_DPD_DEF"),
        ("POS_DPD_DEF_MEAN", "mean", "SK_DPD_DEF"),
        ("POS_DPD_MONTHS", "sum", "HAS_DPD"),
        ("POS_SEVERE_DPD_MONTHS", "sum", "HAS_SEVERE_DPD"),
        ("POS_DPD_RATIO", "mean", "HAS_DPD"),
        ("POS_ACTIVE_COUNT", "sum", "IS_ACTIVE"),
        ("POS_COMPLETED_COUNT", "sum", "IS_COMPLETED"),
        ("POS_COMPLETED_RATIO", "mean", "IS_COMPLETED"),
        ("POS_MONTHS_BALANCE_MAX", "max", "MONTHS_BALANCE"),
        ("POS_MONTHS_BALANCE_MEAN", "mean", "MONTHS_BALANCE"),
        ("POS_CNT_INSTALMENT_FUTURE_MEAN", "mean", "CNT_INSTALMENT_FUTURE"),
    ],
)


def pos_cash_features(pos_cash: DataFrame) -> DataFrame:
    return POS_CASH.run(pos_cash)


# ---------------------------------------------------------------------------
# credit card balances
# ---------------------------------------------------------------------------

CREDIT_CARD = Pack(
    name="credit_card",
    key=KEY,
    derived=lambda cols: {
        "UTILIZATION": X.clip(X.plus_one_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"), 0.0, 1.0),
        "PAYS_ABOVE_MINIMUM": X.flag(F.col("AMT_PAYMENT_TOTAL_CURRENT") > F.col("AMT_INST_MIN_REGULARITY")),
        "PAYMENT_RATE": X.clip(X.plus_one_ratio("AMT_PAYMENT_TOTAL_CURRENT", "AMT_BALANCE"), 0.0, 2.0),
        "HAS_DPD": X.flag_gt("SK_DPD", 0),
        "HAS_SEVERE_DPD": X.flag_gt("SK_DPD", 30),
    },
    aggs=[
        ("CC_COUNT", "count", "SK_ID_PREV"),
        ("CC_UNIQUE_CARDS", "nunique", "SK_ID_PREV"),
        ("CC_UTILIZATION_MEAN", "mean", "UTILIZATION"),
        ("CC_UTILIZATION_MAX", "max", "UTILIZATION"),
        ("CC_UTILIZATION_STD", "std", "UTILIZATION"),
        ("CC_AMT_BALANCE_MEAN", "mean", "AMT_BALANCE"),
        ("CC_AMT_BALANCE_MAX", "max", "AMT_BALANCE"),
        ("CC_CREDIT_LIMIT_MEAN", "mean", "AMT_CREDIT_LIMIT_ACTUAL"),
        ("CC_PAYMENT_RATE_MEAN", "mean", "PAYMENT_RATE"),
        ("CC_PAYMENT_RATE_MIN", "min", "PAYMENT_RATE"),
        ("CC_PAYS_ABOVE_MIN_RATIO", "mean", "PAYS_ABOVE_MINIMUM"),
        ("CC_AMT_PAYMENT_MEAN", "mean", "AMT_PAYMENT_TOTAL_CURRENT"),
        ("CC_DRAWINGS_ATM_MEAN", "mean", "AMT_DRAWINGS_ATM_CURRENT"),
        ("CC_DRAWINGS_TOTAL_MEAN", "mean", "AMT_DRAWINGS_CURRENT"),
        ("CC_CNT_DRAWINGS_ATM", "mean", "CNT_DRAWINGS_ATM_CURRENT"),
        ("CC_DPD_MAX", "max", "SK_DPD"),
        ("CC_DPD_MEAN", "mean", "SK_DPD"),
        ("CC_DPD_DEF_MAX", "max", "SK_DPD_DEF"),
        ("CC_DPD_MONTHS", "sum", "HAS_DPD"),
        ("CC_SEVERE_DPD_MONTHS", "sum", "HAS_SEVERE_DPD"),
        ("CC_DPD_RATIO", "mean", "HAS_DPD"),
    ],
    post=lambda: {
        "CC_ATM_DRAW_RATIO": X.plus_one_ratio("CC_DRAWINGS_ATM_MEAN", "CC_DRAWINGS_TOTAL_MEAN"),
    },
)


def credit_card_features(credit_card: DataFrame) -> DataFrame:
    return CREDIT_CARD.run(credit_card)


# ---------------------------------------------------------------------------
# application (row-wise, no aggregation)
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference).
EMPLOYMENT_SENTINEL = 365243
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CONTACT_FLAGS = ["FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL"]
DOCUMENT_FLAG_PREFIX = "FLAG_DOCUMENT_"


def application_features(app: DataFrame) -> DataFrame:
    """Ratios, ages, employment, external-score statistics and flag counts, in one projection.

    The schema is semi-dynamic: optional columns are looked up in ``df.columns`` when the plan is
    built, exactly like the reference's presence checks. Input columns are carried through.
    """
    cols = app.columns
    days_employed = X.sentinel_null("DAYS_EMPLOYED", EMPLOYMENT_SENTINEL)
    age = -F.col("DAYS_BIRTH") / F.lit(365.0)
    employed_years = -days_employed / F.lit(365.0)
    credit_income = X.plus_one_ratio("AMT_CREDIT", "AMT_INCOME_TOTAL")
    annuity_income = X.plus_one_ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL")

    overrides = {"DAYS_EMPLOYED": days_employed}
    if "FLAG_OWN_CAR" in cols:
        overrides["FLAG_OWN_CAR"] = X.flag_eq("FLAG_OWN_CAR", "Y")
    if "FLAG_OWN_REALTY" in cols:
        overrides["FLAG_OWN_REALTY"] = X.flag_eq("FLAG_OWN_REALTY", "Y")

    new: dict[str, Column] = {
        "CREDIT_INCOME_RATIO": credit_income,
        "ANNUITY_INCOME_RATIO": annuity_income,
        "CREDIT_TERM_MONTHS": X.plus_one_ratio("AMT_CREDIT", "AMT_ANNUITY"),
        "GOODS_CREDIT_RATIO": X.plus_one_ratio("AMT_GOODS_PRICE", "AMT_CREDIT"),
        "AGE_YEARS": age,
        "IS_UNEMPLOYED": X.flag_eq("DAYS_EMPLOYED", EMPLOYMENT_SENTINEL),
        "EMPLOYED_YEARS": employed_years,
        "EMPLOYMENT_AGE_RATIO": X.plus_one_ratio(employed_years, age),
        "REGISTRATION_YEARS": (-F.col("DAYS_REGISTRATION") / F.lit(365.0)) if "DAYS_REGISTRATION" in cols else F.lit(0.0),
        "ID_PUBLISH_YEARS": (-F.col("DAYS_ID_PUBLISH") / F.lit(365.0)) if "DAYS_ID_PUBLISH" in cols else F.lit(0.0),
    }
    ext = [c for c in EXT_SOURCES if c in cols]
    if ext:
        new["EXT_SOURCE_MEAN"] = X.row_mean(ext)
        new["EXT_SOURCE_MIN"] = X.row_min(ext)
        new["EXT_SOURCE_STD"] = F.coalesce(X.row_std(ext), F.lit(0.0))
    if "EXT_SOURCE_2" in cols and "EXT_SOURCE_3" in cols:
        new["EXT_SOURCE_PRODUCT"] = F.col("EXT_SOURCE_2") * F.col("EXT_SOURCE_3")
    if "EXT_SOURCE_2" in cols:
        new["CREDIT_INCOME_x_EXT2"] = credit_income * F.col("EXT_SOURCE_2")
        new["ANNUITY_INCOME_x_EXT2"] = annuity_income * F.col("EXT_SOURCE_2")
    docs = [c for c in cols if c.startswith(DOCUMENT_FLAG_PREFIX)]
    if docs:
        new["DOCS_PROVIDED_COUNT"] = X.row_sum(docs)
    contacts = [c for c in CONTACT_FLAGS if c in cols]
    if contacts:
        new["CONTACT_CHANNELS_COUNT"] = X.row_sum(contacts)

    select = [overrides[c].alias(c) if c in overrides else F.col(c) for c in cols]
    select += [e.alias(n) for n, e in new.items() if n not in cols]
    return app.select(*select)


PACKS = {p.name: p for p in (BUREAU_BALANCE, BUREAU, PREVIOUS, INSTALLMENTS, POS_CASH, CREDIT_CARD)}
FEATURE_PREFIXES = ("BUREAU_", "PREV_", "INSTAL_", "POS_", "CC_")
