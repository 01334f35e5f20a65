"""Null-safe Column helpers used by every feature pack.

Every helper returns a ``Column`` built from built-in functions only, so the expressions stay
inside whole-stage codegen. Missing values follow the reference semantics:

* a comparison with a missing value is false, so a flag is 0 (never NULL);
* arithmetic with a missing value stays missing;
* division follows IEEE rules (x/0 = +-inf, 0/0 = missing) instead of raising under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

POS_INF = float("inf")
NEG_INF = float("-inf")


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# ---------------------------------------------------------------------------
# Division (P-1)
# ---------------------------------------------------------------------------

def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """IEEE division: den != 0 -> num/den; num > 0 -> +inf; num < 0 -> -inf; otherwise NULL."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return (
        F.when(d != 0, F.try_divide(n, d))
        .when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
        .when(n > 0, F.lit(POS_INF))
        .when(n < 0, F.lit(NEG_INF))
        .otherwise(F.lit(None).cast("double"))
    )


def plus_one_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / (den + 1)`` - the guarded ratio every pack uses."""
    return safe_div(num, _col(den).cast("double") + F.lit(1.0))


# ---------------------------------------------------------------------------
# Flags (P-2, P-3, P-4)
# ---------------------------------------------------------------------------

def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, 0 when false or unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def flag_eq(c: ColumnOrName, value) -> Column:
    return flag(_col(c) == _lit(value))


def flag_gt(c: ColumnOrName, value) -> Column:
    return flag(_col(c) > _lit(value))


def flag_ge(c: ColumnOrName, value) -> Column:
    return flag(_col(c) >= _lit(value))


def flag_in(c: ColumnOrName, values: Iterable) -> Column:
    return flag(_col(c).isin(list(values)))


# ---------------------------------------------------------------------------
# Value rewriting (P-5, P-6, P-7)
# ---------------------------------------------------------------------------

def sentinel_null(c: ColumnOrName, sentinel) -> Column:
    """Replace a sentinel code by NULL."""
    return F.nullif(_col(c), _lit(sentinel))


def code_map(c: ColumnOrName, mapping: dict, default=None) -> Column:
    """Look a code up in a small fixed map; unknown codes give ``default`` (NULL)."""
    col = _col(c)
    items = list(mapping.items())
    out = F.when(col == _lit(items[0][0]), _lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(col == _lit(k), _lit(v))
    return out.otherwise(_lit(default) if default is not None else F.lit(None))


def clip(c: ColumnOrName, lower=None, upper=None) -> Column:
    """Clip to [lower, upper]; NULL stays NULL (unlike greatest/least, which skip NULLs)."""
    col = _col(c)
    out = None
    if lower is not None:
        out = F.when(col < _lit(lower), _lit(lower))
    if upper is not None:
        out = (out.when(col > _lit(upper), _lit(upper)) if out is not None
               else F.when(col > _lit(upper), _lit(upper)))
    return col if out is None else out.otherwise(col)


# ---------------------------------------------------------------------------
# Row-wise statistics over a column list (P-8, P-9)
# ---------------------------------------------------------------------------

def _present(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    cs = [_col(c).cast("double") for c in cols]
    n = _present(cs)
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(n > 0, total / n)


def row_min(cols: Sequence[ColumnOrName]) -> Column:
    cs = [_col(c).cast("double") for c in cols]
    return cs[0] if len(cs) == 1 else F.least(*cs)


def row_max(cols: Sequence[ColumnOrName]) -> Column:
    cs = [_col(c).cast("double") for c in cols]
    return cs[0] if len(cs) == 1 else F.greatest(*cs)


def row_std(cols: Sequence[ColumnOrName]) -> Column:
    """Sample (ddof=1) standard deviation over the present values; NULL below two values."""
    cs = [_col(c).cast("double") for c in cols]
    n = _present(cs)
    mean = row_mean(cs)
    ss = reduce(lambda a, b: a + b,
                [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cs])
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """Sum skipping NULLs; no columns or all missing -> 0."""
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0)) for c in cols])


# ---------------------------------------------------------------------------
# Aggregates that follow the reference's empty-group rules (G-3, G-7)
# ---------------------------------------------------------------------------

def sum0(c: ColumnOrName) -> Column:
    """Sum where a group with no values sums to 0."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


# ---------------------------------------------------------------------------
# Column-name selection helpers (P-10, P-14)
# ---------------------------------------------------------------------------

def prefixed(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    return [c for c in columns if any(c.startswith(p) for p in prefixes)]


# ---------------------------------------------------------------------------
# Decision bands (P-17, Q-3, Q-4)
# ---------------------------------------------------------------------------

# Fixed values (must equal the reference): half-open probability bands [lo, hi), label, text.
RISK_BANDS = [
    (0.00, 0.10, "Very Low", "Applicant shows very strong repayment indicators."),
    (0.10, 0.25, "Low", "Applicant shows good repayment indicators."),
    (0.25, 0.45, "Medium", "Moderate risk. Manual review recommended."),
    (0.45, 0.65, "High", "Elevated risk. Senior review required."),
    (0.65, 1.01, "Very High", "Very high default risk."),
]

# Fixed values (must equal the reference): recommendation per band, same cut points.
RECOMMENDATIONS = [
    (0.10, "Approve"),
    (0.25, "Approve with standard review"),
    (0.45, "Manual review required"),
    (0.65, "Senior review required"),
    (None, "Decline recommended"),
]


def band_of(p: ColumnOrName, field: int = 2) -> Column:
    """Band label (field=2) or description (field=3) of a probability; outside all bands -> Very High,
    NULL (a request that was not scored) -> NULL."""
    col = _col(p)
    out = F.when(col.isNull(), F.lit(None))
    for lo, hi, *rest in RISK_BANDS:
        value = F.lit((lo, hi, *rest)[field])
        cond = (col >= lo) & (col < hi)
        out = out.when(cond, value)
    fallback = "Very High" if field == 2 else ("Very high default risk." if field == 3 else None)
    return out.otherwise(F.lit(fallback))


def recommendation_of(p: ColumnOrName, field: int = 1) -> Column:
    col = _col(p)
    out = F.when(col.isNull(), F.lit(None))
    for cut, *rest in RECOMMENDATIONS:
        value = F.lit((cut, *rest)[field])
        if cut is None:
            return out.otherwise(value)
        out = out.when(col < cut, value)
    return out
