"""Output normalisation shared by the query catalogue and its SQL oracles.

Only the query/oracle layer uses this (never the engine): integral results are widened to BIGINT
and fractional results are rounded as ``round(x + 1.37e-6, 4)``. Summation order differs between
engines, and the small offset keeps values away from decimal rounding ties so both engines round
to the same decimal.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OFFSET = "1.37e-6"
DIGITS = 4


def tidy(df: DataFrame) -> DataFrame:
    """Same rules as :func:`norm_sql`, as one ``selectExpr`` (one call for the whole projection)."""
    exprs = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            exprs.append(f"CAST({c} AS BIGINT) AS {c}")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            exprs.append(f"ROUND(CAST({c} AS DOUBLE) + {OFFSET}, {DIGITS}) AS {c}")
        else:
            exprs.append(c)
    return df.selectExpr(*exprs)


def norm_sql(inner: str, ints: Iterable[str] = (), strs: Iterable[str] = (), dbls: Iterable[str] = (),
             prefix: str = "") -> str:
    """Wrap ``inner`` in the same normalisation as :func:`tidy` for the listed columns."""
    sel = []
    for c in ints:
        sel.append(f'CAST("{c}" AS BIGINT) AS "{c}"')
    for c in strs:
        sel.append(f'"{c}"')
    for c in dbls:
        sel.append(f'ROUND(CAST("{c}" AS DOUBLE) + {OFFSET}, {DIGITS}) AS "{c}"')
    return f"{prefix}SELECT {', '.join(sel)} FROM (\n{inner}\n) AS q"
