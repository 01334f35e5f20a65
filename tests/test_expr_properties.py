"""Property tests: the Column helpers agree with pandas/numpy semantics on random inputs with NULLs."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskmart.functions import expr as X

vals = st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
                 st.sampled_from([0.0, -1.0, 1.0]))
rows = st.lists(st.tuples(vals, vals, vals), min_size=1, max_size=25)


def _same(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None:
        return False
    if math.isinf(a) or math.isinf(b):
        return a == b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_helpers_match_pandas(spark, data):
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = df.select(X.plus_one_ratio("a", "b").alias("r"), X.clip("a", -10.0, 10.0).alias("k"),
                    X.row_mean(["a", "b", "c"]).alias("m"), X.row_std(["a", "b", "c"]).alias("s"),
                    X.row_min(["a", "b", "c"]).alias("lo"), X.flag_gt("a", 0).alias("f"),
                    X.row_sum(["a", "b", "c"]).alias("t")).collect()
    pdf = pd.DataFrame(data, columns=["a", "b", "c"], dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = pdf["a"] / (pdf["b"] + 1)
    exp = pd.DataFrame({"r": ratio, "k": pdf["a"].clip(-10, 10), "m": pdf.mean(axis=1), "s": pdf.std(axis=1),
                        "lo": pdf.min(axis=1), "f": (pdf["a"] > 0).astype(int), "t": pdf.sum(axis=1)})
    for g, (_, e) in zip(got, exp.iterrows()):
        for c in exp.columns:
            assert _same(g[c], None if pd.isna(e[c]) else float(e[c])), (c, g, e)
