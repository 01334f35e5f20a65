"""Plan-shape guards: the scale properties stay visible in the physical plans."""

import re

from riskmart.operators import metrics as MT
from riskmart.operators import packs as P
from riskmart.sources import adapters as A

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    """Final (post-AQE) physical plan text of an executed DataFrame."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_pack_is_one_partial_final_aggregate(spark):
    out = P.previous_features(A.adapter(spark, SF, "previous"))
    out.collect()
    plan = _plan(out)
    assert plan.count("Exchange hashpartitioning(SK_ID_CURR") == 1
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert "partial_" in plan  # map-side pre-aggregation before the shuffle


def test_scan_reads_only_needed_columns(spark):
    out = P.previous_features(A.adapter(spark, SF, "previous"))
    out.collect()
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", _plan(out))
    cols = {c.split(":")[0] for c in schema[0].split(",")}
    assert cols == {"o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"}


def test_running_total_windows_are_partitioned_by_bucket(spark):
    curve = MT.score_curve(A.adapter(spark, SF, "scored_events"))
    curve.collect()
    plan = _plan(curve)
    main = plan.split("InMemoryRelation")[0]  # the cached bounded offsets table is built separately
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", main)
    assert windows and all("_bkt" in w for w in windows)


def test_master_has_no_cross_join_or_cartesian(spark):
    from riskmart.plans import master as M

    plan = _plan(M.build_master(A.loan_tables(spark, SF)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
