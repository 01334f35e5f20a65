"""The scoring service: duplicates over batches and restarts, replayed batches, the sink of rejected requests, top factors."""

import os

import pytest

from riskmart.operators import scoring as SC
from riskmart.streaming import scoring_stream as ST

COEFFICIENTS = {"EXT_SOURCE_MEAN": -2.0, "CREDIT_INCOME_RATIO": 0.3, "AGE_YEARS": -0.01, "NOT_THERE_MEAN": 0.0}


def request(i, income=50_000.0):
    return (i, income, 100_000.0 + (i or 0), 5_000.0, 0.4, 0.6, 40, 3.0, "F", "Working", "Higher education", "Married", "House / apartment")


def drop_file(spark, folder, rows, stamp):
    """One file of requests with a modification time of its own."""
    name = f"{folder}/{stamp}"
    spark.createDataFrame(rows, ST.REQUEST_SCHEMA).coalesce(1).write.parquet(name)
    os.makedirs(f"{folder}/in", exist_ok=True)
    part = next(f for f in os.listdir(name) if f.endswith(".parquet"))
    os.link(f"{name}/{part}", f"{folder}/in/{stamp}.parquet")
    os.utime(f"{folder}/in/{stamp}.parquet", (1_700_000_000 + stamp, 1_700_000_000 + stamp))


def run(spark, scratch, transform, out="out", **kw):
    q = ST.start_scoring_service(spark, f"{scratch}/in", f"{scratch}/{out}", f"{scratch}/{out}-rejected", transform, delay="10 minutes", **kw)
    q.awaitTermination()


def transform():
    present = {k: v for k, v in COEFFICIENTS.items() if k != "NOT_THERE_MEAN"}
    return ST.linear_transform(present, 0.1, {"EXT_SOURCE_MEAN": 0.5, "AGE_YEARS": 45.0}, k=2)


def test_duplicates_and_rejects(spark, scratch):
    drop_file(spark, scratch, [request(1), request(2), request(1), request(None), request(None), request(3, 5.0)], 0)
    run(spark, scratch, transform())
    drop_file(spark, scratch, [request(2, 90_000.0), request(4), request(3, 5.0)], 60)              # within the delay
    run(spark, scratch, transform())
    run(spark, scratch, transform())                                                                 # nothing new
    out, lost = (ST.read_sink(spark, f"{scratch}/{d}") for d in ("out", "out-rejected"))
    rows = {r.id: r for r in out.collect()}
    assert out.count() == 3 and set(rows) == {1, 2, 4} and rows[2].probability == rows[2].probability
    assert sorted(((r.id, r.reasons) for r in lost.collect()), key=str) == [(3, "amt_income_total: out of range"), (None, "id: missing")]
    drop_file(spark, scratch, [request(5)], 4000)
    run(spark, scratch, transform())
    drop_file(spark, scratch, [request(1, 70_000.0)], 4060)                                          # long after the first
    run(spark, scratch, transform())
    assert ST.read_sink(spark, f"{scratch}/out").where("id = 1").count() == 2


def test_a_replayed_batch_replaces_its_output(spark, scratch):
    drop_file(spark, scratch, [request(i) for i in range(5)] + [request(9, 1.0)], 0)
    fails = [True]
    plain = transform()

    def once_broken(df):
        if fails and fails.pop():
            plain(df).where("is_valid = 1").drop("is_valid", "reasons").write.mode("overwrite").parquet(f"{scratch}/out/batch=0")
            raise RuntimeError("lost in the middle of a batch")
        return plain(df)

    with pytest.raises(Exception):
        run(spark, scratch, once_broken)
    run(spark, scratch, once_broken)
    assert sorted(r.id for r in ST.read_sink(spark, f"{scratch}/out").collect()) == list(range(5))
    assert [r.id for r in ST.read_sink(spark, f"{scratch}/out-rejected").collect()] == [9]


def test_two_sinks_have_their_own_checkpoints(spark, scratch):
    drop_file(spark, scratch, [request(1)], 0)
    run(spark, scratch, transform(), "a")
    run(spark, scratch, transform(), "b")
    assert ST.read_sink(spark, f"{scratch}/a").count() == ST.read_sink(spark, f"{scratch}/b").count() == 1
    assert ST.sink_checkpoint(spark, "x", "y") == ST.sink_checkpoint(spark, "x/", "y") != ST.sink_checkpoint(spark, "x", "z")


def test_top_factors(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, None), (2, 0.1, 0.0, 10.0), (3, None, None, None)], "id int, a double, b double, c double")
    w, means = {"a": 2.0, "b": -1.0, "c": 0.1}, {"a": 0.4, "c": 1.0}
    for r in ST.with_top_factors(df, w, means, 2).collect():
        own = {f: ((r[f] or 0.0) - means.get(f, 0.0)) * w[f] for f in w}
        want = sorted(own, key=lambda f: (-abs(own[f]), f))[:2]
        assert [(x.feature, x.direction) for x in r.top_factors] == [(f, "increases_risk" if own[f] > 0 else "decreases_risk") for f in want]
        assert [x.contribution for x in r.top_factors] == pytest.approx([own[f] for f in want])
    assert ST.with_top_factors(df, {}, {}).first()["top_factors"] == []
    feats = SC.request_features(spark.createDataFrame([request(1)], ST.REQUEST_SCHEMA))
    assert len(ST.with_top_factors(feats, {c: 1.0 for c in feats.columns if c != "id" and dict(feats.dtypes)[c] != "string"}, {}).first()["top_factors"]) == 5
