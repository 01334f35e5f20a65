"""S-OUT-6 re-aimed: scoring applications as a Structured Streaming job.

The reference scores one HTTP request at a time. Here requests arrive as files in a folder (or any
streaming source); every micro-batch goes through the same stateless projections as the batch path
- defaults and constraints, request features, probability, decision, band, recommendation - and
lands in a parquet sink. The file sink plus the checkpoint give exactly-once output across
restarts and lost executors; no state, so no watermark is needed.

:func:`start_scoring_service` also keeps state: a request id that comes again within the watermark's delay is
scored once, and rejected requests go to a sink of their own with their reasons. Both sinks are written batch by
batch into folders named by the batch, so a batch that is run again after a failure replaces what it had
written before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskmart.operators import quality as Q
from riskmart.operators import scoring as SC
from riskmart.session import shared_path

REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("amt_income_total", T.DoubleType()),
    T.StructField("amt_credit", T.DoubleType()),
    T.StructField("amt_annuity", T.DoubleType()),
    T.StructField("ext_source_2", T.DoubleType()),
    T.StructField("ext_source_3", T.DoubleType()),
    T.StructField("age_years", T.IntegerType()),
    T.StructField("employed_years", T.DoubleType()),
    T.StructField("code_gender", T.StringType()),
    T.StructField("name_income_type", T.StringType()),
    T.StructField("name_education_type", T.StringType()),
    T.StructField("name_family_status", T.StringType()),
    T.StructField("name_housing_type", T.StringType()),
])


def sink_checkpoint(spark: SparkSession, source_dir: str, sink_dir: str) -> str:
    """The checkpoint folder of one source and sink: two streams never share one, a restart finds its own again."""
    key = hashlib.sha256(f"{source_dir.rstrip('/')}\n{sink_dir.rstrip('/')}".encode()).hexdigest()[:32]
    return shared_path(spark, "scoring_stream", key)


def score_requests(requests: DataFrame, coefficients: Mapping[str, float], intercept: float,
                   threshold: float = SC.DEFAULT_THRESHOLD) -> DataFrame:
    """Batch or streaming: validity, reasons, probability (valid rows only), decision, band, drivers."""
    checked = Q.row_constraints(requests)
    feats = SC.request_features(checked, keep=("id", "is_valid", "reasons"))
    prob = SC.sigmoid(SC.linear_margin(coefficients, intercept))
    scored = feats.select("id", "is_valid", "reasons",
                          F.when(F.col("is_valid") == 1, prob).alias("probability"))
    return SC.decide(scored, "probability", threshold)


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                         coefficients: Mapping[str, float], intercept: float,
                         checkpoint_dir: str | None = None, available_now: bool = True,
                         transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start the job; ``available_now`` processes what is there and stops (batch-like runs, tests)."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 64).parquet(source_dir)
    scored = transform(stream) if transform else score_requests(stream, coefficients, intercept)
    ckpt = checkpoint_dir or sink_checkpoint(spark, source_dir, sink_dir)
    writer = (scored.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def with_top_factors(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], k: int = 5) -> DataFrame:
    """``top_factors``: the k features with the largest |coefficient * (value - mean)| of the row's own array (ties by
    name), each with its contribution and direction. A missing value counts as 0, as in the margin. No shuffle."""
    parts = []
    for f, w in coefficients.items():
        c = (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) - F.lit(float(means.get(f, 0.0)))) * F.lit(float(w))
        parts.append(F.struct((-F.abs(c)).alias("order"), F.lit(f).alias("feature"), c.alias("contribution")))
    if not parts:
        return df.withColumn("top_factors", F.expr("CAST(array() AS array<struct<feature: string, contribution: double, direction: string>>)"))
    first = F.slice(F.array_sort(F.array(*parts)), 1, k)
    direction = lambda x: F.when(x["contribution"] > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk"))
    return df.withColumn("top_factors", F.transform(first, lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"),
                                                                              direction(x).alias("direction"))))


def linear_transform(coefficients: Mapping[str, float], intercept: float, means: Mapping[str, float] | None = None,
                     threshold: float = SC.DEFAULT_THRESHOLD, k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """Checked requests -> id, is_valid, reasons, the decision columns and the top factors (NULL for rejected ones)."""

    def run(requests: DataFrame) -> DataFrame:
        keep = ("id", "is_valid", "reasons")
        feats = SC.request_features(Q.row_constraints(requests), keep=keep)
        prob = SC.sigmoid(SC.linear_margin(coefficients, intercept))
        feats = with_top_factors(feats, coefficients, means or {}, k)
        ok = F.col("is_valid") == 1
        scored = feats.select(*keep, F.when(ok, prob).alias("probability"), F.when(ok, F.col("top_factors")).alias("top_factors"))
        return SC.decide(scored, "probability", threshold)

    return run


def start_scoring_service(spark: SparkSession, source_dir: str, sink_dir: str, rejects_dir: str, transform: Callable[[DataFrame], DataFrame], *,
                          delay: str = "1 hour", checkpoint_dir: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the job with duplicate state and two sinks.

    Of requests with one id that arrive (by their files' times) within ``delay`` the first counts. Requests without an id
    are rejected; equal ones count once. ``transform`` gives is_valid and reasons: valid rows go to ``sink_dir``, the
    others (id, reasons) to ``rejects_dir``; :func:`read_sink` reads either. Arrival times only grow, so no request is too
    late for the watermark unless the file source itself takes its file for too old.
    """
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 64).parquet(source_dir)
    names = [f.name for f in REQUEST_SCHEMA.fields]
    other = F.when(F.col("id").isNull(), F.xxhash64(*names)).otherwise(F.lit(0))
    once = (stream.select(*names, F.col("_metadata.file_modification_time").alias("_arrived"), other.alias("_other"))
            .withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["id", "_other"]))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*names).persist()
        try:
            scored = transform(rows.where("id IS NOT NULL"))
            lost = rows.where("id IS NULL").select("id", F.lit("id: missing").alias("reasons"))
            lost = lost.unionByName(scored.where("is_valid = 0").select("id", "reasons"))
            scored.where("is_valid = 1").drop("is_valid", "reasons").write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={number}")
            lost.write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/batch={number}")
        finally:
            rows.unpersist()

    writer = (once.writeStream.foreachBatch(write).outputMode("append")
              .option("checkpointLocation", checkpoint_dir or sink_checkpoint(spark, source_dir, sink_dir)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_sink(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that a service has written to one of its sinks."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder)
