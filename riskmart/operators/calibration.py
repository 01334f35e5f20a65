"""Probability calibration: reliability table, calibration error and isotonic regression.

Isotonic regression pools adjacent violators. Rows are counted per distinct score first; the scores are dealt out
in ranges, each range is pooled on its own into blocks, and the blocks of neighbouring ranges are pooled
together, twice as many ranges at a time, until one range is left. Pooling is associative over neighbouring ranges, so
the result is that of one sequential pass, while a task sees blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.operators.metrics import score_counts
from riskmart.session import written

BINS = 10


def equal_width_bin(score: Column, bins: int = BINS) -> Column:
    """0 .. bins-1 of a score in [0, 1]; 1 belongs to the last bin, scores outside to the edge bins."""
    return F.greatest(F.least(F.floor(score * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def reliability_table(df: DataFrame, label: str = "label", score: str = "score", bins: int = BINS) -> DataFrame:
    """(bin, n, mean_score, positive_rate, gap) of every bin with rows; rows without score or label don't count."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    t = rows.groupBy(equal_width_bin(F.col(score).cast("double"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    return t.withColumn("gap", F.abs(F.col("mean_score") - F.col("positive_rate")))


def calibration_error(df: DataFrame, label: str = "label", score: str = "score", bins: int = BINS) -> DataFrame:
    """One row: expected (row-weighted mean gap) and maximum calibration error; NULL without rows."""
    t = reliability_table(df, label, score, bins)
    return t.agg(F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n").cast("double")).alias("expected_calibration_error"),
                 F.max("gap").alias("maximum_calibration_error"))


def pooled(low: np.ndarray, high: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent violators of blocks in ascending order: (low, high, pos, n) of the blocks that are left."""
    out: list[list] = []
    for block in zip(low.tolist(), high.tolist(), pos.tolist(), n.tolist()):
        cur = list(block)
        # means that are equal are pooled too, so the blocks have strictly rising means
        while out and out[-1][2] * cur[3] >= cur[2] * out[-1][3]:
            last = out.pop()
            cur = [last[0], cur[1], last[2] + cur[2], last[3] + cur[3]]
        out.append(cur)
    return tuple(np.array(c) for c in zip(*out)) if out else (low, high, pos, n)


_BLOCKS = "part int, low double, high double, pos long, n long"


def _pool_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one or more parts, sorted by (part, low): the pooled blocks of each part."""
    part, held = None, None

    def out(part, held):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), part), pa.int32()), pa.array(held[0], pa.float64()), pa.array(held[1], pa.float64()),
                                           pa.array(held[2], pa.int64()), pa.array(held[3], pa.int64())], names=["part", "low", "high", "pos", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for chunk in zip(*(np.split(c, cuts) for c in cols)):
            if part is not None and chunk[0][0] == part:
                held = pooled(*(np.concatenate(x) for x in zip(held, chunk[1:])))
            else:
                if part is not None:
                    yield out(part, held)
                part, held = int(chunk[0][0]), pooled(*chunk[1:])
    if part is not None:
        yield out(part, held)


def isotonic_blocks(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(low, high, n, value): blocks of scores and their calibrated probability, strictly rising in both.

    Rows without score or label don't count, NaN scores neither; no rows give no blocks.
    """
    counts = score_counts(df, label, score).where(~F.isnan("score"))
    parts = counts.select(F.col("score").alias("low"), F.col("score").alias("high"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    parts = parts.repartitionByRange("low").sortWithinPartitions("low").select(F.spark_partition_id().alias("part"), "low", "high", "pos", "n")
    blocks = written(parts.mapInArrow(_pool_sorted, _BLOCKS), "isotonic")
    last = blocks.agg(F.max("part")).first()[0] or 0
    while last:
        last //= 2
        merged = blocks.withColumn("part", F.expr("CAST(part DIV 2 AS INT)")).repartition("part").sortWithinPartitions("part", "low")
        blocks = written(merged.mapInArrow(_pool_sorted, _BLOCKS), "isotonic")
    return blocks.select("low", "high", "n", (F.col("pos") / F.col("n")).alias("value"))


def calibrate(df: DataFrame, blocks: DataFrame, score: str = "score", out_col: str = "calibrated") -> DataFrame:
    """``df`` with the probability of the block that a score lies in; between two blocks linear interpolation, beyond the
    first and the last their value. NULL and NaN scores give NULL.

    The blocks (as many as there are steps in the fitted function) are held by every task, as the boundaries of Spark
    ML's own isotonic model are.
    """
    rows = blocks.orderBy("low").collect()
    x = np.array([v for r in rows for v in (r["low"], r["high"])])
    y = np.array([v for r in rows for v in (r["value"], r["value"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)
            ok = ~np.isnan(s) & bool(len(x))
            v = np.interp(np.where(ok, s, 0.0), x, y) if len(x) else np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, mask=~ok)], names=[*b.schema.names[:-1], out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out_col}` double"
    return df.withColumn("_s", F.col(score).cast("double")).mapInArrow(run, schema)
