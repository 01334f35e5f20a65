"""Dense positions of rows in a global order, without a window over one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.common import stored


def ranked(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """``df`` with ``column``: the position 0, 1, ... of each row by ``keys`` (ascending, nulls first).

    Rows are dealt out in ranges, sorted inside them and numbered as they stand; the offsets come from one
    count per range. Rows equal in all keys get neighbouring positions in the order of ``df``'s partitions,
    which also lets a range end between them, so no key is too frequent.
    """
    at, tie, part, start = (f"_{x}_{column}" for x in ("at", "tie", "range", "before"))
    placed = (df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie)
              .sortWithinPartitions(*keys, tie).drop(tie).withColumn(at, F.monotonically_increasing_id()))
    placed = stored(placed, name).withColumn(part, F.shiftright(at, 33))
    ranges = placed.groupBy(part).agg(F.count("*").alias("n"))
    # one row per range, as many as there are shuffle partitions
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    return (placed.join(F.broadcast(starts), part)
            .withColumn(column, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(part, start, at))
