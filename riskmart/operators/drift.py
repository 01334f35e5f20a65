"""Population stability: a persisted reference profile against batches, time windows and streams.

A profile has, per feature, the bin edges (quantiles of the reference rows) and the share of the reference rows in each
bin, missing values in a bin of their own. The index of a feature sums (actual - expected) * ln(actual / expected)
over its bins, with shares kept above ``FLOOR``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.boosting import binned
from riskmart.operators.quantiles import exact_quantiles

BINS, FLOOR = 10, 1e-4
#: Bounds of "stable" and "shifting"; above the second a population has shifted.
STABLE, SHIFTING = 0.1, 0.25


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str | Column] = ()) -> DataFrame:
    """(by..., feature, bin, n): rows per bin (0: missing) of every feature in one aggregate. Works on streams, too."""
    names = list(edges)
    keys = [F.col(c).alias(c) if isinstance(c, str) else c for c in by]
    kept = df.select(*keys, *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)])
    keep = kept.columns[:len(keys)]
    rows = binned(kept, {f"f{i}": edges[c] for i, c in enumerate(names)}, keep)
    labels = F.array(*[F.lit(c) for c in names])
    long = rows.select(*keep, F.posexplode("bins").alias("i", "bin"))
    return long.groupBy(*keep, labels[F.col("i")].alias("feature"), "bin").agg(F.count("*").alias("n"))


class Profile:
    """Edges and reference counts: at most features x (bins + 1) rows."""

    def __init__(self, edges: dict[str, list[float]], counts: list[tuple[str, int, int]]):
        self.edges, self.counts = edges, counts

    def table(self, spark: SparkSession) -> DataFrame:
        """(feature, bin, expected): every bin, also those without a reference row."""
        n: dict[tuple[str, int], int] = {(f, b): 0 for f, e in self.edges.items() for b in range(len(e) + 2)}
        for f, b, k in self.counts:
            n[f, b] = k
        total = {f: sum(k for (g, _), k in n.items() if g == f) for f in self.edges}
        rows = [(f, b, k / total[f] if total[f] else None) for (f, b), k in n.items()]
        return spark.createDataFrame(rows, "feature string, bin int, expected double")

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"edges": self.edges, "counts": self.counts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profile:
        d = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return Profile(d["edges"], [tuple(c) for c in d["counts"]])


def reference_profile(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Profile:
    """Profile of ``df``: edges at its exact quantiles (repeated ones once; a feature without values has none)."""
    found = exact_quantiles(df, list(features), [i / bins for i in range(1, bins)])
    edges = {c: sorted({x for x in q if x is not None}) for c, q in found.items()}
    return Profile(edges, [(r["feature"], r["bin"], r["n"]) for r in bin_counts(df, edges).collect()])


def _index(counts: DataFrame, profile: Profile, by: Sequence[str]) -> DataFrame:
    """PSI of (by..., feature, bin, n)."""
    spark = counts.sparkSession
    totals = counts.groupBy(*by, "feature").agg(F.sum("n").alias("total"))
    ref = F.broadcast(profile.table(spark))                    # features x (bins + 2) rows
    own = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("feature").alias("_f"), F.col("bin").alias("_b"), "n")
    same = (F.col("feature") == F.col("_f")) & (F.col("bin") == F.col("_b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    full = totals.join(ref, "feature").join(own, same, "left")
    e, a = (F.greatest(x, F.lit(FLOOR)) for x in (F.col("expected"), F.coalesce("n", F.lit(0)) / F.col("total")))
    psi = full.groupBy(*by, "feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.max("total").alias("n_rows"))
    status = F.when(F.col("psi") < STABLE, "stable").when(F.col("psi") < SHIFTING, "shifting").otherwise("shifted")
    return psi.withColumn("status", status)


def psi_by_feature(df: DataFrame, profile: Profile) -> DataFrame:
    """(feature, psi, n_rows, status) of a batch."""
    return _index(bin_counts(df, profile.edges), profile, ())


def psi_by_window(df: DataFrame, profile: Profile, time_col: str, width: str) -> DataFrame:
    """(window_start, feature, psi, n_rows, status) per tumbling window; rows without a time are left out."""
    start = F.window(time_col, width)["start"].alias("window_start")
    return _index(bin_counts(df.where(F.col(time_col).isNotNull()), profile.edges, [start]), profile, ["window_start"])


def stream_drift(stream: DataFrame, profile: Profile, time_col: str, width: str, delay: str, out_dir: str, checkpoint: str):
    """Started query: window counts of a stream, appended once a window is closed by the watermark ``delay``.

    ``out_dir`` holds (window_start, feature, bin, n); :func:`psi_of_counts` reads it. A restart goes on from
    ``checkpoint`` and the file sink writes every window once.
    """
    timed = stream.withWatermark(time_col, delay)
    long = bin_counts(timed, profile.edges, [F.window(time_col, width).alias("w")])
    flat = long.select(F.col("w.start").alias("window_start"), "feature", "bin", "n")
    return (flat.writeStream.outputMode("append").format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def psi_of_counts(counts: DataFrame, profile: Profile) -> DataFrame:
    """PSI per window of the counts that :func:`stream_drift` has written."""
    return _index(counts, profile, ["window_start"])
