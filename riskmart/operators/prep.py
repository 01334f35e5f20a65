"""Preprocessing as persistable Spark ML stages.

Every estimator computes its statistics with one distributed aggregate (or the exact quantile
refinement of :mod:`riskmart.operators.quantiles`) and keeps only the small fitted values (one
number or one category list per column) on the driver, like Spark ML's own Imputer and
StringIndexer. ``transform`` is a single projection of built-in expressions, so it fuses into the
surrounding codegen stage and adds no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions import expr as X
from riskmart.operators.quantiles import exact_quantiles

# Fixed values (must equal the reference): missing-share threshold, capping percentile and the
# capped columns.
HIGH_MISSING_THRESHOLD = 0.40
OUTLIER_CAP_PERCENTILE = 99
SKEWED_COLUMNS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
                  "BUREAU_DEBT_SUM", "BUREAU_CREDIT_SUM", "BUREAU_OVERDUE_SUM"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------------------
# Shared estimator/model plumbing
# ---------------------------------------------------------------------------

class _HasCols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to process (None = chosen by type)",
                      typeConverter=TypeConverters.toListString)

    def getInputCols(self) -> list[str] | None:
        return self.getOrDefault(self.inputCols) if self.isDefined(self.inputCols) else None


class _StatsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Model whose fitted statistics are a JSON document stored in a Param (saved with the stage)."""

    state = Param(Params._dummy(), "state", "fitted statistics as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, state: dict | None = None):
        super().__init__()
        self._setDefault(state="{}")
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def stats(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Est(Estimator, _HasCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)


# ---------------------------------------------------------------------------
# R-1 drop high-missing columns
# ---------------------------------------------------------------------------

def null_share(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(F.when(_c(c).isNull(), 1.0).otherwise(0.0)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c: float(row[f"c{i}"] or 0.0) for i, c in enumerate(cols)}


class DropHighMissingModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.stats["drop"] if c in df.columns])


class DropHighMissing(_Est):
    """Drop columns whose missing share is strictly above ``threshold``."""

    threshold = Param(Params._dummy(), "threshold", "maximum allowed null share", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, threshold: float = HIGH_MISSING_THRESHOLD):
        super(_Est, self).__init__()
        self._setDefault(threshold=HIGH_MISSING_THRESHOLD)
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> DropHighMissingModel:
        cols = self.getInputCols() or df.columns
        shares = null_share(df, cols)
        t = self.getOrDefault(self.threshold)
        return DropHighMissingModel({"drop": [c for c in cols if shares[c] > t], "shares": shares})


def remove_high_missing_columns(df: DataFrame, threshold: float = HIGH_MISSING_THRESHOLD) -> DataFrame:
    return DropHighMissing(threshold=threshold).fit(df).transform(df)


# ---------------------------------------------------------------------------
# R-2 cap outliers at an exact percentile
# ---------------------------------------------------------------------------

class OutlierCapperModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        caps = self.stats["caps"]
        return df.select(*[X.clip(_c(c).cast("double"), upper=caps[c]).alias(c) if c in caps else _c(c)
                           for c in df.columns])


class OutlierCapper(_Est):
    """Cap the named columns (those present) from above at their exact ``percentile``."""

    percentile = Param(Params._dummy(), "percentile", "percentile 0..100", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, percentile: float = OUTLIER_CAP_PERCENTILE):
        super(_Est, self).__init__()
        self._setDefault(percentile=float(OUTLIER_CAP_PERCENTILE))
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _fit(self, df: DataFrame) -> OutlierCapperModel:
        cols = [c for c in (self.getInputCols() or SKEWED_COLUMNS) if c in df.columns]
        q = exact_quantiles(df, cols, [self.getOrDefault(self.percentile) / 100.0])
        return OutlierCapperModel({"caps": {c: v[0] for c, v in q.items() if v[0] is not None}})


def cap_outliers(df: DataFrame, percentile: float = OUTLIER_CAP_PERCENTILE) -> DataFrame:
    return OutlierCapper(percentile=float(percentile)).fit(df).transform(df)


# ---------------------------------------------------------------------------
# R-4 median imputation, R-5 population scaling
# ---------------------------------------------------------------------------

class MedianImputerModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        med = self.stats["medians"]
        return df.select(*[F.coalesce(_c(c).cast("double"), F.lit(med[c])).alias(c) if c in med and med[c] is not None
                           else _c(c) for c in df.columns])


class MedianImputer(_Est):
    """NULL -> exact median of the fitted frame (numeric columns by default)."""

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols() or numeric_columns(df)
        q = exact_quantiles(df, cols, [0.5])
        return MedianImputerModel({"medians": {c: v[0] for c, v in q.items()}})


class PopulationScalerModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        mean, std = self.stats["mean"], self.stats["std"]
        out = []
        for c in df.columns:
            if c in mean and mean[c] is not None:
                s = std[c] if std[c] not in (None, 0.0) else 1.0
                out.append(((_c(c).cast("double") - F.lit(mean[c])) / F.lit(s)).alias(c))
            else:
                out.append(_c(c))
        return df.select(*out)


class PopulationScaler(_Est):
    """(x - mean) / population std; a zero std divides by 1 (sklearn StandardScaler semantics)."""

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols() or numeric_columns(df)
        if not cols:
            return PopulationScalerModel({"mean": {}, "std": {}})
        row = df.agg(*[F.struct(F.avg(_c(c).cast("double")).alias("m"), F.stddev_pop(_c(c).cast("double")).alias("s"))
                       .alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return PopulationScalerModel({"mean": {c: row[f"c{i}"]["m"] for i, c in enumerate(cols)},
                                      "std": {c: row[f"c{i}"]["s"] for i, c in enumerate(cols)}})


# ---------------------------------------------------------------------------
# R-6 mode imputation, R-7 ordinal encoding
# ---------------------------------------------------------------------------

def _value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cid, v, n) per column and distinct non-null value; partial aggregation per task."""
    arr = F.array(*[F.struct(F.lit(i).alias("cid"), _c(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    return (df.select(F.explode(arr).alias("r")).select("r.cid", "r.v").where(F.col("v").isNotNull())
            .groupBy("cid", "v").agg(F.count(F.lit(1)).alias("n")))


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column; ties -> the smallest value."""
    if not cols:
        return {}
    vc = _value_counts(df, cols)
    best = vc.groupBy("cid").agg(F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v"))).alias("mode")).collect()
    found = {r["cid"]: r["mode"] for r in best}
    return {c: found.get(i) for i, c in enumerate(cols)}


def column_categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column. Like Spark's own StringIndexer, a fitted vocabulary is part of
    the model and lies on the driver; nothing else does."""
    out: dict[str, list[str]] = {c: [] for c in cols}
    if cols:
        for r in _value_counts(df, cols).select("cid", "v").toLocalIterator():
            out[cols[r["cid"]]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


class ModeImputerModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self.stats["modes"]
        return df.select(*[F.coalesce(_c(c).cast("string"), F.lit(modes[c])).alias(c) if modes.get(c) is not None
                           else _c(c) for c in df.columns])


class ModeImputer(_Est):
    """NULL -> most frequent value (ties -> smallest), categorical columns by default."""

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols() or categorical_columns(df)
        return ModeImputerModel({"modes": column_modes(df, cols)})


class OrdinalIndexerModel(_StatsModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        """The lookup is Spark's StringIndexerModel (a hash map in each task); its extra index for unseen and
        missing values becomes -1."""
        cats = {c: v for c, v in self.stats["categories"].items() if c in df.columns}
        known = [c for c in cats if cats[c]]
        if known:
            texts = df.select("*", *[_c(c).cast("string").alias(f"_text_{c}") for c in known])
            df = StringIndexerModel.from_arrays_of_labels(
                [cats[c] for c in known], inputCols=[f"_text_{c}" for c in known],
                outputCols=[f"_index_{c}" for c in known], handleInvalid="keep").transform(texts)
        index = {c: F.when(_c(f"_index_{c}") < len(cats[c]), _c(f"_index_{c}")).otherwise(-1.0) if cats[c] else F.lit(-1.0)
                 for c in cats}
        hidden = {f"{p}{c}" for c in known for p in ("_text_", "_index_")}
        return df.select(*[index[c].alias(c) if c in cats else _c(c) for c in df.columns if c not in hidden])


class OrdinalIndexer(_Est):
    """Categories sorted ascending -> 0..k-1; unseen (or missing) at transform time -> -1."""

    def _fit(self, df: DataFrame) -> OrdinalIndexerModel:
        cols = self.getInputCols() or categorical_columns(df)
        return OrdinalIndexerModel({"categories": column_categories(df, cols)})


# ---------------------------------------------------------------------------
# R-3, R-8, R-9 the full preprocessor
# ---------------------------------------------------------------------------

def build_preprocessor(df: DataFrame, exclude: Sequence[str] = ("SK_ID_CURR", "TARGET"),
                       output_col: str = "features") -> tuple[Pipeline, list[str]]:
    """Numeric: median impute + population scale; categorical: mode impute + ordinal encode;
    assembled numeric block first, then categorical block. Returns the pipeline and the ordered
    feature names (numeric then categorical, matching the vector)."""
    num = numeric_columns(df, exclude)
    cat = categorical_columns(df, exclude)
    stages = [MedianImputer(inputCols=num), PopulationScaler(inputCols=num),
              ModeImputer(inputCols=cat), OrdinalIndexer(inputCols=cat),
              VectorAssembler(inputCols=num + cat, outputCol=output_col, handleInvalid="keep")]
    return Pipeline(stages=stages), num + cat


# ---------------------------------------------------------------------------
# R-10, R-11 legacy helpers
# ---------------------------------------------------------------------------

def fill_missing_legacy(df: DataFrame) -> DataFrame:
    """Numeric NULL -> median, text NULL -> mode, both fitted on the frame itself."""
    num = numeric_columns(df)
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    med = {c: v[0] for c, v in exact_quantiles(df, num, [0.5]).items()}
    modes = column_modes(df, txt)
    out = []
    for c in df.columns:
        if c in med and med[c] is not None:
            out.append(F.coalesce(_c(c).cast("double"), F.lit(med[c])).alias(c))
        elif c in modes and modes[c] is not None:
            out.append(F.coalesce(_c(c), F.lit(modes[c])).alias(c))
        else:
            out.append(_c(c))
    return df.select(*out)


def one_hot_drop_first(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns -> one 0/1 column per category except the smallest; missing -> all zeros."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cats = column_categories(df, cols)
    out = [_c(c) for c in df.columns if c not in cols]
    for c in cols:
        for v in cats[c][1:]:
            out.append(F.when(_c(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*out)


def remove_invalid_rows(df: DataFrame, column: str = "CODE_GENDER", invalid: str = "XNA") -> DataFrame:
    """P-16: drop rows whose column equals the invalid code (NULL rows are kept; no-op if absent)."""
    if column not in df.columns:
        return df
    return df.where(~_c(column).eqNullSafe(F.lit(invalid)))
