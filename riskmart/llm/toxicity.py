"""Toxicity (5): non-negative positive-unlabelled learning of a linear word classifier in numpy.

Confirmed toxic documents are the positives, documents drawn from the whole table the unlabelled ones;
non-toxic labels serve only to estimate the class prior. The risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` (logistic loss) corrects for the positives among the
unlabelled; while its second part is negative the step goes against that part alone, so that a flexible
model can't drive the risk below zero. The fitting sample is bounded by ``max_positive`` and
``max_unlabelled`` (rows with the smallest hash of their id); every document is scored over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import table

WORD = re.compile(r"[^\W\d_]+")
#: Predicted toxic from this score on.
CUT = 0.3


def word_ids(text: str | None) -> list[int]:
    """Fingerprints of the distinct words (lower case) of a whole text."""
    return [zlib.crc32(w.encode()) for w in set(WORD.findall((text or "").lower()))]


@dataclass
class Model:
    ids: np.ndarray       # sorted fingerprints of the words with a weight; bounded by max_words
    weights: np.ndarray
    bias: float


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, max_words: int = 4096,
             min_count: int = 3, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Fit by Adam on the non-negative PU risk. Words are those in at least ``min_count`` positives and
    commoner there than in unlabelled text (at most ``max_words``, the commonest first)."""
    if not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-3), 0.25)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(p / (1 - p))))
    ids, n = np.unique(np.concatenate(positive), return_counts=True)
    other, m = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(other, ids), max(0, len(other) - 1))
    seen = np.where(other[at] == ids, m[at], 0) if len(other) else np.zeros(len(ids))
    keep = (n >= min_count) & (n / len(positive) > 2 * seen / len(unlabelled))
    ids, n = ids[keep], n[keep]
    ids = np.sort(ids[np.argsort(-n, kind="stable")[:max_words]])

    def matrix(docs):
        row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, d in enumerate(docs):
            hit = np.flatnonzero(np.isin(ids, d, assume_unique=True))
            row.append(np.full(len(hit), k))
            col.append(hit)
        return np.concatenate(row), np.concatenate(col), len(docs)

    p, u = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)

    def margin(x):
        return np.bincount(x[0], weights=w[x[1]], minlength=x[2]) + b

    def back(x, g):        # gradient of mean loss by weights and bias, from the loss slopes g
        return np.append(np.bincount(x[1], weights=g[x[0]], minlength=len(ids)), g.sum()) / x[2]

    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)                    # noqa: E731
    for t in range(1, steps + 1):
        fp, fu = margin(p), margin(u)
        negative = loss(-fu).mean() - prior * loss(-fp).mean()
        g_neg = back(u, sig(fu)) - prior * back(p, sig(fp))
        g = prior * back(p, -sig(-fp)) + g_neg if negative >= 0 else -g_neg
        g[:-1] += l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(ids, w, float(b))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 12000, **options) -> Model:
    """Fit on a bounded sample. Labels of held-out rows are never read; null labels count as unlabelled."""
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter(~held_out(F.col("doc_id")))
    prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    pos = own.filter("toxic = 1").select("doc_id").distinct().orderBy(order).limit(max_positive)
    unl = (docs.select(F.col(id_col).alias("doc_id")).filter(~held_out(F.col("doc_id"))).distinct()
           .orderBy(order).limit(max_unlabelled))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(sorted(word_ids(t)), "<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "words"])

    def sample(ids: DataFrame) -> list[np.ndarray]:
        # the id list is bounded by the limit above, so the broadcast is too
        rows = texts.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(features, "doc_id long, words binary")
        return [np.frombuffer(r.words, "<u4") for r in sorted(rows.collect())]

    return fit_nnpu(sample(pos), sample(unl), float(prior), **options)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1, higher: likelier) over each whole text. Null, empty and
    wordless texts get the score of a text without any weighted word."""
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    bias = model.bias

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weight.keys()
        for b in batches:
            z = np.array([bias + sum(weight[i] for i in sorted(known & set(word_ids(t))))
                          for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], dtype=float)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())],
                                             names=[*b.schema.names, "toxic_score"])

    schema = docs.drop("toxic_score").schema
    return docs.drop("toxic_score").mapInArrow(scored, schema.add("toxic_score", "double"))


def op5_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # the text goes in once and only the id and the score come back
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
                      F.when(F.col("toxic_score") >= CUT, 1).otherwise(0).alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored ``CUT`` or more go. Rows without an id and rows that repeat one are judged by their own
    texts; a column ``toxic_score`` of the input stays as it is."""
    model = train(docs, table(spark, sf_dir, "labels"))
    other = "_".join(["given", *docs.columns])            # longer than every column's name, so it clashes with none
    scored = score(docs.withColumnRenamed("toxic_score", other), model).filter(F.col("toxic_score") < CUT).drop("toxic_score")
    return scored.withColumnRenamed(other, "toxic_score").select(*docs.columns)
