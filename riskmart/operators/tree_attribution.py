"""X-2 (trees): interventional Shapley contributions for Spark ML tree ensembles.

For one tree, one explained row ``x`` and one background row ``z``, the Shapley value of the
"replace z's features by x's" game is a sum over leaves: with Sx the features of the leaf's path whose
conditions only x meets and Sz those that only z meets (a leaf with a feature that neither meets adds
nothing), a leaf value v adds v * |Sx|-1! |Sz|! / (|Sx|+|Sz|)! to each feature of Sx and subtracts
v * |Sx|! |Sz|-1! / (|Sx|+|Sz|)! from each feature of Sz. Averaging over the background gives the
interventional values; they add up to f(x) - mean f(z) exactly.

Distribution: the node tables come from the saved model (bounded by trees x 2^(depth+1) nodes) and
the background is a bounded sample (100 rows); both travel with the task closure. The rows to
explain are processed by ``mapInPandas``; each Arrow batch shares one traversal per tree, vectorised
over its rows, so the work spreads over the cluster like any other projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.session import shared_path


def _weight(a: int, b: int) -> float:
    return math.factorial(a) * math.factorial(b) / math.factorial(a + b + 1)


def tree_tables(model, kind: str) -> tuple[list[dict], np.ndarray]:
    """Node arrays per tree and per-tree weights from a fitted RandomForest/GBT classification model."""
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "tree_models", f"m{id(model)}_{np.random.default_rng().integers(1 << 30)}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").toPandas()
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        value = np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            if r.leftChild >= 0:
                feat[i], left[i], right[i] = int(r.featureIndex), int(r.leftChild), int(r.rightChild)
                thr[i] = float(r.leftCategoriesOrThreshold[0])
            if kind == "forest":
                stats = np.asarray(r.impurityStats, dtype=float)
                value[i] = stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0
            else:
                value[i] = float(r.prediction)
        root = int(g["id"].min())
        trees.append({"feature": feat, "threshold": thr, "left": left, "right": right, "value": value, "root": root,
                      "tree": int(tid)})
    trees.sort(key=lambda t: t["tree"])
    if kind == "forest":
        weights = np.full(len(trees), 1.0 / len(trees))
    else:
        weights = np.asarray(model.treeWeights, dtype=float)
    return trees, weights


def _predict_tree(t: dict, X: np.ndarray) -> np.ndarray:
    """Leaf value for every row: all rows descend one level per step (vectorised)."""
    idx = np.full(X.shape[0], t["root"], dtype=np.int64)
    rows = np.arange(X.shape[0])
    while True:
        inner = t["left"][idx] >= 0
        if not inner.any():
            return t["value"][idx]
        f = np.where(inner, t["feature"][idx], 0)
        go_left = X[rows, f] <= t["threshold"][idx]
        idx = np.where(inner, np.where(go_left, t["left"][idx], t["right"][idx]), idx)


def _tree_shap(t: dict, x: np.ndarray, Z: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """Add scale * mean over background rows of the baseline Shapley values of tree t at x."""
    out = np.zeros((1, phi.shape[0]))
    _tree_shap_batch(t, x[None, :], Z, out, scale)
    phi += out[0]


def _shares(pats: np.ndarray, zpats: np.ndarray, zcounts: np.ndarray, d: int, by_x: np.ndarray, by_z: np.ndarray) -> np.ndarray:
    """Per pattern of ``pats`` and path feature: the sum over the background's patterns of the Shapley weights of a leaf of
    value 1. Bit j of a pattern: the row meets the path's conditions on its j-th feature."""
    bit = np.arange(d)
    xb = ((pats[:, None] >> bit) & 1).astype(float)
    zb = ((zpats[:, None] >> bit) & 1).astype(float)
    i, j = np.nonzero((pats[:, None] | zpats[None, :]) == (1 << d) - 1)      # for other pairs neither side's value leads to the leaf
    nx, nz = d - zb.sum(axis=1).astype(np.int64)[j], d - xb.sum(axis=1).astype(np.int64)[i]
    of_x, of_z = np.zeros((2, len(pats), len(zpats)))
    of_x[i, j], of_z[i, j] = zcounts[j] * by_x[nx, nz], zcounts[j] * by_z[nx, nz]
    return xb * (of_x @ (1 - zb)) - (1 - xb) * (of_z @ zb)


def _tree_shap_batch(t: dict, X: np.ndarray, Z: np.ndarray, phi: np.ndarray, scale: float) -> None:
    """Batch form: ``phi[r]`` += scale * mean over background rows of the Shapley values of row r.

    One walk over the nodes carries, for every row and background row, the pattern of path features whose conditions it
    meets. What a pair contributes at a leaf depends on its two patterns alone, so a leaf costs a lookup per row and path
    feature, and a small product over the patterns found there: time grows with nodes times rows, not with the sets of
    features that a path can be split into."""
    nz = Z.shape[0]
    feat, thr, left, right, value = t["feature"], t["threshold"], t["left"], t["right"], t["value"]
    depth = 64
    by_x, by_z = np.zeros((depth, depth)), np.zeros((depth, depth))
    for i in range(depth):
        for j in range(depth - i):
            if i:
                by_x[i, j] = _weight(i - 1, j)
            if j:
                by_z[i, j] = _weight(i, j - 1)

    def leaf(node: int, path: tuple, x: np.ndarray, z: np.ndarray) -> None:
        d = len(path)
        if not d or value[node] == 0:
            return
        pats, at = np.unique(x, return_inverse=True)
        zpats, zcounts = np.unique(z, return_counts=True)
        table = _shares(pats, zpats, zcounts, d, by_x, by_z) * (value[node] * scale / nz)
        for j, f in enumerate(path):
            phi[:, f] += table[at, j]

    stack = [(t["root"], (), np.zeros(X.shape[0], dtype=np.int64), np.zeros(nz, dtype=np.int64))]
    while stack:
        node, path, x, z = stack.pop()
        if left[node] < 0:
            leaf(node, path, x, z)
            continue
        f = int(feat[node])
        xl, zl = X[:, f] <= thr[node], Z[:, f] <= thr[node]
        for child, xc, zc in ((left[node], xl, zl), (right[node], ~xl, ~zl)):
            if f in path:                                            # a further condition on a feature of the path
                lost = 1 << path.index(f)
                stack.append((child, path, np.where(xc, x, x & ~lost), np.where(zc, z, z & ~lost)))
            else:
                d = len(path)
                stack.append((child, path + (f,), x | (xc.astype(np.int64) << d), z | (zc.astype(np.int64) << d)))


def _predict_batch(trees: list[dict], weights: np.ndarray, X: np.ndarray) -> np.ndarray:
    return sum(float(w) * _predict_tree(t, X) for t, w in zip(trees, weights))


def tree_contributions(model, kind: str, rows: DataFrame, background: DataFrame, feature_names: Sequence[str],
                       id_col: str, features_col: str = "features") -> DataFrame:
    """Long table ``(id, feature, contribution, base_value, margin)`` for a fitted tree ensemble.

    ``rows`` and ``background`` carry the assembled feature vector. ``kind`` is "forest"
    (explains P(class 1)) or "boosted" (explains the raw margin)."""
    trees, weights = tree_tables(model, kind)
    Z = np.asarray([np.asarray(v, dtype=float) for v in
                    background.select(vector_to_array(features_col).alias("v")).toPandas()["v"]])
    base = float(sum(w * _predict_tree(t, Z).mean() for t, w in zip(trees, weights)))
    names = list(feature_names)
    n_feat = len(names)

    def explain(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
            phi = np.zeros((X.shape[0], n_feat))
            for t, w in zip(trees, weights):
                _tree_shap_batch(t, X, Z, phi, float(w))
            margin = _predict_batch(trees, weights, X)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), n_feat), "feature": names * X.shape[0],
                                "contribution": phi.reshape(-1), "base_value": base,
                                "margin": np.repeat(margin, n_feat)})

    src = rows.select(F.col(id_col).cast("long").alias("id"), vector_to_array(features_col).alias("v"))
    return src.mapInPandas(explain, "id long, feature string, contribution double, base_value double, margin double")
