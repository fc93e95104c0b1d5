"""Path-dependent tree attributions (SHAP values) of boosted Spark regressors.

A leaf's share of the attribution of a feature on its path follows from the polynomial whose factors
are, for each other feature on the path, the share of training weight that goes the leaf's way plus
t if the row does: subsets of equal size have equal weight, and the coefficients sum them up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float
    #: For each feature on the path: (feature, low, high, share of weight): rows with low < x <= high go this way.
    path: tuple[tuple[int, float, float, float], ...]


def leaves(model) -> list[Leaf]:
    """All leaves of a fitted GBTRegressor, values scaled by tree weights. Continuous splits only."""
    out: list[Leaf] = []

    def walk(node, path: dict, scale: float) -> None:
        if node.subtreeDepth() == 0:
            out.append(Leaf(scale * node.prediction(), tuple((f, *b) for f, b in sorted(path.items()))))
            return
        split, count = node.split(), node.impurityStats().count()
        f, t = split.featureIndex(), split.threshold()
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, t))), (node.rightChild(), (max(low, t), high))):
            walk(child, path | {f: (*bounds, share * child.impurityStats().count() / count)}, scale)

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._java_obj.rootNode(), {}, weight)
    return out


def base_value(found: list[Leaf]) -> float:
    """The mean prediction by training weights, from which attributions start."""
    return sum(leaf.value * math.prod(p[3] for p in leaf.path) for leaf in found)


def attributions(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """SHAP values, rows by features."""
    out = np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.path)
        goes = [((x[:, f] > lo) & (x[:, f] <= hi)).astype("f8") for f, lo, hi, _ in leaf.path]
        for i, (feature, _, _, share) in enumerate(leaf.path):
            poly = [np.ones(len(x))]
            for j, (_, _, _, other) in enumerate(leaf.path):
                if j != i:
                    up = [c * goes[j] for c in poly]
                    poly = [c * other for c in poly] + [np.zeros(len(x))]
                    poly = [a + b for a, b in zip(poly, [np.zeros(len(x)), *up], strict=True)]
            weight = sum(c * (math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)) for k, c in enumerate(poly))
            out[:, feature] += leaf.value * (goes[i] - share) * weight
    return out


def tree_shap(df: DataFrame, model, cols: list[str], name: str = "shap") -> tuple[DataFrame, float]:
    """Adds an array of attributions in the order of ``cols`` (the model's inputs); also returns the base value.

    The model's leaves go to the tasks with the function; rows come in Arrow batches.
    """
    found = leaves(model)

    @F.pandas_udf("array<double>")
    def values(*xs: pd.Series) -> pd.Series:
        return pd.Series(list(attributions(np.column_stack([s.to_numpy("f8") for s in xs]), found)))

    return df.withColumn(name, values(*(F.col(c).cast("double") for c in cols))), base_value(found)
