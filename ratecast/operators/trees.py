"""A fitted tree ensemble as plain splits and leaves, for steps that score
one row under many changed columns (survey M15, M16).

A row's prediction depends on it only through the outcomes of the splits, so
a step can take each outcome once per row and vary a column by its own
splits alone, in place of running every changed copy through the pipeline.
Spark spreads the rows; a task holds one Arrow batch of them at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, OneHotEncoderModel
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel


def matrix(vectors) -> np.ndarray:
    """An Arrow column of equally long lists as rows x slots."""
    n = len(vectors)
    return np.array(vectors.flatten()).reshape(n, -1) if n else np.empty((0, 0))


class Node(NamedTuple):
    split: int
    left: object  # Node or the leaf's weighted prediction
    right: object


@dataclass
class TreeSum:
    """``trees`` whose leaves sum to the prediction; ``splits`` are (slot,
    threshold, None) or (slot, None, values that go left), each held once."""
    splits: list[tuple]
    trees: list

    def outcomes(self, x: np.ndarray) -> np.ndarray:
        """Splits x rows: whether the row goes left."""
        out = np.empty((len(self.splits), len(x)), dtype=bool)
        for s, (slot, threshold, values) in enumerate(self.splits):
            out[s] = x[:, slot] <= threshold if values is None else np.isin(x[:, slot], values)
        return out

    def used(self, tree) -> set[int]:
        return {tree.split} | self.used(tree.left) | self.used(tree.right) if isinstance(tree, Node) else set()

    def predict(self, tree, went: np.ndarray) -> np.ndarray | float:
        """A tree's part of the prediction from the outcomes."""
        if not isinstance(tree, Node):
            return tree
        return np.where(went[tree.split], self.predict(tree.left, went), self.predict(tree.right, went))

    def leaves(self, free: set[int]) -> list[tuple[dict[int, bool], dict[int, bool], float]]:
        """Per leaf the outcomes it asks of the splits outside and inside
        ``free``, and its value; leaves that ask for both outcomes of one split are none."""
        found = []

        def walk(node, path):
            if not isinstance(node, Node):
                found.append(({s: w for s, w in path.items() if s not in free}, {s: w for s, w in path.items() if s in free}, node))
                return
            for went, child in ((True, node.left), (False, node.right)):
                if path.get(node.split, went) == went:
                    walk(child, {**path, node.split: went})
        for t in self.trees:
            walk(t, {})
        return found


def tree_sum(model) -> TreeSum | None:
    """The splits and leaves of a fitted tree, forest or boosted trees; None for other models."""
    if isinstance(model, DecisionTreeRegressionModel):
        trees, weights = [model], [1.0]
    elif isinstance(model, RandomForestRegressionModel):
        trees = model.trees
        weights = [1.0 / len(trees)] * len(trees)
    elif isinstance(model, GBTRegressionModel):
        trees, weights = model.trees, model.treeWeights
    else:
        return None
    at: dict[tuple, int] = {}

    def read(node, weight):
        if node.subtreeDepth() == 0:
            return weight * node.prediction()
        s = node.split()
        if s.getClass().getSimpleName() == "ContinuousSplit":
            key = (s.featureIndex(), s.threshold(), None)
        else:
            key = (s.featureIndex(), None, tuple(s.leftCategories()))
        return Node(at.setdefault(key, len(at)), read(node.leftChild(), weight), read(node.rightChild(), weight))
    roots = [read(t._call_java("rootNode"), w) for t, w in zip(trees, weights)]
    return TreeSum(list(at), roots)


def column_slots(model: PipelineModel, cols) -> dict[str, set[int]] | None:
    """The feature slots that each column feeds in a ``preprocessor`` pipeline
    (numerics, then booleans, then one-hot categoricals); None for other pipelines."""
    prep = model.stages[0]
    if not isinstance(prep, PipelineModel):
        return None
    imputers = [s for s in prep.stages if isinstance(s, ImputerModel)]
    encoders = [s for s in prep.stages if isinstance(s, OneHotEncoderModel)]
    parts = prep.stages[-1].getInputCols()
    num = imputers[0].getInputCols() if imputers else []
    slots, n = {c: {i} for i, c in enumerate(num)}, len(num)
    for p in parts[len(num):]:
        if p.startswith("_b_"):
            size, c = 1, p.removeprefix("_b_")
        elif encoders and p.startswith("_oh_"):
            size, c = int(encoders[0].categorySizes[encoders[0].getOutputCols().index(p)]), p.removeprefix("_oh_")
        else:
            return None
        slots.setdefault(c, set()).update(range(n, n + size))
        n += size
    return {c: slots.get(c, set()) for c in cols}
