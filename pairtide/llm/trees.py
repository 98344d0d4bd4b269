"""Tree ensembles of Spark ML as column expressions.

A trained ensemble is small and fixed, so it is written out as nested CASE expressions over feature columns:
scoring is then part of the query's own code and needs no model object, shuffle or Python on the executors.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)")


def _grow(lines: list[str], at: int, feature: Callable[[int], Column]) -> tuple[Column, int]:
    """The expression of the subtree that begins at line ``at``, and the line behind it."""
    if lines[at].startswith("Predict:"):
        return F.lit(float(lines[at].split(":")[1])), at + 1
    _, number, _, limit = _TEST.match(lines[at]).groups()
    below, at = _grow(lines, at + 1, feature)
    above, at = _grow(lines, at + 1, feature)
    return F.when(feature(int(number)) <= float(limit), below).otherwise(above), at


def tree_column(tree, feature: Callable[[int], Column]) -> Column:
    """What one regression or classification tree predicts, from ``feature(number)``."""
    lines = [line.strip() for line in tree.toDebugString.split("\n")[1:] if line.strip()]
    return _grow(lines, 0, feature)[0]


def boosted_chance(model, feature: Callable[[int], Column]) -> Column:
    """Chance of label 1 under a gradient-boosted model."""
    margin = sum((tree_column(t, feature) * float(w) for t, w in zip(model.trees, model.treeWeights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def vote_share(model, feature: Callable[[int], Column]) -> Column:
    """Share of a forest's trees that vote for label 1."""
    return sum((tree_column(t, feature) for t in model.trees), F.lit(0.0)) / len(model.trees)
