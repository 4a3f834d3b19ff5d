"""Isolation forest (Liu, Ting and Zhou, 2008) trained and scored as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodwatch.models.scaling import Scaling, matrix

NODE = "tree int, node int, feature int, threshold double, left int, right int, path double, drawn int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Node arrays of all trees; at most trees x (2 x sample - 1) nodes."""

    columns: tuple[str, ...]
    scaling: Scaling | None
    sample: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray

    @cached_property
    def steps(self) -> list[tuple]:
        """Per tree its levels and four arrays over doubled node numbers: the children (right, then left), and feature, threshold and path by twice the node.

        A leaf leads to itself, so all rows take as many steps as the tree has levels.
        """
        made = []
        for feature, threshold, left, right, path in zip(self.feature, self.threshold, self.left, self.right, self.path):
            inner, own = np.asarray(feature) >= 0, np.arange(len(feature))
            children = np.column_stack([np.where(inner, right, own), np.where(inner, left, own)]).astype(np.intp)
            levels, at = 0, np.zeros(1, dtype=np.intp)
            while inner[at].any():
                levels, at = levels + 1, np.unique(children[at[inner[at]]])
            double = lambda a, kind: np.repeat(np.asarray(a, dtype=kind), 2)
            made.append((levels, 2 * children.ravel(), double(np.maximum(feature, 0), np.intp), double(threshold, float), double(path, float)))
        return made

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), in (0, 1]; higher is more anomalous."""
        if self.scaling is not None:
            x = self.scaling.transform(x)
        values, rows = np.ascontiguousarray(x.T).ravel(), np.arange(len(x))   # one feature after another
        total = np.zeros(len(x))
        for levels, children, feature, threshold, path in self.steps:
            first = feature * len(x)
            at = np.zeros(len(x), dtype=np.intp)
            for _ in range(levels):
                at = children.take(at + (values.take(first.take(at) + rows) < threshold.take(at)))
            total += path.take(at)
        return np.power(2.0, -(total / len(self.feature)) / average_path(self.sample))


def draw_samples(normal: DataFrame, columns: Sequence[str], ids: Sequence[str], *, trees: int,
                 sample: int, seed: int, rows: int | None = None) -> DataFrame:
    """``sample`` rows per tree by hash, the algorithm's own subsampling.

    Row r belongs to tree t when a hash of both is below a bound, at every table
    size; the bound keeps about twice the rows a tree needs, or all rows of a
    small table, and only those are ranked. The result does not depend on
    partitioning.
    """
    rows = normal.count() if rows is None else rows
    bound = min(1.0, 2.0 * sample / max(1, rows))
    cell = float(1 << 40)
    base = normal.select(*ids, *columns).withColumn("_r", F.xxhash64(*[F.col(c) for c in ids], F.lit(seed)))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                     lambda t: F.pmod(F.xxhash64("_r", t), F.lit(1 << 40)) / F.lit(cell) < bound)
    base = base.withColumn("tree", F.explode(drawn)).withColumn("_h", F.xxhash64("_r", F.lit(1), F.col("tree")))
    rank = Window.partitionBy("tree").orderBy("_h", *ids)
    return base.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= sample)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree over a bounded sample: (feature, threshold, left, right, path)."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, None)]
    while todo:
        rows, depth, parent = todo.pop()
        me = len(nodes)
        if parent is not None:
            up, side = parent
            nodes[up] = nodes[up][:side] + (me,) + nodes[up][side + 1:]
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(open_features))
        cut = float(hi[f] - (hi[f] - lo[f]) * rng.random())   # in (lo, hi], so both sides have rows
        if not lo[f] < cut <= hi[f]:
            cut = float(hi[f])   # lo and hi are too close for a value between them
        goes_left = x[rows, f] < cut
        nodes.append((f, cut, -1, -1, 0.0))
        todo.append((rows[~goes_left], depth + 1, (me, 3)))
        todo.append((rows[goes_left], depth + 1, (me, 2)))
    return nodes


def fit_forest(normal: DataFrame, columns: Sequence[str], ids: Sequence[str], *, trees: int = 100,
               sample: int = 256, seed: int = 7, scaling: Scaling | None = None) -> Forest:
    """Grow each tree in its own task from its own sample; collect the bounded node table."""
    columns = tuple(columns)
    rows = scaling.rows if scaling is not None else None
    drawn = draw_samples(normal, columns, ids, trees=trees, sample=sample, seed=seed, rows=rows)
    shared = normal.sparkSession.sparkContext.broadcast(scaling)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_r")
        x = matrix([pdf[c] for c in columns])
        if shared.value is not None:
            x = shared.value.transform(x)
        nodes = grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(sample, 2)))))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        out["drawn"] = len(pdf)
        return out

    # bounded by trees x (2 x sample - 1) rows
    table = drawn.groupBy("tree").applyInPandas(build, NODE).toPandas().sort_values(["tree", "node"])
    parts = [g for _, g in table.groupby("tree")]
    pick = lambda c: [g[c].to_numpy() for g in parts]
    used = int(table["drawn"].max())
    return Forest(columns, scaling, used, pick("feature"), pick("threshold"), pick("left"), pick("right"), pick("path"))


def score_forest(df: DataFrame, forest: Forest, threshold: float, out: str = "if_score", skip: str | None = None) -> DataFrame:
    """Add the anomaly score and flag; one Arrow pass over broadcast node arrays.

    Rows whose ``skip`` column is true do not go through the trees: they are normal with score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)
    passed = F.coalesce(F.col(skip).cast("boolean"), F.lit(False)) if skip else F.lit(False)

    @F.pandas_udf(T.DoubleType())
    def score(left_out: pd.Series, *cols: pd.Series) -> pd.Series:
        asked = ~left_out.to_numpy(bool)
        found = np.zeros(len(asked))
        if asked.any():
            found[asked] = shared.value.score(matrix(cols if asked.all() else [c[asked] for c in cols]))
        return pd.Series(found)

    return (df.withColumn(out, score(passed, *[F.col(c).cast("double") for c in forest.columns]))
            .withColumn("is_anomaly", F.when(passed, 0).otherwise((F.col(out) >= threshold).cast("long")).cast("long")))


def score_quantile(normal_scores: DataFrame, q: float, column: str = "if_score") -> DataFrame:
    """One row with the ``q`` quantile of the scores, from a mergeable sketch."""
    return normal_scores.agg(F.percentile_approx(column, F.lit(q), F.lit(10000)).alias("threshold"))


def choose_threshold(normal_scores: DataFrame, q: float = 0.99, column: str = "if_score") -> float:
    """A quantile of normal scores for a newly trained forest."""
    return float(score_quantile(normal_scores, q, column).first()[0])
