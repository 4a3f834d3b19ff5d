"""Robust scaling followed by a quantile map, fitted in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = 1000   # fixed value: points of the quantile map


@dataclass
class Scaling:
    """Fitted parameters: a few thousand numbers, whatever the data size."""

    columns: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    points: np.ndarray      # (QUANTILES, features), in scaled units
    rows: int = 0           # rows fitted on

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Rows to uniform [0, 1] coordinates; values outside the fitted range are clipped."""
        steps = np.linspace(0.0, 1.0, len(self.points))
        out = np.empty(x.shape, order="F")
        for j in range(x.shape[1]):
            q, v = self.points[:, j], (x[:, j] - self.centre[j]) / self.scale[j]
            # flat stretches of the map are read from both ends and averaged
            up = np.interp(v, q, steps)
            down = 1.0 - np.interp(-v, -q[::-1], steps)
            out[:, j] = np.clip((up + down) / 2.0, 0.0, 1.0)
        return out


def fit_scaling(normal: DataFrame, columns: Sequence[str], accuracy: int = 10000) -> Scaling:
    """Fit on normal rows: mergeable quantile sketches, one row back to the driver."""
    grid = F.lit(np.linspace(0.0, 1.0, QUANTILES))
    row = normal.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.percentile_approx(F.col(c).cast("double"), grid, accuracy).alias(c) for c in columns]).first()
    points = np.array([row[c] for c in columns], dtype=float).T
    at = lambda p: points[int(round(p * (QUANTILES - 1)))]
    centre, spread = at(0.5), at(0.75) - at(0.25)
    scale = np.where(spread == 0, 1.0, spread)
    return Scaling(tuple(columns), centre, scale, (points - centre) / scale, row["_rows"])


def matrix(cols) -> np.ndarray:
    """Columns side by side, each of them contiguous."""
    return np.array([np.asarray(c, dtype=float) for c in cols]).T


def apply_scaling(df: DataFrame, model: Scaling, out: str = "scaled") -> DataFrame:
    """Add the scaled features as an array column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scaled(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.transform(matrix(cols))))

    return df.withColumn(out, scaled(*[F.col(c).cast("double") for c in model.columns]))


