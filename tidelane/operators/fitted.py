"""Linear scorers fitted by least squares on standardised columns.

One aggregate gives all means and covariances; what reaches the driver are as many numbers as pairs
of columns. The parameters are rows, which can be stored, and a scorer made of them is Columns:
scale, predict, unscale.

Defined results: rows with a null or NaN in any column take no part in a fit; a column that never
changes has the scale 1; where features depend on one another the smallest coefficients are taken;
without rows all parameters are null, and so are predictions from them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = "target string, feature string, coefficient double, mean double, scale double, target_mean double, target_scale double"


def fit(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """PARAMETERS: a row for each target and feature. Coefficients are between standardised columns."""
    names = [*features, *targets]
    sound = rows.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)))
    for k in range(len(names)):
        sound = sound.filter(F.col(f"c{k}").isNotNull() & ~F.isnan(f"c{k}"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = sound.agg(*(F.avg(f"c{k}").alias(f"m{k}") for k in range(len(names))), *(F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs)).first()
    spark = rows.sparkSession
    if got["m0"] is None:
        return spark.createDataFrame([(t, f, *[None] * 5) for t in targets for f in features], PARAMETERS)
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"s{i}_{j}"]
    variance = cov.diagonal()
    scale = np.where(variance > 0, np.sqrt(np.maximum(variance, 0)), 1.0)
    gram = cov / np.outer(scale, scale)
    n = len(features)
    solved = np.linalg.lstsq(gram[:n, :n], gram[:n, n:], rcond=1e-10)[0]
    out = [(t, f, float(solved[i, j]), float(got[f"m{i}"]), float(scale[i]), float(got[f"m{n + j}"]), float(scale[n + j])) for j, t in enumerate(targets) for i, f in enumerate(features)]
    return spark.createDataFrame(out, PARAMETERS)


def predictions(parameters: DataFrame, columns: dict[str, Column] | None = None) -> dict[str, Column]:
    """A Column for each target, of the features' columns (by their names, if not given)."""
    out: dict[str, Column] = {}
    for r in parameters.orderBy("target", "feature").collect():  # targets times features
        value = (columns or {}).get(r["feature"], F.col(r["feature"]))
        part = F.lit(r["coefficient"]) * (value - F.lit(r["mean"])) / F.lit(r["scale"]) * F.lit(r["target_scale"])
        out[r["target"]] = out.get(r["target"], F.lit(r["target_mean"])) + part
    return out


def scorer(parameters: DataFrame, features: tuple[str, ...], targets: tuple[str, ...] = ("roll", "heave", "pitch")) -> Callable[..., tuple[Column, ...]]:
    """A scorer as motion.scored() takes it: a function of the features' columns, in their order."""

    def score(*columns: Column) -> tuple[Column, ...]:
        found = predictions(parameters, dict(zip(features, columns)))
        return tuple(found[t] for t in targets)

    return score
