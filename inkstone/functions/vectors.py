"""Vector column functions (arrays of floats), JVM-side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkstone.functions.text import let


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column, floor: float = 1e-12) -> Column:
    return let(
        F.struct(_d(a).alias("v"), F.greatest(norm(a), F.lit(floor)).alias("n")),
        lambda b: F.transform(b["v"], lambda x: x / b["n"]))


def cosine(a: Column, b: Column) -> Column:
    """0.0 when either side has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0.0, F.lit(0.0)).otherwise(dot(a, b) / n)


@F.pandas_udf(DoubleType())
def unit_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dot product of two unit vectors per row, in Arrow batches: many pairs, wide vectors."""
    if len(a) == 0:
        return pd.Series([], dtype="float64")
    return pd.Series(np.einsum("ij,ij->i", np.stack(a.to_numpy()), np.stack(b.to_numpy())))


def mean_vectors(df, key: str, vector: str, normalize_first: bool, out: str = "centroid"):
    """Centroid per key: one partial aggregate per dimension, so a hot key never lands in one task.

    ``normalize_first`` averages unit vectors instead of raw ones. The result is unit length.
    """
    v = normalize(F.col(vector)) if normalize_first else F.col(vector)
    long = df.select(key, F.posexplode(_d(v)).alias("pos", "x"))
    mean = long.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    packed = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return packed.select(key, normalize(F.transform("p", lambda s: s["x"])).alias(out))
