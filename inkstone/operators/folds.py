"""Ordered per-key folds over sorted partitions, for the few rules no built-in expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Run ``fn(key, rows)`` for every key over its rows in ``order``; ``schema`` is that of the output rows.

    One shuffle and one sort by Spark; tasks then stream Arrow batches and hold the rows of a
    single key, so keys must be small by meaning (one image, one document, one time block).
    """
    n = len(keys)
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    src = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        out: list[tuple] = []
        for key, grp in groupby(rows, key=lambda r: r[:n]):
            out.extend(fn(key, list(grp)))
            if len(out) >= 20000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return src.mapInPandas(run, schema)
