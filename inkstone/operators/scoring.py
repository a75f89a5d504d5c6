"""Cache-aware scoring: keys, hit/miss split, a hook for a caller's model, the default rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.operators.ranking import top_per_group


def cache_key(model: Column, system: Column, user: Column) -> Column:
    """SHA-256 of model, system and user prompt separated by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", model, system, user), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached response; ``cached`` is true even for an empty stored response."""
    c = cache.select("key", "response").withColumn("cached", F.lit(True))
    return requests.join(c, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def fill_misses(split: DataFrame, attempts: DataFrame, max_tries: int = 3) -> DataFrame:
    """Misses take their first non-empty attempt, at most ``max_tries``; hits are kept as they are."""
    tried = attempts.where((F.col("attempt") < max_tries) & (F.coalesce("response", F.lit("")) != ""))
    first = tried.groupBy("key").agg(F.min_by("response", "attempt").alias("fresh"), (F.min("attempt") + 1).alias("tries"))
    return split.join(first, "key", "left").select(
        *[c for c in split.columns if c not in ("response", "cached")], "cached",
        F.when(F.col("cached"), F.col("response")).otherwise(F.coalesce("fresh", F.lit(""))).alias("response"),
        F.when(F.col("cached"), 0).otherwise(F.coalesce("tries", F.lit(max_tries))).alias("tries"))


def scored_map(rows: DataFrame, score: Callable[[pd.DataFrame], pd.Series], runs: int = 1) -> DataFrame:
    """Apply a caller's batch model ``runs`` times; rows stream through Arrow, nothing is grouped.

    ``score`` gets a frame with the input columns and ``run`` and returns one number per row.
    """
    many = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(score=score(pdf).astype("float64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema.fields) + ", score double"
    return many.mapInPandas(batches, schema)


def degree_rule(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic default scorer: the degree, with short generic titles pushed down."""
    return pdf["degree"] - 1000.0 * pdf["title"].isin(K.GENERIC_TITLES)


def rubric_apply(members: DataFrame, keys: list[str], generic: DataFrame, budget: int) -> DataFrame:
    """Keep at most ``budget`` per room: not generic, by degree, then title; the rest is demoted."""
    g = generic.select("title").distinct().withColumn("generic", F.lit(True))
    m = members.join(g, "title", "left").withColumn("generic", F.coalesce("generic", F.lit(False)))
    kept = top_per_group(m.where(~F.col("generic")), keys, [F.desc("degree"), "title"], budget)
    k = kept.select(*keys, "title", "rank")
    return m.join(k, [*keys, "title"], "left").select(
        *keys, "title", "degree", "generic", F.when(F.col("rank").isNotNull(), "kept").otherwise("demoted").alias("status"), "rank")
