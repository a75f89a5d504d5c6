"""Sinks. All writes are distributed; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkstone.session import cut_lineage
from inkstone.sources.readers import KEY_END, RECORD_END


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Ordered columns, header in each part file, rows range-sorted across files."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_nested_json(df: DataFrame, path: str, run: str) -> None:
    """One nested document per row, partitioned by run."""
    df.write.mode("overwrite").partitionBy(run).json(path)


def write_records(df: DataFrame, path: str, part: str, key: str, text: str) -> None:
    """Corpus files, a folder for each ``part``: every document is one record of its key and whole text."""
    line = F.concat(F.col(key).cast("string"), F.lit(KEY_END), F.col(text))
    df.select(part, line.alias("value")).write.option("lineSep", RECORD_END).partitionBy(part).text(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(ord, line) rows of a markdown table: heading, rule, then one line per row."""
    spark, cols = df.sparkSession, df.columns
    head = spark.range(2).select(
        F.col("id").cast("int").alias("ord"),
        F.when(F.col("id") == 0, F.lit("| " + " | ".join(cols) + " |")).otherwise(F.lit("|" + "---|" * len(cols))).alias("line"),
    )
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]
    body = df.select(F.lit(2).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Idempotent keyed upsert: the newest version of every key wins, by partial aggregation."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


BUCKETS = 64


def newest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The highest complete version in a folder (before ``below``), from what is in storage."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((v for v in done if below is None or v < below), default=None)


def manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """Bucket -> version whose files hold it, of the newest complete version (before ``below``). At most one entry a bucket."""
    newest = newest_version(spark, f"{path}/manifest", below)
    if newest is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{path}/manifest/v={newest}").collect()}


def _read(spark: SparkSession, path: str, held: dict[int, int], schema: StructType) -> DataFrame:
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())))


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest complete version of a bucketed table; an empty one when there is none."""
    return _read(spark, path, manifest(spark, path), schema)


def upsert_buckets(updates: DataFrame, path: str, epoch: int, keys: list[str], version: str, buckets: int = BUCKETS) -> None:
    """Merges ``updates`` into the bucketed table at ``path`` as version ``epoch``.

    Rows are dealt to buckets by a hash of their keys. Only the buckets that have updates are read and written again,
    under the new version; the manifest, written last, names the version that holds each bucket. A version that is
    written again, after a lost driver, replaces its own files and leaves the earlier ones alone.
    """
    spark = updates.sparkSession
    updates = cut_lineage(updates)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r["bucket"] for r in updates.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    before = manifest(spark, path, epoch)
    base = _read(spark, path, {b: v for b, v in before.items() if b in touched}, updates.schema)
    merged = upsert(base, updates, keys, version).withColumn("bucket", bucket)
    merged.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={epoch}")
    now = before | {b: epoch for b in touched}
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v={epoch}")


def freeze(tables: dict[str, DataFrame], required: list[str], path: str) -> None:
    """Verbatim copy of the tables into a named snapshot folder; required tables must be present."""
    missing = [n for n in required if n not in tables]
    if missing:
        raise ValueError(f"missing required tables: {missing}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
