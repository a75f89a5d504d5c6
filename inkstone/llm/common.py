"""Helpers the corpus operators share: reading documents, byte-bounded slices of Arrow batches, document blocks."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.session import shared_dir

#: Words of the result contracts: runs of anything but space, tab, LF, VT, FF and CR. ``bytes.split()`` splits alike.
BLANKS = r"\x20\x09-\x0D"
#: Characters of text a task holds in Python at once.
SLICE_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``chars`` bytes of ``column``, so that memory follows bytes, not rows."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * chars / max(1, sizes)))
        for at in range(0, batch.num_rows, step):
            yield from halves(batch.slice(at, step), column, 4 * chars)


def halves(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A slice with a few very long texts is cut in two until it is small or one row."""
    if batch.num_rows < 2 or sum(len(x) for x in batch.column(column).to_pylist() if x) <= most:
        if batch.num_rows:
            yield batch
        return
    mid = batch.num_rows // 2
    yield from halves(batch.slice(0, mid), column, most)
    yield from halves(batch.slice(mid), column, most)


@contextlib.contextmanager
def no_collection():
    """Without Python's cycle collector: tables of strings and ids hold no cycles, but each pass would walk them all."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def id_remainder(column: str, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % of


def blocks(docs: DataFrame, chars: int) -> DataFrame:
    """``docs`` with a column ``block``: hash blocks of about ``chars`` characters of text.

    A block is what one task holds at a time; ids and texts decide it, so it is the same in every scan.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // chars))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files: they would stay until the driver's collector meets their plans."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again, which cuts its lineage; ``codec`` where the session's is too wide."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
