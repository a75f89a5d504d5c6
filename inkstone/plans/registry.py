"""Catalogue of runnable queries: Spark plan + independent SQL statement of the same result."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inkstone.session import shared_dir


@dataclass
class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    spark: SparkSession
    root: str

    # tables whose rows cost real work to parse, with the key later steps group by
    TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return spread(df, self.TEXT_KEYS[name]) if name in self.TEXT_KEYS else df

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table many operators read, written once per session to the shared folder.

        It plays the part of a snapshot table: later plans start from a parquet scan instead of
        tokenising the corpus again, and a lost executor only costs a re-read.
        """
        app = self.spark.sparkContext.applicationId
        key = (app, self.root, name)
        if key not in _STORED:
            folder = hashlib.md5(self.root.encode()).hexdigest()[:12]
            path = f"{shared_dir(self.spark)}/tables-{app}/{folder}/{name}"
            build().write.mode("overwrite").parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])


_STORED: dict[tuple[str, str, str], str] = {}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the session has slots.

    A large table already has more splits than slots and is left alone, so no shuffle is added
    at scale; a table in a few files would otherwise run its regexes in a few tasks.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


@dataclass
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}
VIEW_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL statement."""

    def wrap(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(fn, with_views(sql) if sql else None)
        return fn

    return wrap


def view_sql(name: str, body: str) -> None:
    VIEW_SQL[name] = body


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the derived views it uses (transitively) as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in re.findall(r"\bv_\w+", text):
            if ref in VIEW_SQL and ref not in needed:
                visit(VIEW_SQL[ref])
                if ref not in needed:
                    needed.append(ref)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if re.match(r"(?i)with recursive\s", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive'):]}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[len('with'):]}"
    return f"WITH {ctes}\n{body}"


def load_catalog() -> dict[str, Entry]:
    from inkstone.plans import (  # noqa: F401
        aggregates, clusters, graph, matching, positions, ranking,
        retrieval, scoring, sets, sources, streams, text,
    )

    return CATALOG
