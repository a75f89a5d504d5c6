"""Which texts contain which titles: every text is run once over an automaton of all titles.

Titles are dealt into shards of a bounded number of characters; a shard's automaton is built in each task, so what is
sent never grows with the dictionary. Texts stay where they are read: no text, word or piece of one is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_CHARS = 2_000_000  # characters of the titles of an automaton
SLICE_BYTES = 4_000_000  # of text that Python holds at once

_BUILT: dict[str, ahocorasick.Automaton] = {}


def title_shards(titles: DataFrame, title: str) -> Iterator[list[str]]:
    """The distinct titles that are not empty, in sorted lists of about ``SHARD_CHARS`` characters."""
    t = titles.select(F.col(title).alias("t")).where("t <> ''").distinct()
    chars = t.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = -(-int(chars) // SHARD_CHARS)
    for s in range(shards):
        yield sorted(r["t"] for r in t.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == s).toLocalIterator())


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of ``patterns``; its values are their places in the list. A worker keeps the last one it built."""
    key = hashlib.md5("\0".join(patterns).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _BUILT:
        made = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            made.add_word(p, i)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[key] = made
    return _BUILT[key]


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have about ``SLICE_BYTES`` together, one longer text alone."""
    for b in batches:
        sizes = np.array([0 if x is None else x for x in pc.binary_length(b.column(column)).to_pylist()], np.int64)
        at = 0
        while at < b.num_rows:
            step = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, side="right")))
            yield b.slice(at, step)
            at += step


def contains_lists(texts: DataFrame, key: list[str], text: str, titles: DataFrame, title: str) -> DataFrame:
    """(key.., titles) for every text that contains a title as a substring: one row for a text and a shard, not one for a title."""
    rows = texts.select(*key, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    out = None
    for patterns in title_shards(titles, title):

        def scan(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            made, names = automaton(patterns), pa.array(patterns, pa.string())
            for b in text_slices(batches, "_text"):
                hits = [sorted({i for _, i in made.iter(s)}) if s else [] for s in b.column("_text").to_pylist()]
                some = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
                found = pa.array([i for h in hits for i in h], pa.int64())
                ends = pa.array(np.cumsum([0, *(len(h) for h in hits if h)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(some) for k in key), pa.ListArray.from_arrays(ends, names.take(found))], names=[*key, title])

        found = rows.mapInArrow(scan, f"{kinds}, `{title}` array<string>")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select(*key, F.array("_text").alias(title)).limit(0)


def contains_join(texts: DataFrame, key: list[str], text: str, titles: DataFrame, title: str) -> DataFrame:
    """(key.., title) for every text that contains the title as a substring, exactly once for each row of ``texts``."""
    return contains_lists(texts, key, text, titles, title).select(*key, F.explode(title).alias(title))
