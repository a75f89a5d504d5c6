"""Per-key request windows anchored at their first event: batch over history, and as a stream."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from inkstone.operators.folds import fold_sorted

MICRO = 1_000_000


def _anchors(ts: list[int], begin: int, width: int) -> tuple[list[int], int]:
    """Window starts among sorted ``ts`` from the first time >= ``begin``, and the next free time."""
    out, i = [], bisect_left(ts, begin)
    while i < len(ts):
        out.append(ts[i])
        begin = ts[i] + width
        i = bisect_left(ts, begin, i)
    return out, begin


def rate_limit(events: DataFrame, key: str, ts: str, ident: str, window_s: float, limit: int, blocks: int = 16, exempt: tuple = ()) -> DataFrame:
    """Every event with its window start, its number in the window, limited flag and retry seconds.

    Windows chain: each starts at the first event at or after the end of the one before, so a key
    is sequential. A busy key is still split: time blocks of ``blocks`` windows are summarised in
    parallel (for each event that can start the block, where the chain leaves it), the chain is
    followed over one short row per block, and the blocks are then expanded in parallel.
    """
    width, span = int(window_s * MICRO), int(window_s * MICRO) * blocks
    e = events.where(~F.col(key).isin(*exempt)) if exempt else events
    e = e.select(F.col(key).alias("k"), F.unix_micros(F.col(ts)).alias("us"), F.col(ident).alias("id"))
    e = e.withColumn("block", F.floor(F.col("us") / span).cast("long")).select("k", "block", "us", "id")
    times = e.select("k", "block", "us").distinct()

    def summary(key_, rows):
        us = [r[2] for r in rows]
        head = bisect_left(us, us[0] - us[0] % span + width)  # the chain can enter before this or at the first event after
        starts = us[: head + 1]
        leave: dict[int, int] = {}
        for i in range(len(us) - 1, -1, -1):  # where the chain leaves the block when a window starts at us[i]
            nxt = bisect_left(us, us[i] + width, i)
            leave[i] = us[i] + width if nxt == len(us) else leave[nxt]
        yield key_[0], key_[1], list(starts), [leave[i] for i in range(len(starts))]

    blocks_df = fold_sorted(times, ["k", "block"], ["us"], summary, f"k {e.schema['k'].dataType.simpleString()}, block long, starts array<long>, leaves array<long>")

    def chain(key_, rows):
        free = -(1 << 62)
        for k, block, starts, leaves in rows:
            yield k, block, free
            i = bisect_left(list(starts), free)
            if i < len(starts):
                free = int(leaves[i])

    entry = fold_sorted(blocks_df, ["k"], ["block"], chain, f"k {e.schema['k'].dataType.simpleString()}, block long, free long")
    j = times.join(entry, ["k", "block"]).select("k", "block", "us", "free")

    def expand(key_, rows):
        us, free = [r[2] for r in rows], rows[0][3]
        heads, _ = _anchors(us, free, width)
        for h in heads:
            yield key_[0], h

    heads = fold_sorted(j, ["k", "block"], ["us"], expand, f"k {e.schema['k'].dataType.simpleString()}, start long")
    return _number(e, heads, width, window_s, limit, key, ident)


def _number(e: DataFrame, heads: DataFrame, width: int, window_s: float, limit: int, key: str, ident: str) -> DataFrame:
    """Attach each event to its window by (key, slot of one window width) and number it inside."""
    from pyspark.sql import Window

    # a window covers at most two slots of its own width
    h = heads.select("k", "start", F.explode(F.array(F.floor(F.col("start") / width), F.floor(F.col("start") / width) + 1)).alias("slot"))
    j = e.withColumn("slot", F.floor(F.col("us") / width)).join(h, ["k", "slot"]).where((F.col("us") >= F.col("start")) & (F.col("us") < F.col("start") + width))
    w = Window.partitionBy("k", "start").orderBy("us", "id")  # one window of one key
    n = j.withColumn("n", F.row_number().over(w))
    left = window_s - (F.col("us") - F.col("start")) / MICRO
    over = F.col("n") > limit
    return n.select(
        F.col("k").alias(key), F.col("id").alias(ident), F.col("start").alias("window_start"), "n", over.alias("limited"),
        F.when(over, F.greatest(F.lit(1), left.cast("int"))).alias("retry_s"))


OUT = "k long, id long, window_start long, n int, limited boolean, retry_s int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Fixed windows of one key on event time.

    Events wait until the watermark has passed them, so they are numbered in the order of (time, id) in whatever order
    they arrive; those that arrive behind the watermark are dropped by Spark before they get here. A timer releases the
    earliest waiting event; when none waits, a timer at the window's end clears the key, so idle keys leave the state.
    """

    def __init__(self, window_s: float, limit: int):
        self.window_s, self.limit, self.width = window_s, limit, int(window_s * MICRO)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.window = handle.getValueState("window", "start long, n int")

    def _wake(self, us: int) -> None:
        """One timer a key: at the first millisecond not before ``us``."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-us // 1000))

    def _release(self, key: int, waiting: list[tuple[int, int]], watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting.sort()
        ready = bisect_right(waiting, (watermark_ms * 1000, 1 << 63))
        start, n = self.window.get() if self.window.exists() else (-(1 << 62), 0)
        rows = []
        for us, ident in waiting[:ready]:
            start, n = (us, 1) if us - start >= self.width else (start, n + 1)
            over = n > self.limit
            rows.append((key, ident, start, n, over, max(1, int(self.window_s - (us - start) / MICRO)) if over else None))
        if ready < len(waiting):
            self.waiting.put(waiting[ready:])
            self._wake(waiting[ready][0])
        else:
            self.waiting.clear()
            if start + self.width <= watermark_ms * 1000:  # no event can come into the window any more
                self.window.clear()
            else:
                self._wake(start + self.width)
        if rows:
            if self.waiting.exists() or start + self.width > watermark_ms * 1000:
                self.window.update((start, n))
            yield pd.DataFrame(rows, columns=["k", "id", "window_start", "n", "limited", "retry_s"]).astype({"retry_s": "Int32", "n": "int32"})

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(i)) for pdf in rows for u, i in zip(pdf["us"], pdf["id"])]
        held = [(int(r[0]), int(r[1])) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._release(int(key[0]), held + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(int(r[0]), int(r[1])) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._release(int(key[0]), held, timerValues.getCurrentWatermarkInMs())


def rate_limit_stream(events: DataFrame, window_s: float, limit: int, delay: str = "0 seconds") -> DataFrame:
    """The same rule on a stream of (k long, id long, ts timestamp); rows come out once the watermark has passed them.

    ``delay`` is how late an event may arrive. The session's state store must be RocksDB (``ROCKSDB``), which holds timers.
    """
    src = events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return src.groupBy("k").transformWithStateInPandas(
        statefulProcessor=Limiter(window_s, limit), outputStructType=OUT, outputMode="append", timeMode="EventTime")
