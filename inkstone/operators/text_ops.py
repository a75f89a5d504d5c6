"""Text operators that need more than one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions import text as X

_REGION_START = "^(?:" + "|".join(K.CAPTION_REGIONS) + r")(?:[^\p{L}\p{N}_]|$)"


def _is_body_caption(s: Column) -> Column:
    bars = F.length(s) - F.length(F.translate(s, "|ㅣ", ""))
    after = X.strip(F.get(F.split(s, "[|ㅣ]", 2), F.lit(1)))
    return (s != "") & ~F.substring(s, 1, 1).isin("#", "<", "|") & (bars == 1) & F.coalesce(after.rlike(_REGION_START), F.lit(False))


def body_captions(docs: DataFrame, start_page: int = 1) -> DataFrame:
    """Captions that leaked into body text, continuation lines merged.

    One narrow row per line; the window and the regrouping stay inside one document.
    """
    breaks = F.regexp_count("line", F.lit(K.PAGE_BREAK_COMMENT))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = X.strip(F.col("line"))
    is_cap = _is_body_caption(s)
    is_stop = (s == "") | F.substring(s, 1, 1).isin("#", "<", "|")
    rows = rows.select(
        "doc_id", "pos", s.alias("s"), is_cap.alias("cap"),
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum(breaks).over(before), F.lit(0)).alias("breaks"),
        F.sum((is_cap | is_stop).cast("int")).over(w).alias("island"),
    )
    return (
        rows.groupBy("doc_id", "island")
        .agg(
            F.min_by(F.struct("cap", "start", "breaks"), "pos").alias("head"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("t"),
        )
        .where("head.cap")
        .select("doc_id", F.col("head.start").cast("long").alias("start"),
                (F.col("head.breaks") + start_page).cast("int").alias("page"), X.squeeze(F.col("t")).alias("caption"))
    )


def split_pages(docs: DataFrame, marker: str = r"\[page(\d+)\]\n?") -> DataFrame:
    """(doc_id, page, body): text before the first marker is dropped, a repeated page keeps its last body."""
    nums = F.regexp_extract_all("text", F.lit(marker), F.lit(1))
    bodies = F.split("text", marker, -1)
    pages = X.let(F.struct(nums.alias("n"), bodies.alias("b")), lambda s: F.transform(
        s["n"], lambda n, i: F.struct(i.alias("ord"), n.cast("int").alias("page"), F.get(s["b"], i + 1).alias("body"))))
    rows = docs.select("doc_id", F.inline(pages))
    return rows.groupBy("doc_id", "page").agg(F.max_by("body", "ord").alias("body"))


def pagewise(docs: DataFrame, fn) -> DataFrame:
    """Apply a column function to every page body; markers are kept, order is kept, no shuffle."""
    marks = F.regexp_extract_all("text", F.lit(r"(\[page\d+\])"), F.lit(1))
    bodies = F.split("text", r"\[page\d+\]", -1)

    def one(body: Column, mark: Column) -> Column:
        done = F.when(X.strip(body) == "", F.lit("")).otherwise(fn(body))
        return F.when(mark == "", done).otherwise(X.rstrip(F.concat(mark, F.lit("\n"), done)))

    parts = F.filter(F.zip_with(bodies, F.concat(F.array(F.lit("")), marks), one), lambda p: p != "")
    return docs.select("doc_id", F.array_join(parts, "\n\n").alias("text"))


def scan_detect(pages: DataFrame, threshold: int = 100) -> DataFrame:
    """Scanned when the middle page and its successor average fewer characters than ``threshold``."""
    n = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    mid = ((F.col("last") + 1) / 2).cast("int")
    picked = pages.join(n, "doc_id").where(F.col("page_no").isin(mid) | (F.col("page_no") == F.least(mid + 1, F.col("last"))))
    return picked.groupBy("doc_id").agg(F.avg("n_chars").alias("mean_chars")).withColumn(
        "scanned", F.col("mean_chars") < threshold)


def format_context(rows: DataFrame, key: str, order: str, line: Column, sep: str = "\n\n") -> DataFrame:
    """One text block per key from its ordered rows; use only where a key's rows are bounded."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x["line"]), sep).alias("context"))
