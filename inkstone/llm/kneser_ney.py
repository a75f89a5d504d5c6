"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams from trusted text.

Trusted are documents that a label calls good and not toxic. By hash, half of them train the model,
the other half set the threshold: a document is rejected when its perplexity is above the
QUANTILE of its language's trusted documents by more than MARGIN. Counts, continuation counts, discounts and back-off weights are joins and
aggregates of n-gram tables sharded by key. Documents ask for their distinct n-grams block by block, the answers come from one
join with the model and return to the block.

Defined cases: a null or blank text has no characters, its perplexity is null and it is rejected when there is a model (nothing
in it can be trusted); a null language is the language ``und``; a language without trusted documents takes the
threshold of all; without trusted documents every row is kept; null ids are never trusted; repeated rows keep a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import blocks, slices, store

ORDER, BITS = 4, 15
QUANTILE, MARGIN = 0.99, 0.03
#: Short texts: so many characters at the language's median are added before the comparison.
PRIOR_CHARS = 200
BLOCK_CHARS = 16_000_000
PIECE_CHARS = 2_000_000
PAD = 1  # stands before a text
SEEN, BACK = 0, 8  # kind of a model row: probability of a seen n-gram, weight of a context


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, length of each text in characters): white space as single spaces, oldest character highest."""
    squashed = [" ".join(t.split()) for t in texts]
    pad = chr(PAD) * (ORDER - 1)
    x = np.frombuffer((pad + pad.join(squashed)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x = np.where(x < 1 << BITS, x, (1 << BITS - 1) | (x & (1 << BITS - 1) - 1))
    code = np.zeros(max(0, len(x) - ORDER + 1), np.int64)
    for i in range(ORDER):
        code = (code << BITS) | x[i:len(x) - ORDER + 1 + i]
    lengths = np.array([len(t) for t in squashed], np.int64)
    keep = np.repeat(np.arange(len(texts)), lengths) * (ORDER - 1) + np.arange(lengths.sum())
    return code[keep], lengths


def portions(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= PIECE_CHARS:
            size += len(texts[end])
            end += 1
        yield at, *codes(texts[at:end])
        at = end


def tail(column: str, order: int) -> F.Column:
    """The last ``order`` characters of an n-gram code."""
    return F.col(column).bitwiseAND(F.lit((1 << BITS * order) - 1).cast("long"))


def tagged(code: F.Column, kind: int, order: int) -> F.Column:
    """A model key: code, with order and kind in the bits above the longest n-gram."""
    return code.bitwiseOR(F.lit((kind + order - (16 if kind + order > 7 else 0)) << ORDER * BITS).cast("long"))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(g, c) of the longest n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for _, code, _ in portions([t or "" for t in b.column("text").to_pylist()]):
                if len(code):
                    g, c = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

    return docs.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> DataFrame:
    """(key, value): the probability of every seen n-gram of every order and the back-off weight of every context.

    Below the longest order, counts are the numbers of distinct characters in front. A context's discount mass is its numbers
    of followers seen once, twice and more, each times its own discount.
    """
    tables: dict[int, DataFrame] = {ORDER: store(counts, "ngrams-4")}
    for k in range(ORDER - 1, 0, -1):
        # distinct characters in front: distinct longer n-grams with this tail
        tables[k] = store(tables[k + 1].groupBy(tail("g", k).alias("g")).agg(F.count("*").alias("c")), f"ngrams-{k}")
    out: list[DataFrame] = []
    lower: DataFrame | None = None
    n_chars = tables[1].count() + 1
    for k in range(1, ORDER + 1):
        t = tables[k]
        r = t.where("c <= 4").groupBy("c").agg(F.count("*").alias("m")).collect()  # at most four rows
        m = {row.c: row.m for row in r}
        n1, n2, n3, n4 = (m.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [min(0.95, max(0.05, i - (i + 1) * y * (hi / lo) if lo else 0.5 * i)) if i == 1 else min(i - 0.05, max(0.05, i - (i + 1) * y * (hi / lo) if lo else 0.5 * i))
             for i, lo, hi in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        ctx = F.shiftright("g", BITS)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = store(t.groupBy(ctx.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("mass")), f"contexts-{k}")
        back = contexts.select("h", F.col("total"), (F.col("mass") / F.col("total")).alias("back"))
        seen = t.withColumn("h", ctx).join(back, "h").select("g", ((F.col("c") - cut) / F.col("total")).alias("own"), "back")
        if lower is None:
            probs = seen.select("g", (F.col("own") + F.col("back") / n_chars).alias("p"))
        else:
            probs = seen.withColumn("s", tail("g", k - 1)).join(lower.withColumnRenamed("g", "s"), "s").select("g", (F.col("own") + F.col("back") * F.col("p")).alias("p"))
        lower = store(probs, f"probabilities-{k}")
        out.append(lower.select(tagged(F.col("g"), SEEN, k).alias("key"), F.col("p").alias("value")))
        out.append(back.select(tagged(F.col("h"), BACK, k).alias("key"), F.col("back").alias("value")))
    out.append(tables[1].limit(1).select(F.lit(0).cast("long").alias("key"), F.lit(1.0 / n_chars).alias("value")))  # order 0
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def lookups() -> F.Column:
    """(slot, key) rows that decide the probability of n-gram g."""
    rows = [F.struct(F.lit(k).alias("slot"), tagged(tail("g", k), SEEN, k).alias("key")) for k in range(1, ORDER + 1)]
    rows += [F.struct(F.lit(8 + k).alias("slot"), tagged(F.shiftright(tail("g", k), BITS), BACK, k).alias("key")) for k in range(1, ORDER + 1)]
    return F.explode(F.array(*rows))


def log_probabilities(ngrams: DataFrame, rows: DataFrame, unseen: float) -> DataFrame:
    """(g, lp): natural log probability of the last character of each n-gram; contexts never seen pass the shorter one on."""
    hits = ngrams.select("g", lookups().alias("q")).select("g", "q.*").join(rows, "key")
    slots = [F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"v{s}") for s in [*range(1, ORDER + 1), *range(9, 9 + ORDER)]]
    p = F.lit(unseen)
    for k in range(1, ORDER + 1):
        p = F.coalesce(F.col(f"v{k}"), F.coalesce(F.col(f"v{8 + k}"), F.lit(1.0)) * p)
    return hits.groupBy("g").agg(*slots).select("g", F.log(p).alias("lp"))


def asked(table: pa.Table) -> pa.Table:
    """(block, g): the distinct n-grams of a block."""
    held = np.empty(0, np.int64)
    for _, code, _ in portions([t or "" for t in table.column("text").to_pylist()]):
        held = np.unique(np.concatenate([held, np.unique(code)]))
    return pa.table({"block": pa.array(np.full(len(held), table.column("block")[0].as_py())), "g": pa.array(held)})


def answer(docs: pa.Table, known: pa.Table) -> pa.Table:
    order = np.argsort(known.column("g").to_numpy())
    g, lp = known.column("g").to_numpy()[order], known.column("lp").to_numpy()[order]
    texts = [t or "" for t in docs.column("text").to_pylist()]
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for at, code, lengths in portions(texts):
        where = np.repeat(np.arange(len(lengths)), lengths)
        values = lp[np.searchsorted(g, code)] if len(code) else np.empty(0)
        total[at:at + len(lengths)] = np.bincount(where, values, len(lengths))
        n[at:at + len(lengths)] = lengths
    return pa.table({"doc_id": docs.column("doc_id"), "row": docs.column("row"), "lang": docs.column("lang"), "n_chars": pa.array(n), "logp": pa.array(total)})


def perplexities(docs: DataFrame, rows: DataFrame, unseen: float) -> DataFrame:
    """(doc_id, row, lang, n_chars, logp) of whole texts. The texts are shuffled once, for both the questions and the answers."""
    d = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")), BLOCK_CHARS)
    wanted = d.groupBy("block").applyInArrow(asked, "block long, g long")
    lp = log_probabilities(wanted.select("g").distinct(), rows, unseen)
    # an n-gram without any row of the model has the probability of an unknown character
    known = wanted.join(lp, "g", "left").select("block", "g", F.coalesce("lp", F.lit(math.log(unseen))).alias("lp"))
    return d.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(answer, "doc_id long, row long, lang string, n_chars long, logp double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trains): trusted documents, half of them for training."""
    t = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
    return t.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("trains"))


def row_key() -> F.Column:
    """What a verdict depends on: the language and the text."""
    return F.xxhash64(F.coalesce("lang", F.lit("und")), "text")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept), a row per row of ``docs``."""
    return verdicts(docs, labels).drop("row")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``classify`` with the column ``row``, the key of the row."""
    trusted = store(trusted_ids(labels), "trusted")
    # every trusted document of the training half
    sample = store(docs.select("doc_id").join(trusted.where("trains").select("doc_id"), "doc_id").distinct(), "sample")
    few = sample.count()
    if not few:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.coalesce("lang", F.lit("und")).alias("lang"), F.lit(None).cast("long").alias("n_chars"),
                           F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    small = F.broadcast(sample) if few <= 1_000_000 else sample
    rows = store(model(count_ngrams(docs.join(small, "doc_id", "left_semi"))), "model")
    unseen = rows.where("key = 0").agg(F.max("value")).first()[0]
    scored = store(perplexities(docs, rows, unseen or 1.0), "perplexities")
    # bits of natural log per character; short texts are drawn to their language's median
    rate = -F.col("logp") / F.col("n_chars")
    judge = scored.where("n_chars > 0").join(trusted.where("NOT trains").select("doc_id"), "doc_id").withColumn("rate", rate)
    median = store(judge.groupBy("lang").agg(F.expr("percentile_approx(rate, 0.5, 10000)").alias("median")), "medians")
    whole = judge.agg(F.expr("percentile_approx(rate, 0.5, 10000)")).first()[0]
    drawn = (F.col("rate") * F.col("n_chars") + F.col("median") * PRIOR_CHARS) / (F.col("n_chars") + PRIOR_CHARS)
    ruled = judge.join(median, "lang").withColumn("drawn", drawn)
    limits = store(ruled.groupBy("lang").agg((F.expr(f"percentile_approx(drawn, {QUANTILE}, 10000)") + MARGIN).alias("limit")), "limits")
    overall = ruled.agg(F.expr(f"percentile_approx(drawn, {QUANTILE}, 10000)") + MARGIN).first()[0]
    out = scored.withColumn("rate", rate_or_null()).join(median, "lang", "left").join(limits, "lang", "left")
    out = out.withColumns({"median": F.coalesce("median", F.lit(whole).cast("double")), "limit": F.coalesce("limit", F.lit(overall).cast("double"))})
    return out.select("doc_id", "row", "lang", "n_chars", F.exp("rate").alias("perplexity"), F.exp("limit").alias("threshold"),
                      (F.coalesce(drawn <= F.col("limit"), F.col("limit").isNull())).alias("kept"))


def rate_or_null() -> F.Column:
    return F.when(F.col("n_chars") > 0, -F.col("logp") / F.col("n_chars"))
