"""Positions: chunk spans, mentions, as-of and interval placement in ordered sections.

Every operator is keyed by ``doc_id``. Groups are the rows of one document, bounded by its text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators.contains import automaton, text_slices, title_shards

MAX_POS = 10**9


def chunk_spans(docs: DataFrame, chunks: Column) -> DataFrame:
    """(doc_id, chunk_no, cs, ce): located by the first 100, then 50 characters; -1 when absent.

    ``chunks`` is an expression over a row of ``docs``, an array of (chunk_no, text): each document is placed in its
    own row, so neither it nor a chunk's text is joined or copied.
    """
    def place(c: Column) -> Column:
        return F.struct(c["chunk_no"].alias("chunk_no"), _start(c).alias("cs"), F.length(c["text"]).alias("len"))

    return docs.select("doc_id", F.inline(F.transform(chunks, place))).select(
        "doc_id", "chunk_no", "cs", F.when(F.col("cs") >= 0, F.col("cs") + F.col("len")).otherwise(-1).alias("ce"))


def _start(c: Column) -> Column:
    """Where a chunk of a row's text starts in it, by its first 100, then 50 characters; -1 when absent."""
    h100, h50 = X.strip(F.substring(c["text"], 1, 100)), X.strip(F.substring(c["text"], 1, 50))
    return X.let(X.find(F.col("text"), h100), lambda at: F.when(at >= 0, at).otherwise(X.find(F.col("text"), h50))).cast("int")


def chunk_starts(chunks: Column) -> Column:
    """The starts of a row's chunks as an array, -1 when absent."""
    return F.transform(chunks, _start)


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


_LETTER: list[np.ndarray] = []
BLANKS = np.array([9, 10, 12, 13, 32], np.uint32)  # between tokens


def windows(codes: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of a text's token windows; a token keeps the blanks after it."""
    blank = np.isin(codes, BLANKS)
    tokens = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(codes) else np.empty(0, np.int64)
    first = np.arange(0, len(tokens), size - overlap)
    edges = np.r_[tokens, len(codes)]
    return tokens[first], edges[np.minimum(first + size, len(tokens))]


def disjoint(start: np.ndarray, length: int) -> int:
    """How many hits of one pattern ``length`` long don't overlap, taken from the left; ``start`` is sorted."""
    n, free = 0, -1
    for s in start.tolist():
        if s >= free:
            n, free = n + 1, s + length
    return n


def postings(docs: DataFrame, titles: DataFrame, size: int, overlap: int, starts: Column | None = None) -> DataFrame:
    """(doc_id, title, chunk_no, at, cnt, fine): the positional index of the titles over token windows.

    A row for each chunk that has a surface variant of the title as a word. ``at`` is where the first such word starts
    in the document, ``cnt`` the non-overlapping hits in the chunk summed over the variants, as words or inside words,
    ``fine`` the first offset of any variant in the document. Every text is scanned once for each shard of titles by an
    automaton of all variants; only whole numbers leave the scan. ``starts``, an expression over a row of ``docs``, gives
    an array with a number for each chunk; it is returned as ``cs``, so that no later step joins it to the index.
    """
    kinds = POSTINGS if starts is None else f"{POSTINGS}, cs int"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([] if starts is None else [starts.alias("cs")]))
    listed = titles.select("title").distinct().withColumn("v", F.explode(X.surface_variants(F.col("title"))))
    out = None
    for names in title_shards(listed, "title"):
        pairs = titles.sparkSession.createDataFrame([(n,) for n in names], "title string").select(
            "title", F.explode(X.surface_variants(F.col("title"))).alias("v")).toLocalIterator()
        place = {n: i for i, n in enumerate(names)}
        owners: dict[str, list[int]] = {}
        for r in pairs:
            owners.setdefault(r["v"], []).append(place[r["title"]])
        patterns = sorted(owners)
        found = texts.mapInArrow(_scan(names, patterns, [owners[p] for p in patterns], size, overlap), kinds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


POSTINGS = "doc_id long, title string, chunk_no int, at int, cnt int, fine int"


def _scan(names: list[str], patterns: list[str], owners: list[list[int]], size: int, overlap: int):
    lengths = np.array([len(p) for p in patterns], np.int64)
    many = np.array([len(o) for o in owners], np.int64)
    first, owner = np.concatenate([[0], np.cumsum(many)])[:-1], np.array([o for os in owners for o in os], np.int64)

    def one(text: str, made) -> tuple[np.ndarray, ...]:
        """(title, chunk, at, cnt, fine) of a text."""
        hits = np.fromiter(chain.from_iterable(made.iter(text)), np.int64)  # end and pattern in turn
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        end, pattern = hits[::2] + 1, hits[1::2]
        start = end - lengths[pattern]
        row = np.repeat(np.arange(len(end)), many[pattern])  # a hit for each title the variant belongs to
        title = owner[first[pattern[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many[pattern]) - many[pattern], many[pattern])]
        letter = np.append(letters()[codes], False)
        word = ~((letter[start - 1] & (start > 0)) | letter[end])
        listed = np.zeros(len(names), bool)
        listed[title[word[row]]] = True
        use = listed[title]  # a title that is nowhere a word has no rows
        title, row = title[use], row[use]
        fine = np.full(len(names), len(text), np.int64)
        np.minimum.at(fine, title, start[row])
        opens, closes = windows(codes, size, overlap)
        low, high = np.searchsorted(closes, end), np.searchsorted(opens, start, side="right")  # chunks that hold the whole hit
        inside = np.maximum(0, high - low)[row]
        at = np.repeat(np.arange(len(row)), inside)
        chunk = low[row][at] + np.arange(len(at)) - np.repeat(np.cumsum(inside) - inside, inside)
        title, hit = title[at], row[at]
        group, back = np.unique(title * len(opens) + chunk, return_inverse=True) if len(at) else (np.empty(0, np.int64), np.empty(0, np.int64))
        head = np.full(len(group), len(text), np.int64)
        seen = word[hit]
        np.minimum.at(head, back[seen], start[hit][seen])
        keep = head < len(text)
        use = keep[back]
        back, pattern, begin = back[use], pattern[hit][use], start[hit][use]
        order = np.argsort(back * len(patterns) + pattern, kind="stable")  # starts of a variant ascend already
        back, pattern, begin = back[order], pattern[order], begin[order]
        count = np.bincount(back, minlength=len(group))
        new = np.r_[True, (back[1:] != back[:-1]) | (pattern[1:] != pattern[:-1])] if len(back) else np.empty(0, bool)
        close = ~new & (np.r_[0, np.diff(begin)] < lengths[pattern]) if len(back) else new
        runs = np.cumsum(new) - 1
        edges = np.r_[np.flatnonzero(new), len(back)]
        for r in np.unique(runs[close]):  # only a variant that overlaps itself is counted one by one
            part = begin[edges[r]:edges[r + 1]]
            count[back[edges[r]]] -= len(part) - disjoint(part, int(lengths[pattern[edges[r]]]))
        title, chunk = group[keep] // max(1, len(opens)), group[keep] % max(1, len(opens))
        return title, chunk, head[keep], count[keep], fine[title]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table = automaton(patterns), pa.array(names, pa.string())
        for b in text_slices(batches, "text"):
            got = [one(t, made) if t else (np.empty(0, np.int64),) * 5 for t in b.column("text").to_pylist()]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(g[0]) for g in got]))
            title, *numbers = (np.concatenate(x) for x in zip(*got))
            names_out = ["doc_id", "title", "chunk_no", "at", "cnt", "fine"]
            if "cs" in b.schema.names:
                lists = b.column("cs")
                first_of = np.cumsum([0, *(x or 0 for x in pc.list_value_length(lists).to_pylist())])
                numbers.append(np.asarray(lists.flatten())[first_of[rows.to_numpy()] + numbers[0]] if len(rows) else np.empty(0, np.int32))
                names_out.append("cs")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), table.take(pa.array(title)), *(pa.array(x.astype(np.int32)) for x in numbers)], names=names_out)

    return run


def first_occurrence(index: DataFrame) -> DataFrame:
    """(doc_id, title, fine): smallest offset of any surface variant of a title the document lists."""
    return index.groupBy("doc_id", "title").agg(F.min("fine").alias("fine"))


WIDE = 1 << 31  # more than any offset


def placed(index: DataFrame, entities: DataFrame, sections: DataFrame) -> DataFrame:
    """First, modal, centroid and fine position of every entity, with the fallbacks between them, and its ``section``.

    ``index`` as ``postings`` gives it, with the starts of the chunks as ``cs``. The centroid has two decimals, halves up,
    found from whole numbers. An entity (doc_id, title, degree) without postings has ``n_text_units`` 0. ``section`` is
    the last one, in order, that starts at or before the fine position, 0 before all, null without a fine position.
    Postings, entities and sections are dealt by document once; sums and the as-of window need no other shuffle.
    """
    none = F.lit(None).cast("int")
    run = Window.partitionBy("doc_id").orderBy("idx")
    rows = index.select("doc_id", "title", none.alias("sec"), none.alias("start"), "cnt", "fine", "cs", none.alias("degree"))
    rows = rows.unionByName(entities.select("doc_id", "title", "degree"), allowMissingColumns=True).unionByName(
        sections.select("doc_id", F.col("idx").alias("sec"), F.max("start_offset").over(run).alias("start")), allowMissingColumns=True)
    found = F.col("cs") >= 0
    cs, cnt = F.when(found, F.col("cs")), F.when(found, F.col("cnt"))
    g = rows.where("doc_id IS NOT NULL").repartition("doc_id").groupBy("doc_id", "title", "sec").agg(
        F.max("start").alias("start"), F.max("degree").alias("degree"), F.count("cnt").cast("int").alias("n_text_units"), F.min("fine").alias("fine"),
        F.min(cs).alias("pos_first"), F.min(F.col("cs") - cnt.cast("long") * WIDE).alias("best"),  # most hits, then the first start
        F.sum(cnt * cs.cast("long")).alias("wsum"), F.sum(cnt).alias("w"))
    fine = F.col("fine") >= 0
    g = g.withColumn("pos", F.coalesce("start", F.when(fine, F.col("fine"))))
    w = Window.partitionBy("doc_id").orderBy("pos", F.col("sec").isNull(), "sec")
    section = F.coalesce(F.last("sec", ignorenulls=True).over(w), F.lit(0))
    return g.withColumn("section", section).where("title IS NOT NULL").select(
        "doc_id", "title", "n_text_units", F.coalesce("pos_first", F.lit(-1)).alias("pos_first"),
        F.coalesce(F.pmod("best", F.lit(WIDE)).cast("int"), F.lit(-1)).alias("pos_mode"),
        F.coalesce(F.expr("((200 * wsum + w) div (2 * w)) / 100D"), F.lit(-1.0)).alias("pos_centroid"),
        F.when(fine, F.col("fine")).otherwise(F.coalesce("pos_first", F.lit(-1))).alias("pos_first_fine"),
        F.coalesce(fine, F.lit(False)).alias("fine_matched"), F.col("n_text_units").alias("weight_count"),
        F.coalesce("degree", F.lit(0)).alias("graph_degree"), F.when(fine, F.col("section")).alias("section"))


RESOLVED = "doc_id long, idx int, name string, start_marker string, start_offset int, strategy string, hits int"


def _resolve(markers: pa.Table, docs: pa.Table) -> pa.Table:
    """The markers of one document in order: one scan finds where all of them occur, then each takes its next place."""
    rows = markers.sort_by("idx").to_pydict()
    known = sorted({m for c in ("marker", "bare") for m in rows[c] if m})
    out: list[tuple] = []
    for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        places: dict[str, list[int]] = {m: [] for m in known}
        if known and text:
            for end, i in automaton(known).iter(text):
                places[known[i]].append(end + 1 - len(known[i]))

        def after(marker: str, prev: int) -> int:
            at = places.get(marker, [])
            i = bisect_right(at, prev)
            return at[i] if i < len(at) else -1

        prev = -1
        for idx, name, marker, bare in zip(rows["idx"], rows["name"], rows["marker"], rows["bare"]):
            exact, loose = after(marker, prev), after(bare, prev)
            if idx == 0:
                at, how = 0, "forced_zero"
            else:
                at, how = (exact, "exact") if exact >= 0 else (loose, "stripped") if loose >= 0 else (-1, "unresolved")
            prev = at if at >= 0 else prev
            out.append((doc, idx, name, marker, at, how, disjoint(np.array(places.get(marker, []), np.int64), len(marker))))
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()))],
                    names=["doc_id", "idx", "name", "start_marker", "start_offset", "strategy", "hits"])


def resolve_markers(markers: DataFrame, docs: DataFrame) -> DataFrame:
    """Ordered fold per document: each marker is sought strictly after the previous resolved offset.

    (doc_id, idx, name, start_marker, start_offset, strategy, hits). A document meets its own markers once; a single
    scan of its text finds all their places, so the work grows with the text and not with text times markers.
    """
    marker = F.regexp_replace("start_marker", r"\n+\z", "")
    m = markers.select("doc_id", "idx", X.strip(F.col("name")).alias("name"), marker.alias("marker"), X.strip(marker).alias("bare"))
    return m.groupBy("doc_id").cogroup(docs.select("doc_id", "text").groupBy("doc_id")).applyInArrow(_resolve, RESOLVED)


def section_spans(resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """Ends, floored lengths, and per-document monotonic and distinct flags (unresolved ignored)."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    whole = Window.partitionBy("doc_id")
    s = resolved.join(docs.select("doc_id", F.length("text").alias("n_text")), "doc_id")
    s = s.withColumn("nxt", F.lead("start_offset").over(w)).withColumn("end_offset", F.coalesce("nxt", F.col("n_text")))
    ok = F.col("start_offset") >= 0
    step_ok = F.when(ok & (F.col("nxt") >= 0), F.col("start_offset") < F.col("nxt"))
    again = ok & (F.col("start_offset") == F.lag("start_offset").over(Window.partitionBy("doc_id").orderBy("start_offset", "idx")))
    s = s.withColumn("again", F.coalesce(again, F.lit(False)))
    return s.select(
        "doc_id", "idx", "name", "start_offset", "end_offset",
        F.when(ok, F.greatest(F.lit(0), F.col("end_offset") - F.col("start_offset"))).otherwise(0).alias("length_chars"),
        F.coalesce(F.every(step_ok).over(whole), F.lit(True)).alias("monotonic"),
        (~F.bool_or("again").over(whole)).alias("distinct"))


def section_asof(points: DataFrame, sections: DataFrame, pos: str = "pos") -> DataFrame:
    """Section of every position, by one union and one ordered window: no range join.

    The scan stops at the first start beyond the position, which is the same as an as-of match
    on the running maximum of starts. Positions before the first start fall to section 0.
    """
    run = Window.partitionBy("doc_id").orderBy("idx")
    s = sections.select("doc_id", F.max("start_offset").over(run).alias("_p"), F.col("idx").alias("_s"))
    keep = [c for c in points.columns if c != "doc_id"]
    left = points.select("doc_id", F.col(pos).alias("_p"), F.lit(None).cast("int").alias("_s"), F.struct(*keep).alias("_r"))
    right = s.select("doc_id", "_p", "_s", F.lit(None).cast(left.schema["_r"].dataType).alias("_r"))
    w = Window.partitionBy("doc_id").orderBy("_p", F.col("_r").isNotNull(), "_s")
    both = right.unionByName(left).withColumn("section", F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(0)))
    return both.where("_r is not null").select("doc_id", "_r.*", "section")


def span_overlap(chunk_pos: DataFrame, sections: DataFrame, slot: int = 4096) -> DataFrame:
    """(doc_id, chunk_no, section, overlap > 0): interval join on (document, text slot).

    Both sides are exploded to the fixed-width slots they cover and each pair is kept only in the
    first slot they share, so no pair is produced twice and no document is crossed with itself.
    """
    def slots(df, lo, hi):
        return df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(lo) / slot), F.floor((F.col(hi) - 1) / slot))))

    c = slots(chunk_pos.where("cs >= 0 and ce > cs"), "cs", "ce")
    s = slots(sections.where("start_offset >= 0 and end_offset > start_offset").select(
        "doc_id", F.col("idx").alias("section"), F.col("start_offset").alias("s0"), F.col("end_offset").alias("s1")), "s0", "s1")
    lo, hi = F.greatest("cs", "s0"), F.least("ce", "s1")
    j = c.join(s, ["doc_id", "slot"]).where((hi > lo) & (F.col("slot") == F.floor(lo / slot)))
    return j.select("doc_id", "chunk_no", "section", (hi - lo).alias("overlap"))


def overlap_sections(occ: DataFrame, spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, title, section, ratio, total): argmax overlap, smallest index on ties; none -> 0, 0.0."""
    over = occ.join(span_overlap(spans, sections), ["doc_id", "chunk_no"]).groupBy("doc_id", "title", "section").agg(F.sum("overlap").alias("w"))
    best = over.groupBy("doc_id", "title").agg(
        F.min(F.struct(-F.col("w"), F.col("section").alias("section"))).alias("b"), F.max("w").alias("mw"), F.sum("w").alias("total"))
    return occ.select("doc_id", "title").distinct().join(best, ["doc_id", "title"], "left").select(
        "doc_id", "title", F.coalesce("b.section", F.lit(0)).alias("section"),
        F.round(F.coalesce(F.col("mw") / F.col("total"), F.lit(0.0)), 4).alias("ratio"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def assign_sections(members: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """``members`` as ``placed`` gives them with section, method and ratio: by fine position if matched, else by chunk overlap.

    ``tables`` gives occurrences, spans and sections; it is only called if an entity is not matched.
    """
    fine = members.where("fine_matched").withColumns({"method": F.lit("fine_pos"), "ratio": F.lit(1.0)})
    rest = members.where("NOT fine_matched").drop("section")
    if rest.isEmpty():
        return fine
    occ, spans, sections = tables()
    listed = occ.join(rest.select("doc_id", "title"), ["doc_id", "title"], "left_semi")
    over = overlap_sections(listed, spans, sections).select("doc_id", "title", "section", F.lit("chunk_overlap").alias("method"), "ratio")
    return fine.unionByName(rest.join(over, ["doc_id", "title"]))


def rooms_with_sizes(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every section as a room with its member count, empty ones included."""
    n = assigned.groupBy("doc_id", F.col("section").alias("idx")).agg(F.count("*").cast("int").alias("size"))
    return sections.join(n, ["doc_id", "idx"], "left").select(
        "doc_id", F.concat(F.lit("toc_"), (F.col("idx") + 1).cast("string")).alias("room_id"), "idx", "name", "start_offset", "end_offset",
        F.coalesce("size", F.lit(0)).alias("size"))


def order_members(assigned: DataFrame) -> DataFrame:
    """Members of each room in reading order; the window is one section of one document."""
    pos = (F.when(F.col("fine_matched"), F.col("pos_first_fine")).when(F.col("pos_first") >= 0, F.col("pos_first")).otherwise(MAX_POS))
    src = F.when(F.col("fine_matched"), 0).when(F.col("pos_first") >= 0, 1).otherwise(2)
    j = assigned.where("n_text_units > 0").withColumns({"pos": pos, "pos_source": src})
    w = Window.partitionBy("doc_id", "section").orderBy("pos", "pos_source", "title")
    return j.select("doc_id", "section", "title", "method", "ratio", "pos", "pos_source", "graph_degree", F.row_number().over(w).alias("rank"))


def chunk_spread(positions: DataFrame) -> DataFrame:
    """One row: entities in one / many chunks, fine-match rate, unresolved count."""
    n = positions.agg(
        F.count("*").alias("n"), F.sum((F.col("n_text_units") == 1).cast("long")).alias("one"), F.sum((F.col("n_text_units") > 1).cast("long")).alias("many"),
        F.sum((F.col("n_text_units") == 0).cast("long")).alias("zero"), F.sum(F.col("fine_matched").cast("long")).alias("fine"),
        F.sum((F.col("pos_first_fine") < 0).cast("long")).alias("unresolved"))
    return n.select("*", F.round(F.col("many") / F.col("n"), 6).alias("many_ratio"), F.round(F.col("fine") / F.col("n"), 6).alias("fine_rate"))


def section_touch(occ: DataFrame, spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(touched, n): how many entities touch 0, 1, 2, .. sections by strict overlap."""
    per = occ.join(span_overlap(spans, sections), ["doc_id", "chunk_no"]).groupBy("doc_id", "title").agg(
        F.count_distinct("section").cast("int").alias("touched"))
    all_e = occ.select("doc_id", "title").distinct().join(per, ["doc_id", "title"], "left")
    return all_e.groupBy(F.coalesce("touched", F.lit(0)).alias("touched")).agg(F.count("*").alias("n"))


def chapter_dominant(occ: DataFrame, spans: DataFrame, sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """Dominant chapter per entity: section occurrences rolled up by section range, ties to the earlier.

    Ranges are exploded to section numbers first, so the range join becomes an equi join.
    """
    members = chapters.select("doc_id", "chapter", F.explode(F.sequence("lo", "hi")).alias("section"))
    hits = occ.join(span_overlap(spans, sections), ["doc_id", "chunk_no"]).groupBy("doc_id", "title", "section").agg(F.count("*").alias("cnt"))
    h = hits.join(members, ["doc_id", "section"]).groupBy("doc_id", "title", "chapter").agg(F.sum("cnt").alias("cnt"))
    return h.groupBy("doc_id", "title").agg(
        F.min(F.struct(-F.col("cnt"), F.col("chapter").alias("chapter"))).alias("b"), F.max("cnt").alias("mx"), F.sum("cnt").alias("total"),
        F.count("*").cast("int").alias("touched")).select(
        "doc_id", "title", F.col("b.chapter").alias("chapter"), F.round(F.col("mx") / F.col("total"), 4).alias("ratio"), F.col("total").cast("long").alias("total"), "touched")


def header_sections(docs: DataFrame) -> DataFrame:
    """Header lines (roman, number, short standalone) with offsets, ends and breadcrumbs.

    The two breadcrumb levels are independent forward fills: a new roman header keeps the number.
    """
    rows = docs.select("doc_id", F.length("text").alias("n_text"), F.posexplode(F.split("text", "\n")).alias("line", "s"))
    w = Window.partitionBy("doc_id").orderBy("line")
    t = X.strip(F.col("s"))
    rows = rows.select(
        "doc_id", "n_text", "line", t.alias("title"),
        F.coalesce(F.sum(F.length("s") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("char_start"))
    alone = (F.coalesce(F.lag("title").over(w), F.lit("")) == "") & (F.coalesce(F.lead("title").over(w), F.lit("")) == "")
    sentence = F.col("title").rlike(r"[.?!다요음오]$")
    kind = (
        F.when(F.col("title") == "", None).when(F.col("title").rlike(r"^[IVXLCDM]+\.\s*\S"), "roman").when(F.col("title").rlike(r"(?U)^\d+\.\s*\S"), "number")
        .when(alone & (F.length("title") <= 30) & ~sentence & ~F.col("title").rlike("[,.]"), "sub"))
    heads = rows.withColumn("type", kind).where("type is not null")
    fill = w.rowsBetween(Window.unboundedPreceding, 0)
    roman = F.last(F.when(F.col("type") == "roman", F.col("title")), ignorenulls=True).over(fill)
    number = F.last(F.when(F.col("type") == "number", F.col("title")), ignorenulls=True).over(fill)
    crumb = F.concat_ws(" > ", roman, F.when(F.col("type") != "roman", number), F.when(F.col("type") == "sub", F.col("title")))
    return heads.select(
        "doc_id", (F.row_number().over(w) - 1).alias("idx"), "line", "type", "title", "char_start",
        F.coalesce(F.lead("char_start").over(w), F.col("n_text")).alias("char_end"), crumb.alias("breadcrumb"))
