"""Figure-to-entity matching, caption slots, layout boxes, lookups and room edges."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions import text as X
from inkstone.operators.blocked import matrix, product
from inkstone.operators.contains import contains_lists
from inkstone.operators.folds import fold_sorted
from inkstone.operators.graph import components
from inkstone.session import cut_lineage


def field_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys.., field, golden, other): every field that differs, rows missing on one side included."""
    x = a.select(*keys, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    y = b.select(*keys, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("golden"), F.col(f"b_{f}").alias("other")) for f in fields])
    return x.join(y, keys, "full").select(*keys, F.inline(cells)).where(~F.col("golden").eqNullSafe(F.col("other")))


# ---------------------------------------------------------------- candidates and scores

def _own_pages(hits: pa.Table, entities: pa.Table) -> pa.Table:
    """The pages of one document that hold a variant of its entities."""
    owners: dict[str, set[str]] = {}
    for title, variants in zip(entities.column("title").to_pylist(), entities.column("variants").to_pylist()):
        for v in variants or ():
            owners.setdefault(v, set()).add(title)
    held: dict[int, set[str]] = {}
    for page, found in zip(hits.column("page").to_pylist(), hits.column("variant").to_pylist()):
        held.setdefault(page, set()).update(*(owners[v] for v in found if v in owners))
    out = [(title, page) for page, titles in held.items() for title in sorted(titles)]
    return _rows(hits, [t for t, _ in out], ("title", pa.string()), ("page", pa.int32(), [p for _, p in out]))


def _rows(group: pa.Table, values: list, first: tuple, *more: tuple) -> pa.Table:
    """Rows of the document of ``group``: (doc_id, first, more..)."""
    doc = group.column("doc_id")[0].as_py() if group.num_rows else None
    return pa.table([pa.array([doc] * len(values), pa.int64()), pa.array(values, first[1]), *(pa.array(v, kind) for _, kind, v in more)],
                    names=["doc_id", first[0], *(name for name, _, _ in more)])


def entity_pages(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, title, page): pages of its own document whose body holds a surface variant.

    What a page holds travels as one list to its document, where the document's entities meet it.
    """
    variants = entities.select("doc_id", "title", X.surface_variants(F.col("title")).alias("variants"))
    every = entities.select("title").distinct().select(F.explode(X.surface_variants(F.col("title"))).alias("variant")).distinct()
    hits = contains_lists(pages, ["doc_id", "page"], "body", every, "variant")
    return hits.groupBy("doc_id").cogroup(variants.groupBy("doc_id")).applyInArrow(_own_pages, "doc_id long, title string, page int")


def _near(pages: dict[int, list], page: int, window: int) -> set:
    return {x for p in range(page - window, page + window + 1) for x in pages.get(p, ())}


def window_candidates(figures: DataFrame, ent_pages: DataFrame, window: int = 1) -> DataFrame:
    """(doc_id, row, title): entities seen within ``window`` pages; a document's figures meet its pages in one group."""
    def meet(figs: pa.Table, hits: pa.Table) -> pa.Table:
        pages: dict[int, list] = {}
        for page, title in zip(hits.column("page").to_pylist(), hits.column("title").to_pylist()):
            pages.setdefault(page, []).append(title)
        near: dict[int, set] = {}
        for row, page in zip(figs.column("row").to_pylist(), figs.column("page").to_pylist()):
            near.setdefault(row, set()).update(_near(pages, page, window) if page is not None else ())
        out = [(row, title) for row, titles in near.items() for title in sorted(titles)]
        return _rows(figs, [r for r, _ in out], ("row", pa.int32()), ("title", pa.string(), [t for _, t in out]))

    return figures.select("doc_id", "row", "page").groupBy("doc_id").cogroup(ent_pages.select("doc_id", "title", "page").groupBy("doc_id")).applyInArrow(
        meet, "doc_id long, row int, title string")


MATCHES = "doc_id long, row int, tier string, match string, score double"


def _starts(tokens: list[str], ranked: list[tuple[str, int]], names: list[str], known: set[str], owners: dict[str, list[int]]) -> set[int]:
    """Nodes with a variant that a token starts or that starts a token; ``ranked`` are (variant, node) in order of ``names``."""
    out: set[int] = set()
    for tok in tokens:
        at = bisect_left(names, tok)
        while at < len(names) and names[at].startswith(tok):
            out.add(ranked[at][1])
            at += 1
        for end in range(K.MIN_NAME_LEN, len(tok)):
            if tok[:end] in known:
                out.update(owners[tok[:end]])
    return out


NODE, PAGE, VECTOR = 0, 1, 2  # kinds of rows that meet the figures of a document


def _scored(figures: pa.Table, rest: pa.Table, window: int) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(row, titles in order, the score of each, places of those near the figure) of each figure of one document.

    The score is cosine + name bonus - hub penalty. Cosines are made once for each pair of different vectors.
    """
    kind = rest.column("kind").to_numpy()
    vectors, hits, nodes = (rest.filter(pa.array(kind == k)) for k in (VECTOR, PAGE, NODE))
    at = {v: i for i, v in enumerate(vectors.column("vec_id").to_pylist())}
    units = matrix(vectors.column("vector"))
    own = sorted((t, d, at[v], w) for t, d, v, w in zip(*(nodes.column(c).to_pylist() for c in ("title", "degree", "vec_id", "variants"))) if v in at)
    titles = [t for t, *_ in own]  # ties go to the smaller title
    degree = np.array([d for _, d, _, _ in own], np.float64)
    vec = np.array([v for _, _, v, _ in own], np.int64)
    top = degree.max(initial=0.0)
    hub = degree / top * K.HUB_PENALTY if top > 0 else np.zeros(len(titles))
    place = {t: i for i, t in enumerate(titles)}
    owners: dict[str, list[int]] = {}
    for i, (_, _, _, variants) in enumerate(own):
        for v in variants:
            owners.setdefault(v, []).append(i)
    ranked = sorted((v, i) for v, who in owners.items() for i in who)
    names = [v for v, _ in ranked]
    pages: dict[int, list[int]] = {}
    for page, title in zip(hits.column("page").to_pylist(), hits.column("title").to_pylist()):
        if title in place:
            pages.setdefault(page, []).append(place[title])
    used, index = np.unique(vec, return_inverse=True)
    for row, page, toks, v in zip(*(figures.column(c).to_pylist() for c in ("row", "page", "toks", "vec_id"))):
        cosine = product(units[at[v]:at[v] + 1], units[used])[0][index] if v in at and len(own) else np.zeros(len(own))
        score = cosine - hub
        bonus = np.array(sorted(_starts(toks or (), ranked, names, owners.keys(), owners)), np.int64)
        score[bonus] = cosine[bonus] + K.NAME_BONUS - hub[bonus]
        yield row, titles, score, np.array(sorted(_near(pages, page, window)), np.int64)


def _met(figures: DataFrame, ent_pages: DataFrame, nodes: DataFrame, vectors: DataFrame):
    """The figures of a document beside its nodes, the pages of its entities and each vector it uses, once."""
    toks = F.filter(X.words(F.col("cap_title")), lambda x: F.length(x) >= K.MIN_NAME_LEN)
    variants = F.filter(X.surface_variants(F.col("title")), lambda v: F.length(v) >= K.MIN_NAME_LEN)
    used = figures.select("doc_id", "vec_id").unionByName(nodes.select("doc_id", "vec_id")).distinct().join(vectors.select("vec_id", "vector"), "vec_id")
    rest = nodes.select("doc_id", F.lit(NODE).alias("kind"), "title", "degree", "vec_id", variants.alias("variants")).unionByName(
        ent_pages.select("doc_id", F.lit(PAGE).alias("kind"), "title", "page"), allowMissingColumns=True).unionByName(
        used.select("doc_id", F.lit(VECTOR).alias("kind"), "vec_id", "vector"), allowMissingColumns=True)
    return figures.select("doc_id", "row", "page", "vec_id", toks.alias("toks")).groupBy("doc_id").cogroup(rest.groupBy("doc_id"))


def match_score(figures: DataFrame, ent_pages: DataFrame, nodes: DataFrame, vectors: DataFrame, window: int = 1) -> DataFrame:
    """(doc_id, row, title, score) of each figure and the entities seen within ``window`` pages.

    figures(doc_id, row, page, cap_title, vec_id); ent_pages(doc_id, title, page); nodes(doc_id, title, degree, vec_id);
    vectors(vec_id, vector). No pair of figure and entity is shuffled, and no vector once for a pair.
    """
    def score(figs: pa.Table, rest: pa.Table) -> pa.Table:
        rows, names, scores = [], [], [np.zeros(0)]
        for row, titles, values, near in _scored(figs, rest, window):
            rows += [row] * len(near)
            names += [titles[i] for i in near]
            scores.append(values[near])
        return _rows(figs, rows, ("row", pa.int32()), ("title", pa.string(), names), ("score", pa.float64(), np.concatenate(scores)))

    return _met(figures, ent_pages, nodes, vectors).applyInArrow(score, "doc_id long, row int, title string, score double")


def match_cascade(figures: DataFrame, ent_pages: DataFrame, nodes: DataFrame, vectors: DataFrame,
                  local: float = K.SCORE_LOCAL, cascade: float = K.SCORE_CASCADE, window: int = 1) -> DataFrame:
    """(doc_id, row, tier, match, score): page-window pool first, then every node of the document.

    Tables as in ``match_score``, figures with caption. A figure meets the nodes of its own document in one product;
    no pair of figure and node is a row.
    """
    def settle(figs: pa.Table, rest: pa.Table) -> pa.Table:
        out = []
        for row, titles, score, near in _scored(figs, rest, window):
            best = near[score[near].argmax()] if len(near) else None
            tier = "local" if best is not None and score[best] >= local else None
            if tier is None and len(score):
                best = score.argmax()
                tier = "cascade" if score[best] >= cascade else "unplaced"
            if tier:
                out.append((row, tier, None if tier == "unplaced" else titles[best], float(score[best])))
        row, tier, match, score = list(zip(*out)) or [()] * 4
        return _rows(figs, row, ("row", pa.int32()), ("tier", pa.string(), tier), ("match", pa.string(), match), ("score", pa.float64(), score))

    tiered = _met(figures.where(X.strip(F.col("caption")) != ""), ent_pages, nodes, vectors).applyInArrow(settle, MATCHES)
    return figures.select("doc_id", "row").join(tiered, ["doc_id", "row"], "left").select(
        "doc_id", "row", F.coalesce("tier", F.lit("unplaced")).alias("tier"), "match", F.coalesce("score", F.lit(0.0)).alias("score"))


def match_collisions(matches: DataFrame) -> DataFrame:
    """One figure per node: best score wins, then row order; losers become unplaced collisions.

    The winner is an aggregate joined back, so a popular node is not ranked in one task.
    """
    win = matches.where("match is not null").groupBy("doc_id", "match").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("row").alias("row"))).alias("w")).select("doc_id", "match", F.col("w.row").alias("winner"))
    lost = F.col("winner").isNotNull() & (F.col("winner") != F.col("row"))
    return matches.join(win, ["doc_id", "match"], "left").select(
        "doc_id", "row", F.when(lost, "collision").otherwise(F.col("tier")).alias("tier"), F.when(~lost | F.col("winner").isNull(), F.col("match")).alias("match"), "score")


def attach_images(figures: DataFrame, settled: DataFrame) -> DataFrame:
    """(doc_id, row, page, title, ord, reason, score): attached figures by node, unplaced with their reason."""
    j = figures.join(settled, ["doc_id", "row"])
    w = Window.partitionBy("doc_id", "match").orderBy(F.desc("score"), "row")  # one winner per node after collisions
    placed = F.col("match").isNotNull()
    return j.select(
        "doc_id", "row", "page", F.col("match").alias("title"), F.when(placed, F.row_number().over(w)).alias("ord"),
        F.when(placed, None).when(F.col("tier") == "collision", "collision").otherwise("no_fit").alias("reason"), F.round("score", 3).alias("score"))


def match_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose match or tier changed between two runs."""
    a = old.select(*keys, F.col("match").alias("old_match"), F.col("tier").alias("old_tier"))
    b = new.select(*keys, F.col("match").alias("new_match"), F.col("tier").alias("new_tier"))
    same = F.col("old_match").eqNullSafe(F.col("new_match")) & F.col("old_tier").eqNullSafe(F.col("new_tier"))
    return a.join(b, keys).where(~same)


def slot_fill(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """i-th empty figure of a page takes the i-th unused caption of that page.

    Captions are compared without white space against those figures already carry.
    """
    def bare(c):
        return F.regexp_replace(c, r"(?U)\s+", "")

    used = figures.where("caption <> ''").select("doc_id", bare(F.col("caption")).alias("norm")).distinct()
    w = Window.partitionBy("doc_id", "page").orderBy("ord")  # the captions or figures of one page
    pool = captions.withColumn("norm", bare(F.col("text"))).join(used, ["doc_id", "norm"], "left_anti").withColumn("rn", F.row_number().over(w)).select("doc_id", "page", "rn", "text")
    empty = figures.where("caption = ''").withColumn("rn", F.row_number().over(w))
    filled = empty.join(pool, ["doc_id", "page", "rn"], "left").select("doc_id", "page", "ord", F.coalesce("text", F.lit("")).alias("caption"))
    return figures.where("caption <> ''").select("doc_id", "page", "ord", "caption").unionByName(filled)


# ---------------------------------------------------------------- layout boxes

CELL = 64


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(image, i, j, ratio): ordered pairs of overlapping boxes with intersection / smaller area.

    Boxes meet only in grid cells they share and each pair is kept in its first shared cell.
    """
    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / CELL), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / CELL))

    b = boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    p = b.select("image", "cx", "cy", F.struct("idx", "x0", "y0", "x1", "y1").alias("a"))
    q = b.select("image", "cx", "cy", F.struct("idx", "x0", "y0", "x1", "y1").alias("b"))
    lox, loy = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    w, h = F.least("a.x1", "b.x1") - lox, F.least("a.y1", "b.y1") - loy
    j = p.join(q, ["image", "cx", "cy"]).where(
        (F.col("a.idx") != F.col("b.idx")) & (w > 0) & (h > 0) & (F.col("cx") == F.floor(lox / CELL)) & (F.col("cy") == F.floor(loy / CELL)))

    def area(s: str) -> Column:
        return (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))

    return j.select("image", "a", "b", (w * h / F.greatest(F.lit(1), F.least(area("a"), area("b")))).alias("ratio"), area("a").alias("area_a"), area("b").alias("area_b"))


def merged_boxes(boxes: DataFrame, ratio: float = 0.5, keep: float = 0.25, side: int = 40) -> DataFrame:
    """Rule 1: a box over two or more others and as large as each becomes its best residual band, or is dropped.

    (image, idx, x0, y0, x1, y1, rule1) for every box; rule1 is kept, band or drop.
    """
    over = box_pairs(boxes).where(F.col("ratio") > ratio)
    u = over.groupBy("image", F.col("a.idx").alias("idx")).agg(
        F.count("*").alias("n"), F.every(F.col("area_a") >= F.col("area_b")).alias("largest"),
        F.min("b.x0").alias("ux0"), F.min("b.y0").alias("uy0"), F.max("b.x1").alias("ux1"), F.max("b.y1").alias("uy1"))
    j = boxes.join(u.where("n >= 2 and largest"), ["image", "idx"], "left")

    def band(rank: int, x0, y0, x1, y1) -> Column:
        w, h = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
        return F.when((w >= side) & (h >= side), F.struct((w * h).alias("area"), F.lit(-rank).alias("r"), F.col(x0).alias("x0"), F.col(y0).alias("y0"), F.col(x1).alias("x1"), F.col(y1).alias("y1")))

    best = F.greatest(band(0, "x0", "uy1", "x1", "y1"), band(1, "x0", "y0", "x1", "uy0"), band(2, "ux1", "y0", "x1", "y1"), band(3, "x0", "y0", "ux0", "y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    j = j.withColumn("band", F.when(F.col("n").isNotNull(), best))
    rule = F.when(F.col("n").isNull(), "kept").when(F.col("band.area") >= keep * area, "band").otherwise("drop")
    return j.withColumn("rule1", rule).select(
        "image", "idx", *[F.when(F.col("rule1") == "band", F.col(f"band.{c}")).otherwise(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")], "rule1")


def box_cleanup(boxes: DataFrame) -> DataFrame:
    """Both rules; rule 2 drops a box that a surviving larger box covers by 80 % or more.

    Only the covering pairs of an image, not its boxes, go through the ordered pass.
    """
    one = merged_boxes(boxes)
    live = one.where("rule1 <> 'drop'")
    cover = box_pairs(live).where((F.col("area_b") > F.col("area_a")) & (F.col("ratio") >= 0.8)).select("image", F.col("a.idx").alias("small"), F.col("b.idx").alias("big"))

    def ordered(key, rows):
        gone: set[int] = set()
        for _, small, big in rows:
            if big not in gone:
                gone.add(small)
        return [(key[0], i) for i in gone]

    gone = fold_sorted(cover, ["image"], ["small", "big"], ordered, "image long, idx int")
    return live.join(gone, ["image", "idx"], "left_anti")


def caption_boxes(figures: DataFrame, captions: DataFrame, cell: int = 512) -> DataFrame:
    """(image, fig, cap): nearest caption below with horizontal overlap, figures served in order, a caption given once.

    Boxes meet only in strips of ``cell`` pixels they share, a pair in the first of them. In each round every figure
    takes its best caption left if no earlier figure that is still open has that caption among its own: so it gets what
    it would get in its turn. The first open figure of an image always can, and far more do in one round.
    """
    def strips(df: DataFrame, name: str) -> DataFrame:
        return df.select("image", F.struct("idx", "x0", "y0", "x1", "y1").alias(name), F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.greatest("x0", "x1") / cell))).alias("strip"))

    left = F.greatest("f.x0", "c.x0")
    over, gap = F.least("f.x1", "c.x1") - left, F.col("c.y0") - F.col("f.y1")
    tall = F.greatest(F.lit(1), F.col("f.y1") - F.col("f.y0"))
    met = strips(figures, "f").join(strips(captions, "c"), ["image", "strip"]).where((over > 0) & (gap >= -tall * 0.5) & (F.col("strip") == F.floor(left / cell)))
    live = cut_lineage(met.select("image", F.col("f.idx").alias("fig"), F.col("c.idx").alias("cap"), F.struct(F.abs(gap).alias("gap"), (-over).alias("neg_over"), F.col("c.idx").alias("cap")).alias("choice")))
    out = live.select("image", "fig", "cap").limit(0)
    while not live.isEmpty():
        best = live.groupBy("image", "fig").agg(F.min("choice")["cap"].alias("cap"))
        first = live.groupBy("image", "cap").agg(F.min("fig").alias("first"))
        won = cut_lineage(best.join(first, ["image", "cap"]).where(F.col("fig") == F.col("first")).select("image", "fig", "cap"))
        out = out.unionByName(won)
        live = cut_lineage(live.join(won.select("image", "fig"), ["image", "fig"], "left_anti").join(won.select("image", "cap"), ["image", "cap"], "left_anti"))
    return out


def box_merge(boxes: DataFrame, gap: int, cell: int = 512) -> DataFrame:
    """(image, idx, x0, y0, x1, y1): unions of the boxes of an image, no two of them within ``gap`` of each other.

    Boxes within the gap are the edges of a graph; its connected parts become their bounding boxes, which may
    come near others, so this repeats until no edge is left. Any order of merging ends in these boxes. Candidates share
    a strip of ``cell`` pixels. Boxes are numbered by their first member.
    """
    sides = ["x0", "y0", "x1", "y1"]
    cur = cut_lineage(boxes.select(F.struct("image", "idx").alias("k"), *sides))
    while True:
        strips = cur.withColumn("strip", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") + gap) / cell))))
        a, b = strips.alias("a"), strips.alias("b")
        apart = F.greatest(F.col("a.x0") - F.col("b.x1"), F.col("b.x0") - F.col("a.x1"), F.col("a.y0") - F.col("b.y1"), F.col("b.y0") - F.col("a.y1"))
        near = a.join(b, (F.col("a.k.image") == F.col("b.k.image")) & (F.col("a.strip") == F.col("b.strip")) & (F.col("a.k") < F.col("b.k")) & (apart <= gap))
        edges = cut_lineage(near.select(F.col("a.k").alias("source"), F.col("b.k").alias("target")).distinct())
        if edges.isEmpty():
            break
        part = components(edges).select(F.col("title").alias("k"), "component")
        cur = cut_lineage(cur.join(part, "k", "left").groupBy(F.coalesce("component", "k").alias("k")).agg(
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")))
    place = F.row_number().over(Window.partitionBy("k.image").orderBy("k.idx")) - 1  # boxes of one image
    return cur.withColumn("place", place).select("k.image", F.col("place").alias("idx"), *sides)


def child_figures(figures: DataFrame, gate: float = 0.10) -> DataFrame:
    """Small figures pass; large ones drop (no box), are re-cropped (one box) or split into children.

    Needs id, page, bbox (inches), page_area, crop_w, crop_h (pixels), boxes and caption.
    """
    x0, y0, x1, y1 = (F.col("bbox")[i] for i in range(4))
    ratio = F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0) / F.col("page_area")
    n = F.size("boxes")
    kind = F.when(ratio < gate, "pass").when(n == 0, "drop").when(n == 1, "recrop").otherwise("split")
    lines = F.filter(F.transform(F.split("caption", "\n"), X.strip), lambda s: s != "")
    ppi_x, ppi_y = F.col("crop_w") / F.greatest(F.lit(1e-6), x1 - x0), F.col("crop_h") / F.greatest(F.lit(1e-6), y1 - y0)
    base = figures.select("*", kind.alias("kind"), lines.alias("lines"), ppi_x.alias("px"), ppi_y.alias("py"), x0.alias("bx"), y0.alias("by"))
    whole = base.where("kind in ('pass', 'recrop')").select(
        "id", "page", "kind", F.when(F.col("kind") == "recrop", "A").alias("false_positive_type"), "caption", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    kids = base.where("kind = 'split'").select("*", F.posexplode("boxes").alias("k", "b"))
    per_line = F.size("lines") == F.size("boxes")
    child = kids.select(
        F.concat("id", F.lit("_cv_"), (F.col("k") + 1).cast("string")).alias("id"), "page", "kind", F.lit("B").alias("false_positive_type"),
        F.when(per_line, F.get("lines", F.col("k"))).otherwise(X.strip(F.col("caption"))).alias("caption"),
        (F.col("bx") + F.col("b")[0] / F.col("px")).alias("x0"), (F.col("by") + F.col("b")[1] / F.col("py")).alias("y0"),
        (F.col("bx") + F.col("b")[2] / F.col("px")).alias("x1"), (F.col("by") + F.col("b")[3] / F.col("py")).alias("y1"))
    return whole.unionByName(child)


# ---------------------------------------------------------------- lookups and room edges

def id_lookups(refs: DataFrame, names: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Left joins id -> name per column with a default for misses: {column: (table, id, name, default)}."""
    out = refs
    for col, (table, ident, name, default) in names.items():
        t = table.select(F.col(ident).alias(col), F.col(name).alias(f"{col}_name"))
        out = out.join(t, col, "left").withColumn(f"{col}_name", F.coalesce(f"{col}_name", F.lit(default)))
    return out


def duplicate_titles(entities: DataFrame, title: str) -> DataFrame:
    return entities.groupBy(title).agg(F.count("*").alias("n")).where("n > 1")


def unique_title_lookup(entities: DataFrame, title: str) -> DataFrame:
    """Entities keyed by title; a duplicate fails the job."""
    dup = duplicate_titles(entities, title)
    msg = F.concat(F.lit("duplicate title: "), F.col(title).cast("string"))
    return entities.join(dup, title, "left").withColumn("_ok", F.when(F.col("n").isNotNull(), F.raise_error(msg)).otherwise(F.lit(True))).where("_ok").drop("n", "_ok")


def orphans(entities: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return entities.join(members.select(key).distinct(), key, "left_anti")


def room_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are kept in the same room of their document; null weights stay."""
    k = kept.select("doc_id", "section", "title", "ord")
    a = k.select("doc_id", "section", F.col("title").alias("source"), F.col("ord").alias("s_ord"))
    b = k.select("doc_id", F.col("section").alias("t_section"), F.col("title").alias("target"), F.col("ord").alias("t_ord"))
    return edges.join(a, ["doc_id", "source"]).join(b, ["doc_id", "target"]).where("section = t_section").select(
        "doc_id", "section", "source", "target", "weight", "s_ord", "t_ord")


def related(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Per kept node its neighbours in kept order; isolated nodes have none. A room keeps a bounded number."""
    e = room_edges(edges, kept)
    both = e.select("doc_id", F.col("source").alias("title"), F.struct(F.col("t_ord").alias("o"), F.col("target").alias("t")).alias("n")).unionByName(
        e.select("doc_id", F.col("target").alias("title"), F.struct(F.col("s_ord").alias("o"), F.col("source").alias("t")).alias("n")))
    n = both.groupBy("doc_id", "title").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    return kept.select("doc_id", "section", "title").join(n, ["doc_id", "title"], "left").select(
        "doc_id", "section", "title", F.coalesce(F.array_join(F.transform("ns", lambda x: x["t"]), "|"), F.lit("")).alias("related"))
