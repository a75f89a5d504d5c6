"""Queries for figure matching, layout boxes, lookups and room edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.functions import vectors as VEC
from inkstone.operators import blocked as B
from inkstone.operators import matching as M
from inkstone.operators import text_ops as O
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql
from inkstone.plans.text import paged

L = F.lit

view_sql("v_page", r"""SELECT doc_id, page, arg_max(body, ord) AS body FROM (SELECT doc_id, CAST(unnest(m) AS INTEGER) AS page, unnest(b[2:]) AS body, unnest(range(len(m))) AS ord
  FROM (SELECT doc_id, string_split_regex(text, '\[page\d+\]\n?') AS b, regexp_extract_all(text, '\[page(\d+)\]', 1) AS m FROM v_paged)) GROUP BY doc_id, page""")
view_sql("v_ent_page", "SELECT e.doc_id, e.title, p.page FROM v_ent e JOIN v_page p ON p.doc_id = e.doc_id AND contains(p.body, e.title)")


def pages(t):
    return O.split_pages(paged(t))


def build_ent_pages(t):
    return M.entity_pages(pages(t), V.entities(t).select("doc_id", "title"))


def ent_pages(t):
    return t.stored("ent_pages", lambda: build_ent_pages(t))


@query("entity_pages", "SELECT * FROM v_ent_page")
def entity_pages(t):
    return build_ent_pages(t)


# a figure per page: its caption starts the page, some captions are empty; vectors come from the embeddings
view_sql("v_figure", """SELECT f.*, e.embedding::DOUBLE[] AS cap_vec FROM (SELECT doc_id, page AS row, page, CASE WHEN (doc_id + page) % 6 = 0 THEN '' ELSE string_split(body, chr(10))[1] END AS caption, CASE WHEN (doc_id + page) % 6 = 0 THEN '' ELSE string_split(body, chr(10))[1] END AS cap_title,
  (doc_id * 3 + page) % (SELECT count(*) FROM embeddings) AS vec_id FROM v_page) f JOIN embeddings e ON e.vec_id = f.vec_id""")
view_sql("v_node", "SELECT n.doc_id, n.title, n.degree, e.embedding::DOUBLE[] AS ent_vec FROM v_ent n JOIN embeddings e ON e.vec_id = (length(n.title) * 31 + n.doc_id) % (SELECT count(*) FROM embeddings)")
view_sql("v_fig_cand", "SELECT DISTINCT f.doc_id, f.row, e.title FROM v_figure f JOIN v_ent_page e ON e.doc_id = f.doc_id AND abs(e.page - f.page) <= 1")


def figures(t):
    return t.stored("figures", lambda: build_figures(t))


def build_figures(t):
    cap = F.when((F.col("doc_id") + F.col("page")) % 6 == 0, "").otherwise(F.substring_index("body", "\n", 1))
    n = t("embeddings").count()
    f = pages(t).select("doc_id", F.col("page").alias("row"), "page", cap.alias("caption"), cap.alias("cap_title"), ((F.col("doc_id") * 3 + F.col("page")) % n).alias("vec_id"))
    return f.join(t("embeddings").select("vec_id"), "vec_id")


def nodes(t):
    return V.entities(t).select("doc_id", "title", "degree", ((F.length("title") * 31 + F.col("doc_id")) % t("embeddings").count()).alias("vec_id"))


def vectors(t):
    return t("embeddings").select("vec_id", F.col("embedding").alias("vector"))


@query("page_window_candidates", "SELECT * FROM v_fig_cand")
def page_window_candidates(t):
    return M.window_candidates(figures(t), ent_pages(t))


TOK = r"list_filter(string_split_regex(cap_title, '\s+'), lambda x: length(x) >= 2)"
SCORE = rf"""coalesce(list_cosine_similarity(cap_vec, ent_vec), 0) + CASE WHEN length(title) >= 2 AND len(list_filter({TOK}, lambda x: starts_with(x, title) OR starts_with(title, x))) > 0 THEN 0.5 ELSE 0 END
  - CASE WHEN max_degree > 0 THEN CAST(degree AS DOUBLE) / max_degree * 0.1 ELSE 0 END"""
view_sql("v_maxd", "SELECT doc_id, max(degree) AS max_degree FROM v_node GROUP BY doc_id")
view_sql("v_all_score", f"SELECT doc_id, row, title, caption, {SCORE} AS score FROM (SELECT f.*, n.title, n.degree, n.ent_vec, m.max_degree FROM v_figure f JOIN v_node n ON n.doc_id = f.doc_id JOIN v_maxd m ON m.doc_id = f.doc_id)")
view_sql("v_win_score", "SELECT s.* FROM v_all_score s SEMI JOIN v_fig_cand c ON c.doc_id = s.doc_id AND c.row = s.row AND c.title = s.title")


@query("match_score", "SELECT doc_id, row, title, round(score, 6) AS score FROM v_win_score")
def match_score(t):
    return M.match_score(figures(t), ent_pages(t), nodes(t), vectors(t)).select("doc_id", "row", "title", F.round("score", 6).alias("score"))


def _match_sql(local: float, cascade: float) -> str:
    return f"""SELECT doc_id, row, CASE WHEN b1.score >= {local} THEN 'local' WHEN b2.score >= {cascade} THEN 'cascade' ELSE 'unplaced' END AS tier,
  CASE WHEN b1.score >= {local} THEN b1.title WHEN b2.score >= {cascade} THEN b2.title END AS match, coalesce(CASE WHEN b1.score >= {local} THEN b1.score ELSE b2.score END, 0) AS score
  FROM (SELECT DISTINCT doc_id, row FROM v_figure) f LEFT JOIN (SELECT doc_id, row, arg_min(title, (-score, title)) AS title, max(score) AS score FROM v_win_score WHERE trim(caption) <> '' GROUP BY ALL) b1 USING (doc_id, row)
  LEFT JOIN (SELECT doc_id, row, arg_min(title, (-score, title)) AS title, max(score) AS score FROM v_all_score WHERE trim(caption) <> '' GROUP BY ALL) b2 USING (doc_id, row)"""


view_sql("v_match", _match_sql(0.45, 0.55))
view_sql("v_match_low", _match_sql(0.25, 0.6))
view_sql("v_settled", """SELECT doc_id, row, CASE WHEN match IS NOT NULL AND rn > 1 THEN 'collision' ELSE tier END AS tier, CASE WHEN rn = 1 THEN match END AS match, score
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, match ORDER BY score DESC, row) AS rn FROM v_match)""")


def matched(t):
    return t.stored("matched", lambda: build_matched(t))


def build_matched(t, local=0.45, cascade=0.55):
    return M.match_cascade(figures(t), ent_pages(t), nodes(t), vectors(t), local, cascade)


@query("match_cascade", "SELECT doc_id, row, tier, match, round(score, 6) AS score FROM v_match")
def match_cascade(t):
    return build_matched(t).withColumn("score", F.round("score", 6))


@query("match_collisions", "SELECT doc_id, row, tier, match, round(score, 6) AS score FROM v_settled")
def match_collisions(t):
    return M.match_collisions(matched(t)).withColumn("score", F.round("score", 6))


@query("attach_images", """SELECT s.doc_id, s.row, s.row AS page, match AS title, CAST(CASE WHEN match IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, match ORDER BY score DESC, row) END AS INTEGER) AS ord,
  CASE WHEN match IS NULL THEN CASE WHEN tier = 'collision' THEN 'collision' ELSE 'no_fit' END END AS reason, round(score, 3) AS score FROM v_settled s""")
def attach_images(t):
    return M.attach_images(figures(t).select("doc_id", "row", "page"), M.match_collisions(matched(t)))


@query("match_diff", """SELECT a.doc_id, a.row, a.match AS old_match, a.tier AS old_tier, b.match AS new_match, b.tier AS new_tier FROM v_match a JOIN v_match_low b ON a.doc_id = b.doc_id AND a.row = b.row
  WHERE a.match IS DISTINCT FROM b.match OR a.tier <> b.tier""")
def match_diff(t):
    return M.match_diff(matched(t), build_matched(t, 0.25, 0.6), ["doc_id", "row"])


view_sql("v_cap_line", "SELECT doc_id, line % 5 AS page, line AS ord, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS text FROM v_line")
view_sql("v_fig_line", "SELECT doc_id, page, ord, CASE WHEN ord % 3 = 0 THEN replace(text, ' ', '  ') ELSE '' END AS caption FROM v_cap_line")


@query("slot_fill", r"""WITH u AS (SELECT DISTINCT doc_id, regexp_replace(caption, '\s+', '', 'g') AS norm FROM v_fig_line WHERE caption <> ''),
  p AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, page ORDER BY ord) AS rn FROM v_cap_line c ANTI JOIN u ON u.doc_id = c.doc_id AND u.norm = regexp_replace(c.text, '\s+', '', 'g')),
  e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM v_fig_line WHERE caption = '')
  SELECT doc_id, page, ord, caption FROM v_fig_line WHERE caption <> '' UNION ALL SELECT e.doc_id, e.page, e.ord, coalesce(p.text, '') FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.page = e.page AND p.rn = e.rn""")
def slot_fill(t):
    from inkstone.functions import text as X

    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "s"))
    caps = rows.select("doc_id", (F.col("ord") % 5).alias("page"), "ord", X.strip(F.col("s")).alias("text"))
    figs = caps.select("doc_id", "page", "ord", F.when(F.col("ord") % 3 == 0, F.replace("text", L(" "), L("  "))).otherwise("").alias("caption"))
    return M.slot_fill(figs, caps)


# boxes: one image per order, one box per line
view_sql("v_box", """SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS idx, CAST(l_partkey % 20 * 10 AS INTEGER) AS x0, CAST(l_suppkey % 10 * 10 AS INTEGER) AS y0,
  CAST(l_partkey % 20 * 10 + 20 + l_quantity * 4 AS INTEGER) AS x1, CAST(l_suppkey % 10 * 10 + 20 + l_quantity * 3 AS INTEGER) AS y1 FROM lineitem""")


def boxes(t):
    x, y = F.col("l_partkey") % 20 * 10, F.col("l_suppkey") % 10 * 10
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")  # one order
    return t("lineitem").select(
        F.col("l_orderkey").alias("image"), F.row_number().over(w).alias("idx"), x.cast("int").alias("x0"), y.cast("int").alias("y0"),
        (x + 20 + F.col("l_quantity") * 4).cast("int").alias("x1"), (y + 20 + F.col("l_quantity") * 3).cast("int").alias("y1"))


view_sql("v_box_pair", """SELECT a.image, a.idx, b.x0, b.y0, b.x1, b.y1, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / CAST(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS DOUBLE) AS ratio
  FROM v_box a JOIN v_box b ON b.image = a.image AND b.idx <> a.idx AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")


FLAGS = """WITH u AS (SELECT image, idx, min(x0) AS ux0, min(y0) AS uy0, max(x1) AS ux1, max(y1) AS uy1 FROM v_box_pair WHERE ratio > 0.5 GROUP BY ALL HAVING count(*) >= 2 AND bool_and(area_a >= area_b)),
  b AS (SELECT v_box.*, u.ux0, (x1 - x0) * (y1 - y0) AS area, unnest([0, 1, 2, 3]) AS r, unnest([x0, x0, ux1, x0]) AS bx0, unnest([uy1, y0, y0, y0]) AS by0, unnest([x1, x1, x1, ux0]) AS bx1, unnest([y1, uy0, y1, y1]) AS by1 FROM v_box JOIN u ON u.image = v_box.image AND u.idx = v_box.idx),
  g AS (SELECT *, (bx1 - bx0) * (by1 - by0) AS barea FROM b WHERE bx1 - bx0 >= 40 AND by1 - by0 >= 40), m AS (SELECT *, row_number() OVER (PARTITION BY image, idx ORDER BY barea DESC, r) AS rn FROM g QUALIFY rn = 1)
  SELECT v.image, v.idx, CASE WHEN m.barea >= 0.25 * m.area THEN bx0 ELSE v.x0 END AS x0, CASE WHEN m.barea >= 0.25 * m.area THEN by0 ELSE v.y0 END AS y0, CASE WHEN m.barea >= 0.25 * m.area THEN bx1 ELSE v.x1 END AS x1,
  CASE WHEN m.barea >= 0.25 * m.area THEN by1 ELSE v.y1 END AS y1, CASE WHEN u.idx IS NULL THEN 'kept' WHEN m.barea >= 0.25 * m.area THEN 'band' ELSE 'drop' END AS rule1
  FROM v_box v LEFT JOIN u ON u.image = v.image AND u.idx = v.idx LEFT JOIN m ON m.image = v.image AND m.idx = v.idx"""
view_sql("v_box_flag", FLAGS)


@query("box_merge_flags", FLAGS)
def box_merge_flags(t):
    return M.merged_boxes(boxes(t))


@query("box_cleanup", """WITH RECURSIVE l AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM v_box_flag WHERE rule1 <> 'drop'),
  c AS (SELECT a.image, list({'small': a.idx, 'big': b.idx} ORDER BY a.idx, b.idx) AS p FROM l a JOIN l b ON b.image = a.image AND b.idx <> a.idx AND b.area > a.area AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
    AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.8 * greatest(1, least(a.area, b.area)) GROUP BY a.image),
  r AS (SELECT image, p, 1 AS k, CAST([] AS INTEGER[]) AS gone FROM c UNION ALL SELECT image, p, k + 1, CASE WHEN list_contains(gone, p[k].big) THEN gone ELSE list_append(gone, p[k].small) END FROM r WHERE k <= len(p))
  SELECT image, idx, x0, y0, x1, y1, rule1 FROM l ANTI JOIN (SELECT image, unnest(gone) AS idx FROM r WHERE k > len(p)) g USING (image, idx)""")
def box_cleanup(t):
    return M.box_cleanup(boxes(t))


view_sql("v_cap_choice", """SELECT f.image, f.idx AS fig, list(c.idx ORDER BY abs(c.y1 + 5 - f.y1), greatest(f.x0, c.x0) - least(f.x1, c.x1), c.idx) FILTER (c.idx IS NOT NULL) AS caps
  FROM v_box f LEFT JOIN v_box c ON c.image = f.image AND c.idx % 2 = 0 AND least(f.x1, c.x1) > greatest(f.x0, c.x0) AND c.y1 + 5 - f.y1 >= -0.5 * greatest(1, f.y1 - f.y0) GROUP BY f.image, f.idx""")


@query("caption_box_match", """WITH RECURSIVE r AS (SELECT DISTINCT image, 0 AS fig, CAST(NULL AS INTEGER) AS cap, CAST([] AS INTEGER[]) AS used FROM v_box
  UNION ALL SELECT n.image, n.fig, n.cap, CASE WHEN n.cap IS NULL THEN n.used ELSE list_append(n.used, n.cap) END FROM (
    SELECT p.image, p.fig, r.used, list_filter(coalesce(p.caps, []), lambda x: NOT list_contains(r.used, x))[1] AS cap FROM r JOIN v_cap_choice p ON p.image = r.image AND p.fig = r.fig + 1) n)
  SELECT image, fig, cap FROM r WHERE cap IS NOT NULL""")
def caption_box_match(t):
    b = boxes(t)
    caps = b.where(F.col("idx") % 2 == 0).select("image", "idx", "x0", (F.col("y1") + 5).alias("y0"), "x1", (F.col("y1") + 25).alias("y1"))
    return M.caption_boxes(b, caps)


NEAR = "greatest(a.x0 - b.x1, b.x0 - a.x1, a.y0 - b.y1, b.y0 - a.y1) <= 4"


@query("box_merge", f"""WITH RECURSIVE r AS (SELECT image, list({{'idx': idx, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY idx) AS l, 0 AS step FROM v_box GROUP BY image
  UNION ALL SELECT image, list_append(list_filter(l, lambda x: x.idx <> p.a.idx AND x.idx <> p.b.idx),
      {{'idx': p.a.idx, 'x0': least(p.a.x0, p.b.x0), 'y0': least(p.a.y0, p.b.y0), 'x1': greatest(p.a.x1, p.b.x1), 'y1': greatest(p.a.y1, p.b.y1)}}), step + 1
    FROM (SELECT image, l, step, flatten(list_transform(l, lambda a: list_transform(list_filter(l, lambda b: a.idx < b.idx AND {NEAR}), lambda b: {{'a': a, 'b': b}})))[1] AS p FROM r) WHERE p IS NOT NULL)
  SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY u.idx) - 1 AS INTEGER) AS idx, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1 FROM (SELECT image, unnest(l) AS u FROM (SELECT image, arg_max(l, step) AS l FROM r GROUP BY image))""")
def box_merge(t):
    return M.box_merge(boxes(t), 4)


@query("child_figures", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS k, 'f' || l_orderkey || '_' || l_linenumber AS id, l_linenumber AS page, l_discount * 10 AS x0, l_tax * 10 AS y0, l_discount * 10 + 1 + l_quantity / 10 AS x1, l_tax * 10 + 1 + l_quantity / 10 AS y1,
    CAST(l_linenumber % 4 AS INTEGER) AS n, 'a' || l_partkey || chr(10) || CASE WHEN l_linenumber % 4 = 2 THEN 'b' ELSE '' END AS caption FROM lineitem),
  k AS (SELECT *, CASE WHEN (x1 - x0) * (y1 - y0) / 100 < 0.1 THEN 'pass' WHEN n = 0 THEN 'drop' WHEN n = 1 THEN 'recrop' ELSE 'split' END AS kind FROM f),
  c AS (SELECT *, unnest(range(n)) AS i FROM k WHERE kind = 'split')
  SELECT id, page, kind, CASE WHEN kind = 'recrop' THEN 'A' END AS false_positive_type, caption, x0, y0, x1, y1 FROM k WHERE kind IN ('pass', 'recrop')
  UNION ALL SELECT id || '_cv_' || (i + 1), page, kind, 'B', CASE WHEN n = 2 THEN string_split(caption, chr(10))[i + 1] ELSE trim(replace(caption, chr(10), ' ')) END,
    x0 + (i * 100) / (1000 / (x1 - x0)), y0 + 0 / (800 / (y1 - y0)), x0 + (i * 100 + 90) / (1000 / (x1 - x0)), y0 + 200 / (800 / (y1 - y0)) FROM c""")
def child_figures(t):
    x0, y0, q = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10
    n = (F.col("l_linenumber") % 4).cast("int")
    one = F.transform(F.sequence(L(1), n), lambda i: F.array((i - 1) * 100, L(0), (i - 1) * 100 + 90, L(200)))
    f = t("lineitem").select(
        F.concat(L("f"), F.col("l_orderkey").cast("string"), L("_"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_linenumber").alias("page"),
        F.array(x0, y0, x0 + 1 + q, y0 + 1 + q).alias("bbox"), L(100.0).alias("page_area"), L(1000.0).alias("crop_w"), L(800.0).alias("crop_h"),
        F.when(n == 0, F.array().cast("array<array<int>>")).otherwise(one).alias("boxes"),
        F.concat(L("a"), F.col("l_partkey").cast("string"), L("\n"), F.when(n == 2, "b").otherwise("")).alias("caption"))
    return M.child_figures(f)


@query("id_lookups", """SELECT o_orderkey, o_custkey, coalesce(c_name, 'unknown') AS o_custkey_name, s AS supp, coalesce(s_name, 'unknown') AS supp_name, CASE WHEN s % 9 = 0 THEN NULL ELSE n END AS community, coalesce(CASE WHEN s % 9 <> 0 THEN n_name END, 'none') AS community_name
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % (SELECT count(*) * 3 // 2 FROM supplier) AS s, CAST(o_orderkey % 30 AS INTEGER) AS n FROM orders) o LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = s LEFT JOIN nation ON n_nationkey = n""")
def id_lookups(t):
    # all suppliers and nations are looked up, and some keys that have none
    s, n = F.col("o_orderkey") % (t("supplier").count() * 3 // 2), (F.col("o_orderkey") % 30).cast("int")
    # a negative community means none
    comm = F.when(s % 9 == 0, L(-1)).otherwise(n)
    refs = t("orders").select("o_orderkey", "o_custkey", s.alias("supp"), F.when(comm >= 0, comm).alias("community"))
    return M.id_lookups(refs, {
        "o_custkey": (t("customer").where("c_acctbal > 0"), "c_custkey", "c_name", "unknown"),
        "supp": (t("supplier"), "s_suppkey", "s_name", "unknown"), "community": (t("nation"), "n_nationkey", "n_name", "none")})


@query("unique_title_lookup", "SELECT p_name AS title, count(*) AS n, true AS unique_when_keyed FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_title_lookup(t):
    dup = M.duplicate_titles(t("part").select(F.col("p_name").alias("title")), "title")
    keyed = t("part").select(F.concat("p_name", L("#"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_name").alias("title"))
    ok = M.unique_title_lookup(keyed, "k").groupBy("title").agg(F.count("*").alias("m"))
    return dup.join(ok, "title").select("title", "n", (F.col("m") == F.col("n")).alias("unique_when_keyed"))


@query("orphans", """SELECT 'no_edge' AS kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v_term), 2) AS pct FROM v_term ANTI JOIN (SELECT source AS title FROM v_graph UNION SELECT target FROM v_graph) USING (title)
  UNION ALL SELECT 'degree_0', count(*) FILTER (WHERE degree = 0), round(100.0 * count(*) FILTER (WHERE degree = 0) / count(*), 2) FROM v_ent""")
def orphans(t):
    ends = V.graph(t).select(F.explode(F.array("source", "target")).alias("title"))
    terms = V.terms(t)
    lone = M.orphans(terms, ends, "title").agg(F.count("*").alias("n")).join(F.broadcast(terms.agg(F.count("*").alias("m"))))  # one row each
    zero = V.entities(t).agg(F.count_if(F.col("degree") == 0).alias("n"), F.count("*").alias("m"))
    pct = F.round(L(100.0) * F.col("n") / F.col("m"), 2).alias("pct")
    return lone.select(L("no_edge").alias("kind"), "n", pct).unionByName(zero.select(L("degree_0").alias("kind"), "n", pct))


view_sql("v_vec", "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings")
view_sql("v_unit_dim", "SELECT vec_id, label, unnest(range(64)) AS i, unnest(v) AS x, unnest(v) / sqrt(list_dot_product(v, v)) AS u FROM v_vec")


@query("orphan_home", """WITH c AS (SELECT flag, label, list(x ORDER BY i) AS c FROM (SELECT flag, label, i, avg(CASE WHEN flag THEN u ELSE x END) AS x FROM v_unit_dim, (VALUES (true), (false)) f(flag) WHERE vec_id % 10 <> 0 GROUP BY ALL) GROUP BY ALL)
  SELECT v.vec_id, c.flag AS normalize_first, arg_min(c.label, (-list_cosine_similarity(v.v, c.c), c.label)) AS home, round(max(list_cosine_similarity(v.v, c.c)), 6) AS sim FROM v_vec v, c WHERE v.vec_id % 10 = 0 GROUP BY ALL""")
def orphan_home(t):
    e = t("embeddings")
    home = None
    for flag in (False, True):
        c = VEC.mean_vectors(e.where(F.col("vec_id") % 10 != 0), "label", "embedding", flag)
        one = B.nearest(e.where(F.col("vec_id") % 10 == 0).select("vec_id", "embedding"), "embedding", c, "label").select(
            "vec_id", L(flag).alias("normalize_first"), "home", F.round("sim", 6).alias("sim"))
        home = one if home is None else home.unionByName(one)
    return home


@query("room_edges", """WITH k AS (SELECT doc_id, section, title, rank AS ord FROM v_room WHERE status = 'kept'),
  e AS (SELECT e.doc_id, a.section, e.source, e.target, a.ord AS so, b.ord AS t_o FROM v_edge e JOIN k a ON a.doc_id = e.doc_id AND a.title = e.source JOIN k b ON b.doc_id = e.doc_id AND b.title = e.target WHERE a.section = b.section),
  n AS (SELECT doc_id, source AS title, target AS x, t_o AS o FROM e UNION SELECT doc_id, target, source, so FROM e)
  SELECT k.doc_id, k.section, k.title, coalesce(string_agg(n.x, '|' ORDER BY n.o, n.x), '') AS related FROM k LEFT JOIN n ON n.doc_id = k.doc_id AND n.title = k.title GROUP BY ALL""")
def room_edges(t):
    kept = V.rooms(t).where("status = 'kept'").select("doc_id", "section", "title", F.col("rank").alias("ord"))
    return M.related(V.edges(t), kept)
