"""Queries for positions and interval placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import positions as P
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql

L = F.lit


def S(e):
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


view_sql("v_span", rf"""SELECT doc_id, chunk_no, CAST(cs AS INTEGER) AS cs, CAST(CASE WHEN cs >= 0 THEN cs + len ELSE -1 END AS INTEGER) AS ce FROM (
  SELECT c.doc_id, c.chunk_no, length(c.text) AS len, CASE WHEN h1 <> '' AND strpos(d.text, h1) > 0 THEN strpos(d.text, h1) - 1
    WHEN h2 <> '' THEN strpos(d.text, h2) - 1 ELSE -1 END AS cs
  FROM (SELECT *, {S('text[1:100]')} AS h1, {S('text[1:50]')} AS h2 FROM v_chunk) c JOIN documents d ON d.doc_id = c.doc_id)""")
view_sql("v_count", """SELECT o.doc_id, o.title, o.chunk_no, CAST((length(c.text) - length(replace(c.text, o.title, ''))) // length(o.title) AS INTEGER) AS cnt
  FROM v_occ o JOIN v_chunk c ON c.doc_id = o.doc_id AND c.chunk_no = o.chunk_no""")
view_sql("v_fine", """SELECT e.doc_id, e.title, CAST(strpos(d.text, e.title) - 1 AS INTEGER) AS fine FROM (SELECT DISTINCT doc_id, title FROM v_occ) e JOIN documents d ON d.doc_id = e.doc_id""")
view_sql("v_pos", """SELECT m.doc_id, m.title, n_text_units, pos_first, pos_mode, pos_centroid, CASE WHEN fine >= 0 THEN fine ELSE pos_first END AS pos_first_fine,
  fine >= 0 AS fine_matched, n_text_units AS weight_count, coalesce(g.degree, 0) AS graph_degree FROM (
  SELECT doc_id, title, CAST(count(*) AS INTEGER) AS n_text_units, coalesce(min(cs) FILTER (WHERE cs >= 0), -1) AS pos_first,
    coalesce(arg_min(cs, (-cnt, cs)) FILTER (WHERE cs >= 0), -1) AS pos_mode,
    coalesce(CAST((200 * sum(cnt * cs) FILTER (WHERE cs >= 0) + sum(cnt) FILTER (WHERE cs >= 0)) // (2 * sum(cnt) FILTER (WHERE cs >= 0)) AS DOUBLE) / 100, -1) AS pos_centroid
  FROM v_count JOIN v_span USING (doc_id, chunk_no) GROUP BY doc_id, title) m
  JOIN v_fine f ON f.doc_id = m.doc_id AND f.title = m.title LEFT JOIN v_deg g ON g.doc_id = m.doc_id AND g.title = m.title""")
view_sql("v_over", """SELECT c.doc_id, c.chunk_no, s.idx AS section, least(ce, end_offset) - greatest(cs, start_offset) AS overlap
  FROM v_span c JOIN v_section s ON s.doc_id = c.doc_id AND s.start_offset < c.ce AND s.end_offset > c.cs WHERE c.cs >= 0""")
view_sql("v_assigned", """SELECT p.doc_id, p.title, s.idx AS section, 'fine_pos' AS method, CAST(1.0 AS DOUBLE) AS ratio
  FROM v_pos p ASOF JOIN v_section s ON s.doc_id = p.doc_id AND p.pos_first_fine >= s.start_offset WHERE fine_matched""")
view_sql("v_member_order", """SELECT doc_id, section, title, method, ratio, pos, pos_source, graph_degree, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY pos, pos_source, title) AS INTEGER) AS rank
  FROM (SELECT a.*, pos_first_fine AS pos, 0 AS pos_source, graph_degree FROM v_assigned a JOIN v_pos p ON p.doc_id = a.doc_id AND p.title = a.title)""")


def docs(t):
    return t("documents").select("doc_id", "text")


def build_spans(t):
    return P.chunk_spans(docs(t), X.chunk_tokens(F.col("text"), V.CHUNK, V.OVERLAP))


def build_postings(t):
    return P.postings(docs(t), V.terms(t), V.CHUNK, V.OVERLAP)


def postings(t):
    starts = P.chunk_starts(X.chunk_tokens(F.col("text"), V.CHUNK, V.OVERLAP))
    return t.stored("postings", lambda: P.postings(docs(t), V.terms(t), V.CHUNK, V.OVERLAP, starts))


def spans(t):
    return t.stored("spans", lambda: build_spans(t))


def build_members(t):
    return P.placed(postings(t), V.entities(t), V.sections(t))


def members(t):
    """Every entity of a document with its positions and section; positions, sections and rooms are read from it."""
    return t.stored("placed", lambda: build_members(t))


def positions(t):
    return members(t).where("n_text_units > 0").drop("section")


def overlapped(t, rows):
    """``rows`` of members with their sections; what has no fine position takes it from the chunks that list it."""
    return P.assign_sections(rows, lambda: (V.occurrences(t), spans(t), V.sections(t)))


def assigned(t):
    return overlapped(t, members(t))


def ordered(t):
    return P.order_members(assigned(t))


@query("chunk_spans", "SELECT * FROM v_span")
def chunk_spans(t):
    return build_spans(t)


@query("mention_counts", "SELECT * FROM v_count")
def mention_counts(t):
    return build_postings(t).select("doc_id", "title", "chunk_no", "cnt")


@query("first_occurrence", "SELECT * FROM v_fine")
def first_occurrence(t):
    return P.first_occurrence(postings(t))


@query("entity_positions", "SELECT * FROM v_pos")
def entity_positions(t):
    return build_members(t).where("n_text_units > 0").drop("section")


@query("chunk_spread", """SELECT n, one, many, zero, fine, unresolved, round(CAST(many AS DOUBLE) / n, 6) AS many_ratio, round(CAST(fine AS DOUBLE) / n, 6) AS fine_rate FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE n_text_units = 1) AS one, count(*) FILTER (WHERE n_text_units > 1) AS many, count(*) FILTER (WHERE n_text_units = 0) AS zero,
  count(*) FILTER (WHERE fine_matched) AS fine, count(*) FILTER (WHERE pos_first_fine < 0) AS unresolved FROM v_pos)""")
def chunk_spread(t):
    return P.chunk_spread(positions(t))


# markers of every fifth line; every third one is spoiled so that it stays unresolved
def spoiled(t):
    odd = F.col("idx") % 3 == 2
    return V.markers(t).withColumn("start_marker", F.when(odd, F.concat(L("~~"), "start_marker")).otherwise(F.concat(L("\t"), "start_marker", L("\n"))))


view_sql("v_spoiled", r"""SELECT doc_id, idx, name, CASE WHEN idx % 3 = 2 THEN '~~' || start_marker ELSE chr(9) || start_marker END AS m,
  regexp_replace(CASE WHEN idx % 3 = 2 THEN '~~' || start_marker ELSE start_marker END, '^\s+|\s+$', '', 'g') AS b FROM v_marker""")
view_sql("v_toc_text", "SELECT m.*, d.text FROM v_spoiled m JOIN documents d ON d.doc_id = m.doc_id")
view_sql("v_resolved", """WITH RECURSIVE r AS (SELECT doc_id, idx, name, m, CAST(0 AS INTEGER) AS off, 0 AS prev, 'forced_zero' AS strategy FROM v_toc_text WHERE idx = 0
  UNION ALL SELECT n.doc_id, n.idx, n.name, n.m, CAST(n.found AS INTEGER), CASE WHEN n.found >= 0 THEN n.found ELSE n.prev END, CASE WHEN n.how = 0 THEN 'exact' WHEN n.found >= 0 THEN 'stripped' ELSE 'unresolved' END FROM (
    SELECT t.doc_id, t.idx, t.name, t.m, r.prev, CASE WHEN strpos(t.text[r.prev + 2:], t.m) > 0 THEN 0 ELSE 1 END AS how,
      CASE WHEN strpos(t.text[r.prev + 2:], t.m) > 0 THEN strpos(t.text[r.prev + 2:], t.m) + r.prev
           WHEN t.b <> '' AND strpos(t.text[r.prev + 2:], t.b) > 0 THEN strpos(t.text[r.prev + 2:], t.b) + r.prev ELSE -1 END AS found
    FROM r JOIN v_toc_text t ON t.doc_id = r.doc_id AND t.idx = r.idx + 1) n)
  SELECT doc_id, idx, name, m AS start_marker, off AS start_offset, strategy FROM r""")


def resolved(t):
    return P.resolve_markers(spoiled(t), docs(t))


@query("resolve_markers", """SELECT r.*, CAST((length(d.text) - length(replace(d.text, start_marker, ''))) // length(start_marker) AS INTEGER) AS hits FROM v_resolved r JOIN documents d ON d.doc_id = r.doc_id""")
def resolve_markers(t):
    return resolved(t)


view_sql("v_res_span", """SELECT r.doc_id, idx, name, start_offset, coalesce(lead(start_offset) OVER (PARTITION BY r.doc_id ORDER BY idx), CAST(length(d.text) AS INTEGER)) AS end_offset
  FROM v_resolved r JOIN documents d ON d.doc_id = r.doc_id""")


@query("section_spans", """WITH f AS (SELECT doc_id, coalesce(bool_and(start_offset < nxt) FILTER (WHERE start_offset >= 0 AND nxt >= 0), true) AS monotonic,
    count(DISTINCT start_offset) FILTER (WHERE start_offset >= 0) = count(*) FILTER (WHERE start_offset >= 0) AS "distinct"
    FROM (SELECT *, lead(start_offset) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM v_resolved) GROUP BY doc_id)
  SELECT doc_id, idx, name, start_offset, end_offset, CASE WHEN start_offset >= 0 THEN greatest(0, end_offset - start_offset) ELSE 0 END AS length_chars, monotonic, "distinct" FROM v_res_span JOIN f USING (doc_id)""")
def section_spans(t):
    return P.section_spans(resolved(t), docs(t))


@query("section_asof", """SELECT doc_id, title, pos, section FROM (SELECT f.doc_id, f.title, f.fine AS pos,
  greatest(0, coalesce(min(CASE WHEN s.start_offset > f.fine THEN s.idx END) - 1, max(s.idx))) AS section FROM v_fine f JOIN v_res_span s ON s.doc_id = f.doc_id GROUP BY ALL)""")
def section_asof(t):
    fine = P.first_occurrence(postings(t))
    return P.section_asof(fine.withColumnRenamed("fine", "pos"), P.section_spans(resolved(t), docs(t)))


view_sql("v_over_best", """WITH w AS (SELECT o.doc_id, o.title, v.section, sum(v.overlap) AS w FROM v_occ o JOIN v_over v ON v.doc_id = o.doc_id AND v.chunk_no = o.chunk_no GROUP BY ALL)
  SELECT e.doc_id, e.title, coalesce(section, 0) AS section, coalesce(round(CAST(mw AS DOUBLE) / total, 4), 0) AS ratio, CAST(coalesce(total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT doc_id, title FROM v_occ) e
  LEFT JOIN (SELECT doc_id, title, arg_min(section, (-w, section)) AS section, max(w) AS mw, sum(w) AS total FROM w GROUP BY ALL) b ON b.doc_id = e.doc_id AND b.title = e.title""")


@query("span_overlap", "SELECT * FROM v_over_best")
def span_overlap(t):
    return P.overlap_sections(V.occurrences(t), spans(t), V.sections(t))


@query("assign_sections", """SELECT doc_id, title, section, method, ratio FROM v_assigned WHERE length(title) % 2 = 0
  UNION ALL SELECT doc_id, title, section, 'chunk_overlap', ratio FROM v_over_best WHERE length(title) % 2 = 1""")
def assign_sections(t):
    # titles of odd length act as surface forms that never match exactly
    rows = members(t).withColumn("fine_matched", F.col("fine_matched") & (F.length("title") % 2 == 0))
    return overlapped(t, rows).select("doc_id", "title", "section", "method", "ratio")


@query("room_sizes", """SELECT s.doc_id, 'toc_' || (s.idx + 1) AS room_id, s.idx, s.name, s.start_offset, s.end_offset, CAST(count(a.title) AS INTEGER) AS size
  FROM v_section s LEFT JOIN v_assigned a ON a.doc_id = s.doc_id AND a.section = s.idx GROUP BY ALL""")
def room_sizes(t):
    return P.rooms_with_sizes(V.sections(t), assigned(t))


@query("order_members", "SELECT * FROM v_member_order")
def order_members(t):
    return ordered(t)


@query("section_touch", """SELECT touched, count(*) AS n FROM (SELECT o.doc_id, o.title, CAST(count(DISTINCT v.section) AS INTEGER) AS touched FROM v_occ o
  LEFT JOIN v_over v ON v.doc_id = o.doc_id AND v.chunk_no = o.chunk_no GROUP BY ALL) GROUP BY touched""")
def section_touch(t):
    return P.section_touch(V.occurrences(t), spans(t), V.sections(t))


view_sql("v_chapter_hist", """SELECT o.doc_id, o.title, v.section // 3 AS chapter, count(*) AS cnt FROM v_occ o JOIN v_over v ON v.doc_id = o.doc_id AND v.chunk_no = o.chunk_no GROUP BY ALL""")
view_sql("v_dominant", """SELECT doc_id, title, arg_min(chapter, (-cnt, chapter)) AS chapter, round(CAST(max(cnt) AS DOUBLE) / sum(cnt), 4) AS ratio, CAST(sum(cnt) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS touched FROM v_chapter_hist GROUP BY ALL""")


def dominant(t):
    s = V.sections(t)
    chapters = s.groupBy("doc_id", F.floor(F.col("idx") / 3).cast("int").alias("chapter")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return P.chapter_dominant(V.occurrences(t), spans(t), s, chapters)


@query("chapter_dominant", "SELECT * FROM v_dominant")
def chapter_dominant(t):
    return dominant(t)


@query("header_sections", rf"""WITH src AS (SELECT doc_id, 'II. start' || chr(10) || replace(text, ',', ',' || chr(10) || chr(10)) || chr(10) || '3. part' || chr(10) || chr(10) || 'tail' AS text FROM documents),
  l AS (SELECT doc_id, n_text, CAST(unnest(range(len(a))) AS INTEGER) AS line, unnest(a) AS s FROM (SELECT doc_id, CAST(length(text) AS INTEGER) AS n_text, string_split(text, chr(10)) AS a FROM src)),
  m AS (SELECT *, {S('s')} AS title, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_start FROM l),
  n AS (SELECT *, coalesce(lag(title) OVER w, '') = '' AND coalesce(lead(title) OVER w, '') = '' AS alone FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
  k AS (SELECT *, CASE WHEN title = '' THEN NULL WHEN regexp_matches(title, '^[IVXLCDM]+\.\s*\S') THEN 'roman' WHEN regexp_matches(title, '^\d+\.\s*\S') THEN 'number'
    WHEN alone AND length(title) <= 30 AND NOT regexp_matches(title, '[.?!다요음오]$') AND NOT regexp_matches(title, '[,.]') THEN 'sub' END AS type FROM n),
  h AS (SELECT *, last_value(CASE WHEN type = 'roman' THEN title END IGNORE NULLS) OVER w AS roman, last_value(CASE WHEN type = 'number' THEN title END IGNORE NULLS) OVER w AS number
    FROM k WHERE type IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, line, type, title, char_start, coalesce(lead(char_start) OVER w, n_text) AS char_end,
    concat_ws(' > ', roman, CASE WHEN type <> 'roman' THEN number END, CASE WHEN type = 'sub' THEN title END) AS breadcrumb FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def header_sections(t):
    src = F.concat(L("II. start\n"), F.replace("text", L(","), L(",\n\n")), L("\n3. part\n\ntail"))
    return P.header_sections(t("documents").select("doc_id", src.alias("text")))
