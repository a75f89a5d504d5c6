"""Queries for set operations and room merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import aggregates as A
from inkstone.operators import sets as U
from inkstone.operators import stability as ST
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql

L = F.lit


def s(c):
    return F.col(c).cast("string")


@query("evidence_union", """WITH f AS (SELECT community, title, unnest(range(2)) AS i FROM v_report),
  u AS (SELECT 'entity' AS kind, 'doc ' || doc_id AS source, title, type AS topic, 'frequency ' || frequency AS text FROM v_ent
  UNION ALL SELECT 'relationship', 'doc ' || doc_id, source || ' - ' || target, 'relationship', 'weight ' || CAST(CAST(weight AS BIGINT) AS VARCHAR) FROM v_edge
  UNION ALL SELECT 'finding', 'report ' || community, title, 'finding', 'finding ' || (i + 1) FROM f
  UNION ALL SELECT 'community_report', 'report ' || community, title, 'level ' || level, summary FROM v_report
  UNION ALL SELECT 'document', source, 'doc ' || doc_id, lang, text FROM documents
  UNION ALL SELECT 'text_unit', 'doc ' || doc_id, 'chunk ' || chunk_no, 'text_unit', text FROM v_chunk
  UNION ALL SELECT 'community', 'level ' || level, title, 'community', CASE WHEN parent >= 0 THEN 'under ' || parent ELSE '' END FROM v_community)
  SELECT * FROM u WHERE trim(title) <> '' AND trim(text) <> ''""")
def evidence_union(t):
    r, doc = V.reports(t), F.concat(L("doc "), s("doc_id"))
    ents = V.entities(t).select(L("entity").alias("kind"), doc.alias("source"), "title", F.col("type").alias("topic"), F.concat(L("frequency "), s("frequency")).alias("text"))
    rels = V.edges(t).select(L("relationship").alias("kind"), doc.alias("d"), F.concat("source", L(" - "), "target").alias("title"), L("relationship").alias("topic"),
                             F.concat(L("weight "), F.col("weight").cast("long").cast("string")).alias("text")).withColumnRenamed("d", "source")
    rep = F.concat(L("report "), s("community"))
    find = r.select(L("finding").alias("kind"), rep.alias("source"), "title", L("finding").alias("topic"), F.explode(F.array(L("finding 1"), L("finding 2"))).alias("text"))
    reps = r.select(L("community_report").alias("kind"), rep.alias("source"), "title", F.concat(L("level "), s("level")).alias("topic"), F.col("summary").alias("text"))
    docs = t("documents").select(L("document").alias("kind"), "source", doc.alias("title"), F.col("lang").alias("topic"), "text")
    tus = V.chunks(t).select(L("text_unit").alias("kind"), doc.alias("source"), F.concat(L("chunk "), s("chunk_no")).alias("title"), L("text_unit").alias("topic"), "text")
    comm = V.communities(t).select(L("community").alias("kind"), F.concat(L("level "), s("level")).alias("source"), "title", L("community").alias("topic"),
                                   F.when(F.col("parent") >= 0, F.concat(L("under "), s("parent"))).otherwise("").alias("text"))
    return U.evidence_union([ents, rels, find, reps, docs, tus, comm])


@query("kept_union_demoted", """SELECT room, title, 'kept' AS status FROM (SELECT DISTINCT room, title FROM v_vote WHERE keep) UNION ALL
  SELECT room, title, 'demoted' FROM (SELECT DISTINCT room, title FROM v_vote) ANTI JOIN (SELECT DISTINCT room, title FROM v_vote WHERE keep) USING (room, title)""")
def kept_union_demoted(t):
    v = V.votes(t)
    kept = v.where("keep").select("room", "title").distinct()
    return kept.withColumn("status", L("kept")).unionByName(U.demoted_rest(v, kept, ["room", "title"]).withColumn("status", L("demoted")))


@query("keyed_replace", """WITH o AS (SELECT stage AS method, CAST(sum(prompt_tokens) AS BIGINT) AS tokens, count(*) AS calls, 'old' AS age FROM v_usage WHERE stage <> 'stage3' GROUP BY 1),
  n AS (SELECT stage AS method, CAST(sum(completion_tokens) AS BIGINT) AS tokens, CASE WHEN stage = 'stage3' THEN NULL ELSE count(*) END AS calls, 'new' AS age FROM v_usage WHERE stage IN ('stage1', 'stage3') GROUP BY stage),
  m AS (SELECT * FROM o WHERE method NOT IN (SELECT method FROM n) UNION ALL SELECT * FROM n)
  SELECT * FROM m UNION ALL SELECT 'TOTAL', CAST(CASE WHEN count(tokens) = count(*) THEN sum(tokens) END AS BIGINT), CAST(CASE WHEN count(calls) = count(*) THEN sum(calls) END AS BIGINT), NULL FROM m""")
def keyed_replace(t):
    u = V.usage(t).withColumnRenamed("stage", "method")
    old = u.where("method <> 'stage3'").groupBy("method").agg(F.sum("prompt_tokens").alias("tokens"), F.count("*").alias("calls")).withColumn("age", L("old"))
    new = u.where("method in ('stage1', 'stage3')").groupBy("method").agg(F.sum("completion_tokens").alias("tokens"), F.count("*").alias("n")).select(
        "method", "tokens", F.when(F.col("method") != "stage3", F.col("n")).alias("calls"), L("new").alias("age"))
    m = U.keyed_replace(old, new, "method")
    return m.unionByName(U.strict_total(m, ["tokens", "calls"]).select(L("TOTAL").alias("method"), "tokens", "calls", L(None).cast("string").alias("age")))


view_sql("v_kept_n", "SELECT s.doc_id, s.idx, count(r.title) FILTER (WHERE r.status = 'kept') AS kept_n, count(r.title) FILTER (WHERE r.status = 'demoted') AS demoted_n FROM v_section s LEFT JOIN v_room r ON r.doc_id = s.doc_id AND r.section = s.idx GROUP BY ALL")


@query("absorb_rooms", """WITH RECURSIVE s AS (SELECT doc_id, list({'lo': idx, 'host': idx, 'n': kept_n} ORDER BY idx) AS l, 0 AS step FROM v_kept_n GROUP BY doc_id
  UNION ALL SELECT doc_id, CASE WHEN i > 1 THEN list_concat(list_append(l[:i - 2], {'lo': l[i - 1].lo, 'host': l[i - 1].host, 'n': l[i - 1].n + l[i].n}), l[i + 1:])
      ELSE list_prepend({'lo': l[1].lo, 'host': l[2].host, 'n': l[1].n + l[2].n}, l[3:]) END, step + 1
    FROM (SELECT *, list_min(list_transform(l, lambda x: x.n)) AS least_n, list_position(list_transform(l, lambda x: x.n), list_min(list_transform(l, lambda x: x.n))) AS i FROM s) WHERE len(l) > 1 AND (len(l) > 10 OR least_n < 2)),
  f AS (SELECT doc_id, x.lo AS lo, x.host AS host, new_id FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS new_id FROM (SELECT doc_id, arg_max(l, step) AS l FROM s GROUP BY doc_id)))
  SELECT r.doc_id, CAST(new_id AS INTEGER) AS new_id, host, section, title, status, CAST(row_number() OVER (PARTITION BY r.doc_id, new_id, status ORDER BY section, rank) AS INTEGER) AS rank
  FROM v_room r ASOF JOIN f ON f.doc_id = r.doc_id AND r.section >= f.lo""")
def absorb_rooms(t):
    return U.absorb_rooms(V.rooms(t), V.sections(t), min_kept=2, max_rooms=10)


@query("absorb_empty", """WITH h AS (SELECT k.doc_id, k.idx, s.name, k.demoted_n, coalesce(first_value(CASE WHEN kept_n > 0 THEN k.idx END IGNORE NULLS) OVER (PARTITION BY k.doc_id ORDER BY k.idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(CASE WHEN kept_n > 0 THEN k.idx END IGNORE NULLS) OVER (PARTITION BY k.doc_id ORDER BY k.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), k.idx) AS host FROM v_kept_n k JOIN v_section s ON s.doc_id = k.doc_id AND s.idx = k.idx),
  i AS (SELECT doc_id, host, row_number() OVER (PARTITION BY doc_id ORDER BY host) - 1 AS new_id FROM (SELECT DISTINCT doc_id, host FROM h)),
  r AS (SELECT h.doc_id, m.status AS kind, i.new_id, h.idx, m.title, CAST(NULL AS BIGINT) AS n, h.host <> h.idx AS moved, m.rank FROM v_room m JOIN h ON h.doc_id = m.doc_id AND h.idx = m.section JOIN i ON i.doc_id = h.doc_id AND i.host = h.host
    UNION ALL SELECT h.doc_id, 'absorbed', i.new_id, h.idx, h.name, h.demoted_n, true, 0 FROM h JOIN i ON i.doc_id = h.doc_id AND i.host = h.host WHERE h.host <> h.idx)
  SELECT doc_id, kind, CAST(new_id AS INTEGER) AS new_id, CAST(row_number() OVER (PARTITION BY doc_id, new_id, kind ORDER BY moved, idx, rank, title) AS INTEGER) AS ord, idx, title, n FROM r""")
def absorb_empty(t):
    return U.absorb_empty(V.rooms(t), V.sections(t))


def listed(t):
    """Model output lists: votes with repeated and invented titles."""
    v = V.votes(t).select("run", "room", "title", "ord")
    again = v.select("run", "room", "title", (F.col("ord") + 100000000).alias("ord"))
    ghost = v.where(F.col("ord") % 3 == 0).select("run", "room", F.concat(L("ghost "), "title").alias("title"), "ord")
    return v.where(F.col("ord") % 2 == 0).unionByName(again.where(F.col("ord") % 4 != 1)).unionByName(ghost)


@query("llm_output_filter", """WITH l AS (SELECT run, room, title, ord FROM v_vote WHERE ord % 2 = 0 UNION ALL SELECT run, room, title, ord + 100000000 FROM v_vote WHERE (ord + 100000000) % 4 <> 1
    UNION ALL SELECT run, room, 'ghost ' || title, ord FROM v_vote WHERE ord % 3 = 0),
  f AS (SELECT run, room, title, min(ord) AS ord FROM l GROUP BY ALL), j AS (SELECT f.*, v.title IS NOT NULL AS known FROM f LEFT JOIN v_vote v ON v.run = f.run AND v.room = f.room AND v.title = f.title)
  SELECT c.run, c.room, c.n_input, coalesce(g.kept, 0) AS kept, coalesce(g.invented, 0) AS invented, c.n_input - coalesce(g.kept, 0) AS missing FROM (SELECT run, room, count(*) AS n_input FROM v_vote GROUP BY ALL) c
  LEFT JOIN (SELECT run, room, count(*) FILTER (WHERE known) AS kept, count(*) FILTER (WHERE NOT known) AS invented FROM j GROUP BY ALL) g ON g.run = c.run AND g.room = c.room""")
def llm_output_filter(t):
    v = V.votes(t)
    j = U.filter_listed(listed(t), v, ["run", "room"], "title", "ord")
    g = j.groupBy("run", "room").agg(F.count_if("known").alias("kept"), F.count_if(~F.col("known")).alias("invented"))
    return v.groupBy("run", "room").agg(F.count("*").alias("n_input")).join(g, ["run", "room"], "left").fillna(0, ["kept", "invented"]).withColumn("missing", F.col("n_input") - F.col("kept"))


view_sql("v_spec", """SELECT s.doc_id, s.idx AS room_id, s.name, k.kept_n, k.demoted_n, CASE WHEN k.kept_n = 0 THEN 'empty' ELSE 'ok' END AS coherence_flag, 'cluster_' || s.idx AS source_cluster, s.start_offset, s.end_offset
  FROM v_section s JOIN v_kept_n k ON k.doc_id = s.doc_id AND k.idx = s.idx""")


@query("room_spec_convert", "SELECT * FROM v_spec")
def room_spec_convert(t):
    return U.room_spec(V.rooms(t), V.sections(t))


@query("keep_demote_apply", """SELECT v.room, v.title, CASE WHEN m.status = 'kept' THEN 'kept' ELSE 'demoted' END AS status FROM (SELECT DISTINCT room, title FROM v_vote) v LEFT JOIN v_majority m ON m.room = v.room AND m.title = v.title""")
def keep_demote_apply(t):
    v = V.votes(t)
    kept = ST.majority_keep(v, 3, 5).where("status = 'kept'")
    return U.keep_demote_apply(v.select("room", "title").distinct(), kept, ["room", "title"])


@query("export_validate", """WITH r AS (SELECT doc_id, section, CASE WHEN pos % 11 = 0 THEN 'lost ' || title ELSE title END AS title, status, CASE WHEN pos % 7 = 0 THEN NULL ELSE pos END AS pos FROM v_room),
  p AS (SELECT doc_id, room_id, kept_n + CASE WHEN room_id % 4 = 3 THEN 1 ELSE 0 END AS kept_n FROM v_spec)
  SELECT doc_id, 'room_count ' || count(*) AS error FROM p GROUP BY doc_id HAVING count(*) > 10
  UNION ALL SELECT p.doc_id, 'kept_count ' || p.room_id FROM p LEFT JOIN (SELECT doc_id, section, count(*) AS n FROM r WHERE status = 'kept' GROUP BY ALL) k ON k.doc_id = p.doc_id AND k.section = p.room_id WHERE p.kept_n <> coalesce(k.n, 0)
  UNION ALL SELECT doc_id, 'missing_field' FROM r WHERE pos IS NULL UNION ALL SELECT r.doc_id, 'unknown_title ' || r.title FROM r ANTI JOIN v_ent e ON e.doc_id = r.doc_id AND e.title = r.title""")
def export_validate(t):
    rooms = V.rooms(t)
    bad = rooms.withColumns({"title": F.when(F.col("pos") % 11 == 0, F.concat(L("lost "), "title")).otherwise(F.col("title")), "pos": F.when(F.col("pos") % 7 != 0, F.col("pos"))})
    spec = U.room_spec(rooms, V.sections(t)).withColumn("kept_n", F.col("kept_n") + F.when(F.col("room_id") % 4 == 3, 1).otherwise(0))
    return U.export_errors(bad, spec, V.entities(t), 10)


@query("frozen_input", """WITH m AS (SELECT community, id, title FROM v_member WHERE level = 0 AND degree > 5)
  SELECT 'entity' AS kind, id, CAST(NULL AS BIGINT) AS ord, title, type, CAST(degree AS BIGINT) AS n, 'buys for ' || type AS detail FROM v_customer
  UNION ALL SELECT 'community', p.community, NULL, p.title, NULL, s.n, p.summary FROM v_report p JOIN (SELECT community, count(*) AS n FROM m GROUP BY 1) s ON s.community = p.community
  UNION ALL SELECT 'member', community, row_number() OVER (PARTITION BY community ORDER BY id), title, NULL, NULL, NULL FROM m
  UNION ALL SELECT 'uncovered', NULL, NULL, title, NULL, NULL, NULL FROM (SELECT title FROM v_customer EXCEPT SELECT title FROM m)""")
def frozen_input(t):
    m = V.members(t).where("level = 0")
    ents = m.select("id", "title", "type", "degree", F.concat(L("buys for "), "type").alias("description"))
    # customers with few orders are in no frozen community
    return U.frozen_input(ents, m.where("degree > 5").select("community", "id"), V.reports(t).select("community", "title", "summary"))


@query("golden_diff", """WITH a AS (SELECT doc_id, room_id, title, sequence, source_offset, offset_confidence FROM v_export),
  b AS (SELECT doc_id, room_id, title, CASE WHEN source_offset % 13 = 0 THEN sequence + 1 ELSE sequence END AS sequence, source_offset, CASE WHEN source_offset % 17 = 0 THEN 'fallback' ELSE offset_confidence END AS offset_confidence FROM v_export WHERE source_offset % 19 <> 0),
  j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.room_id, b.room_id) AS room_id, coalesce(a.title, b.title) AS title, a.sequence AS s1, b.sequence AS s2, a.source_offset AS o1, b.source_offset AS o2, a.offset_confidence AS c1, b.offset_confidence AS c2
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.room_id = b.room_id AND a.title = b.title),
  u AS (SELECT doc_id, room_id, title, 'sequence' AS field, CAST(s1 AS VARCHAR) AS golden, CAST(s2 AS VARCHAR) AS other FROM j UNION ALL SELECT doc_id, room_id, title, 'source_offset', CAST(o1 AS VARCHAR), CAST(o2 AS VARCHAR) FROM j
    UNION ALL SELECT doc_id, room_id, title, 'offset_confidence', c1, c2 FROM j)
  SELECT * FROM u WHERE golden IS DISTINCT FROM other""")
def golden_diff(t):
    from inkstone.operators.matching import field_diff
    from inkstone.plans.ranking import exported

    a = exported(t).select("doc_id", "room_id", "title", "sequence", "source_offset", "offset_confidence")
    o = F.col("source_offset")
    b = a.where(o % 19 != 0).withColumns({"sequence": F.when(o % 13 == 0, F.col("sequence") + 1).otherwise(F.col("sequence")),
                                          "offset_confidence": F.when(o % 17 == 0, "fallback").otherwise(F.col("offset_confidence"))})
    return field_diff(a, b, ["doc_id", "room_id", "title"], ["sequence", "source_offset", "offset_confidence"])
