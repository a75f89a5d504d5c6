"""Queries for ranking, ordering, ids and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import jobs as J
from inkstone.operators import ranking as RK
from inkstone.operators import retrieval as RT
from inkstone.plans import views as V
from inkstone.plans.aggregates import part_degrees
from inkstone.plans.registry import query, view_sql

L = F.lit


@query("top_per_cluster", """SELECT label, vec_id, degree, rank, size FROM (SELECT e.label, e.vec_id, p.degree, CAST(row_number() OVER (PARTITION BY e.label ORDER BY p.degree DESC, e.vec_id) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY e.label) AS size FROM (SELECT coalesce(x.label, -1) AS label, p.p_partkey AS vec_id FROM v_part_deg p LEFT JOIN embeddings x ON x.vec_id = p.p_partkey) e JOIN v_part_deg p ON p.p_partkey = e.vec_id) WHERE rank <= 5""")
def top_per_cluster(t):
    p = part_degrees(t).select(F.col("p_partkey").alias("vec_id"), "degree")
    # parts without a vector are a group of their own
    e = p.join(t("embeddings").select("vec_id", "label"), "vec_id", "left").withColumn("label", F.coalesce("label", L(-1)))
    size = e.groupBy("label").agg(F.count("*").alias("size"))
    return RK.top_per_group(e, ["label"], [F.desc("degree"), "vec_id"], 5).join(size, "label")


@query("round_robin_reps", """WITH k AS (SELECT p_brand AS room, p_type AS kind, p_partkey AS id, degree, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY degree DESC, p_partkey) AS r,
    first_value((-degree, p_partkey)) OVER (PARTITION BY p_brand, p_type ORDER BY degree DESC, p_partkey) AS head FROM v_part_deg)
  SELECT room, kind, id, degree, CAST(row_number() OVER (PARTITION BY room ORDER BY r, head) AS INTEGER) AS rank FROM k QUALIFY rank <= 9""")
def round_robin_reps(t):
    p = part_degrees(t).select(F.col("p_brand").alias("room"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("id"), "degree")
    return RK.round_robin(p, ["room"], "kind", "degree", "id", 9)


@query("dual_rank", """SELECT doc_id, section, title, degree, pos, row_number() OVER (PARTITION BY doc_id, section ORDER BY degree DESC, pos, title) AS room_rank,
  row_number() OVER (ORDER BY degree DESC, pos, doc_id, title) AS global_rank, CAST(sum(degree) OVER (PARTITION BY doc_id, section) AS BIGINT) AS room_weight FROM v_room""")
def dual_rank(t):
    r = V.rooms(t).select("doc_id", "section", "title", "degree", "pos")
    return RK.dual_rank(r, ["doc_id", "section"], "degree", "pos", ["doc_id", "title"])


view_sql("v_export", """SELECT r.doc_id, 'room_' || lpad(CAST(r.section AS VARCHAR), CAST(greatest(2, length(CAST(r.section AS VARCHAR))) AS INTEGER), '0') AS room_id, r.section AS room_index, s.name, r.title, CAST(r.sequence AS INTEGER) AS sequence, r.pos AS source_offset,
  CASE WHEN pos_source = 0 THEN 'fine' ELSE 'fallback' END AS offset_confidence, CAST(row_number() OVER (PARTITION BY r.doc_id, r.section ORDER BY r.pos, r.sequence) AS INTEGER) AS export_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY degree DESC, title) AS sequence FROM v_room WHERE status = 'kept') r JOIN v_section s ON s.doc_id = r.doc_id AND s.idx = r.section""")


def exported(t):
    """Kept members: numbered in input order first, then sorted by offset inside the room."""
    w = Window.partitionBy("doc_id", "section")
    kept = V.rooms(t).where("status = 'kept'").withColumn("sequence", F.row_number().over(w.orderBy(F.desc("degree"), "title")))
    kept = kept.withColumn("export_rank", F.row_number().over(w.orderBy("pos", "sequence")))
    names = V.sections(t).select("doc_id", F.col("idx").alias("section"), "name")
    return kept.join(names, ["doc_id", "section"]).select(
        "doc_id", F.concat(L("room_"), RK.padded(F.col("section"), 2)).alias("room_id"), F.col("section").alias("room_index"), "name", "title", "sequence",
        F.col("pos").alias("source_offset"), F.when(F.col("pos_source") == 0, "fine").otherwise("fallback").alias("offset_confidence"), "export_rank")


@query("export_order", "SELECT * FROM v_export")
def export_order(t):
    return exported(t)


@query("unique_ids", r"""WITH s AS (SELECT title, min(p_partkey) AS seen FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 1 THEN ' ' ELSE '' END || '(' || p_brand || ')' AS title FROM part) GROUP BY title),
  b AS (SELECT *, 'ent_' || lower(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS base FROM s),
  n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seen) AS n FROM b)
  SELECT title, seen, base, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS uid FROM n""")
def unique_ids(t):
    title = F.concat("p_name", F.when(F.col("p_size") % 2 == 1, L(" ")).otherwise(L("")), L("("), "p_brand", L(")"))
    s = t("part").select("p_partkey", title.alias("title")).groupBy("title").agg(F.min("p_partkey").alias("seen"))
    return RK.unique_ids(s.withColumn("base", F.concat(L("ent_"), X.normalize_title(F.col("title")))), "base", "seen", F.floor(F.col("seen") / 100000))


# topics are the words of each benchmark item; candidates are the chunks and entities of the corpus
view_sql("v_topic_token", r"""SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) WHERE length(token) >= 2""")


def topics(t):
    words = F.regexp_extract_all(F.lower("text"), L(r"([\p{L}\p{N}_]+)"), L(1))
    return t("benchmark").select("item_id", F.explode(X.topic_tokens(F.array_join(words, " "))).alias("token"))


view_sql("v_candidate", """SELECT 'd' || doc_id || ':' || chunk_no AS cid, 'chunk ' || chunk_no AS title, 'doc ' || doc_id AS topic, text FROM v_chunk
  UNION ALL SELECT 'e' || title, title, type, 'seen ' || sum(frequency) || ' times' FROM v_ent GROUP BY title, type""")


def candidates(t):
    d = F.col("doc_id").cast("string")
    c = V.chunks(t).select(F.concat(L("d"), d, L(":"), F.col("chunk_no").cast("string")).alias("cid"), F.concat(L("chunk "), F.col("chunk_no").cast("string")).alias("title"),
                           F.concat(L("doc "), d).alias("topic"), "text")
    one = V.entities(t).groupBy("title", "type").agg(F.sum("frequency").alias("n"))
    e = one.select(F.concat(L("e"), "title").alias("cid"), "title", F.col("type").alias("topic"), F.concat(L("seen "), F.col("n").cast("string"), L(" times")).alias("text"))
    return c.unionByName(e)


view_sql("v_scored", """SELECT k.item_id, c.cid, CAST(sum(CASE WHEN contains(c.lt, k.token) THEN 8 ELSE 0 END + CASE WHEN contains(c.lp, k.token) THEN 4 ELSE 0 END + CASE WHEN contains(c.hay, k.token) THEN 1 ELSE 0 END) AS BIGINT) AS score
  FROM (SELECT cid, lower(title) AS lt, lower(topic) AS lp, lower(title || ' ' || topic || ' ' || text) AS hay FROM v_candidate) c JOIN v_topic_token k ON contains(c.hay, k.token) GROUP BY ALL""")


@query("candidate_score", "SELECT * FROM v_scored")
def candidate_score(t):
    return RT.score_candidates(candidates(t), topics(t))


@query("candidate_topk", """WITH p AS (SELECT item_id, cid, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cid) AS rn FROM v_scored) WHERE rn <= 24),
  h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5('7:' || item_id || ':' || cid)) AS rn FROM p),
  n AS (SELECT item_id FROM benchmark ANTI JOIN p ON p.item_id = benchmark.item_id), a AS (SELECT cid FROM v_candidate ORDER BY md5('7:' || cid), cid LIMIT 12)
  SELECT item_id, cid, score FROM h WHERE rn <= 12 UNION ALL SELECT n.item_id, a.cid, CAST(0 AS BIGINT) FROM n, a""")
def candidate_topk(t):
    return RT.select_candidates(candidates(t), topics(t), t("benchmark").select("item_id"), count=6, seed=7)


@query("sorted_sample", """SELECT 'sorted' AS how, p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 60)
  UNION ALL SELECT 'seeded', p_partkey, p_name FROM (SELECT * FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 60)""")
def sorted_sample(t):
    p = t("part").select("p_partkey", "p_name")
    a = p.orderBy("p_name", "p_partkey").limit(60)
    return a.withColumn("how", L("sorted")).unionByName(RK.seeded_sample(p, 60, 42, "p_partkey").withColumn("how", L("seeded")))


@query("blind_relabel", """WITH d AS (SELECT DISTINCT title FROM v_room), b AS (SELECT title, 'item_' || lpad(n, CAST(greatest(6, length(n)) AS INTEGER), '0') AS blind FROM (SELECT title, CAST(row_number() OVER (ORDER BY title) AS VARCHAR) AS n FROM d))
  SELECT r.doc_id, r.section, r.title, b.blind FROM v_room r JOIN b ON b.title = r.title""")
def blind_relabel(t):
    r = V.rooms(t).select("doc_id", "section", "title")
    return r.join(RK.blind_relabel(r, "title", "item_"), "title")


@query("latest_sessions", """SELECT store, event_id, rank FROM (SELECT event_type AS store, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 50""")
def latest_sessions(t):
    s = t("events").select(F.col("event_type").alias("store"), "event_id", "ts")
    return RK.top_per_group(s, ["store"], [F.desc("ts"), F.desc("event_id")], 50).drop("ts")


@query("non_terminal_jobs", """SELECT l.job_id, l.state, c.created_at, CASE WHEN state = 'QUEUED' THEN 'requeue' ELSE 'fail' END AS action FROM v_latest_job l JOIN (SELECT job_id, min(ts) AS created_at FROM v_job_log GROUP BY 1) c ON c.job_id = l.job_id WHERE state NOT IN ('DONE', 'FAILED')""")
def non_terminal_jobs(t):
    log = V.job_log(t)
    born = log.groupBy("job_id").agg(F.min("ts").alias("created_at"))
    return J.recover(J.latest_state(log).join(born, "job_id")).select("job_id", "state", "created_at", "action")
