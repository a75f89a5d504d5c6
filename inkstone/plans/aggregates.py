"""Queries for aggregations, votes and stability, checks and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.operators import aggregates as A
from inkstone.operators import positions as P
from inkstone.operators import quiz as Q
from inkstone.operators import stability as ST
from inkstone.plans import positions as PP
from inkstone.plans import views as V
from inkstone.plans.registry import query, view_sql

L = F.lit
N_RUNS, BUDGET = 3, 5

# ---------------------------------------------------------------- counts, usage, cost


@query("type_distribution", "SELECT type, count(*) AS n FROM v_ent GROUP BY type")
def type_distribution(t):
    return V.entities(t).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("level_counts", "SELECT level, count(*) AS n, string_agg(CASE WHEN level = 0 THEN title END, '|' ORDER BY title) AS titles FROM v_community GROUP BY level")
def level_counts(t):
    # titles are listed for level 0 only, which has one row per region
    c = V.communities(t)
    names = c.where("level = 0").groupBy("level").agg(F.array_join(F.array_sort(F.collect_list("title")), "|").alias("titles"))
    return c.groupBy("level").agg(F.count("*").alias("n")).join(names, "level", "left").orderBy("level")


PRICE = "(VALUES " + ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in K.PRICES.items()) + ") p(model, i, o)"
view_sql("v_cost", f"SELECT u.*, CAST(prompt_tokens AS DECIMAL(18,0)) * i + CAST(completion_tokens AS DECIMAL(18,0)) * o AS cost FROM v_usage u LEFT JOIN {PRICE} ON p.model = u.model")


@query("usage_by_model", """SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  count(*) AS calls, CAST(round(sum(coalesce(cost, 0)), 0) AS DOUBLE) / 1e6 AS cost FROM v_cost GROUP BY ROLLUP (model)""")
def usage_by_model(t):
    return A.usage_by_model(V.usage(t))


@query("usage_cost", """SELECT job_id, CASE WHEN count(*) FILTER (WHERE cost IS NULL) = 0 THEN CAST(round(sum(cost), 0) AS DOUBLE) / 1e6 END AS cost_strict,
  CAST(round(sum(coalesce(cost, 0)), 0) AS DOUBLE) / 1e6 AS cost_lenient, count(*) FILTER (WHERE cost IS NULL) AS "unknown" FROM v_cost GROUP BY job_id""")
def usage_cost(t):
    u = V.usage(t)
    strict = A.usage_cost(u, "job_id", "null").withColumnRenamed("cost", "cost_strict")
    return strict.join(A.usage_cost(u, "job_id", "zero").select("job_id", F.col("cost").alias("cost_lenient")), "job_id")


STAGES = ["stage3", "stage1", "stage0", "stage2", "stage9"]


@query("stage_report", f"""WITH d AS (SELECT unnest(range(5)) AS ord, unnest({STAGES}) AS stage),
  g AS (SELECT d.ord, d.stage, count(u.stage) AS calls, coalesce(sum(prompt_tokens), 0) AS p, coalesce(sum(completion_tokens), 0) AS c FROM d LEFT JOIN v_usage u ON u.stage = d.stage GROUP BY ALL)
  SELECT CAST(ord AS INTEGER) AS ord, stage, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM g GROUP BY GROUPING SETS ((ord, stage), ())""")
def stage_report(t):
    return A.stage_report(V.usage(t), STAGES)


@query("method_summary", """SELECT stage, avg(k) AS mean_value, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(round(sum(cost), 0) AS DOUBLE) / 1e6 AS cost FROM (SELECT *, prompt_tokens / 100 AS k FROM v_cost) GROUP BY ROLLUP (stage)""")
def method_summary(t):
    u = A.with_cost(V.usage(t), "null")
    return u.rollup("stage").agg(
        F.avg(F.col("prompt_tokens") / 100).alias("mean_value"), F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), A.usd(F.sum("cost")).alias("cost"))


@query("trial_summary", """SELECT event_type AS profile, user_id AS question, round(avg(value), 6) AS mean_time, min(value) AS min_time, max(value) AS max_time,
  round(avg(CAST(props->>'k' AS BIGINT)), 6) AS mean_tokens, count(*) AS trials FROM events GROUP BY ALL""")
def trial_summary(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").groupBy(F.col("event_type").alias("profile"), F.col("user_id").alias("question")).agg(
        F.round(F.avg("value"), 6).alias("mean_time"), F.min("value").alias("min_time"), F.max("value").alias("max_time"),
        F.round(F.avg(k), 6).alias("mean_tokens"), F.count("*").alias("trials"))


@query("run_log_summary", """SELECT user_id AS run_id, round(sum(CASE WHEN event_id % 6 <> 0 THEN value END), 4) AS seconds, count(*) FILTER (WHERE event_type = 'view') AS images,
  count(*) FILTER (WHERE event_type = 'view' AND CAST(props->>'k' AS INTEGER) > 50) AS captions, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY 1""")
def run_log_summary(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.round(F.sum(F.when(F.col("event_id") % 6 != 0, F.col("value"))), 4).alias("seconds"), F.count_if(F.col("event_type") == "view").alias("images"),
        F.count_if((F.col("event_type") == "view") & (k > 50)).alias("captions"), F.sum(F.length("props")).alias("chars"))


# ---------------------------------------------------------------- votes

view_sql("v_tally", """SELECT room, title, CAST(sum(CAST(keep AS INTEGER)) AS INTEGER) AS votes, min(ord) FILTER (WHERE run = 0 AND keep) AS first_ord FROM v_vote GROUP BY ALL""")
view_sql("v_majority", """SELECT t.room, t.title, t.votes, CASE WHEN b.rank IS NULL THEN 'demoted' ELSE 'kept' END AS status, b.rank FROM v_tally t LEFT JOIN (
  SELECT room, title, CAST(row_number() OVER (PARTITION BY room ORDER BY votes DESC, coalesce(first_ord, 1::BIGINT << 60), title) AS INTEGER) AS rank FROM v_tally WHERE votes > 1.5 QUALIFY rank <= 5) b ON b.room = t.room AND b.title = t.title""")


@query("majority_keep", "SELECT * FROM v_majority")
def majority_keep(t):
    return ST.majority_keep(V.votes(t), N_RUNS, BUDGET)


view_sql("v_pair_jac", """WITH g AS (SELECT DISTINCT v.room, a.run AS run_a, b.run AS run_b FROM v_vote v, (VALUES (0), (1), (2)) a(run), (VALUES (0), (1), (2)) b(run) WHERE a.run < b.run),
  s AS (SELECT room, run, count(*) AS n FROM v_vote WHERE keep GROUP BY ALL),
  x AS (SELECT a.room, a.run AS run_a, b.run AS run_b, count(*) AS n FROM v_vote a JOIN v_vote b ON b.room = a.room AND b.title = a.title AND a.run < b.run WHERE a.keep AND b.keep GROUP BY ALL)
  SELECT g.room, g.run_a, g.run_b, coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(x.n, 0) AS u, coalesce(x.n, 0) AS n FROM g LEFT JOIN s sa ON sa.room = g.room AND sa.run = g.run_a
  LEFT JOIN s sb ON sb.room = g.room AND sb.run = g.run_b LEFT JOIN x ON x.room = g.room AND x.run_a = g.run_a AND x.run_b = g.run_b""")


@query("pair_jaccard", """SELECT room, run_a, run_b, CASE WHEN u = 0 THEN 1.0 ELSE CAST(n AS DOUBLE) / u END AS jaccard,
  avg(CASE WHEN u = 0 THEN 1.0 ELSE CAST(n AS DOUBLE) / u END) OVER (PARTITION BY room) AS mean_jaccard, min(CASE WHEN u = 0 THEN 1.0 ELSE CAST(n AS DOUBLE) / u END) OVER (PARTITION BY room) AS min_jaccard FROM v_pair_jac""")
def pair_jaccard(t):
    j = ST.pair_jaccard(V.votes(t), N_RUNS)
    # at most n_runs * (n_runs - 1) / 2 rows per room remain here
    s = j.groupBy("room").agg(F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"))
    return j.join(s, "room")


@query("split_titles", """WITH p AS (SELECT room, count(*) AS n_titles, count(*) FILTER (WHERE votes BETWEEN 1 AND 2) AS n_split, count(*) FILTER (WHERE votes > 1.5) AS m FROM v_tally GROUP BY room)
  SELECT room, CAST(sum(n_titles) AS BIGINT) AS n_titles, CAST(sum(n_split) AS BIGINT) AS n_split, CAST(sum(n_split + greatest(0, m - 5)) AS BIGINT) AS changed, round(sum(n_split) / CAST(sum(n_titles) AS DOUBLE), 4) AS fraction FROM p GROUP BY ROLLUP (room)""")
def split_titles(t):
    return ST.split_titles(V.votes(t), N_RUNS, BUDGET)


view_sql("v_flip", """SELECT title, count(DISTINCT CASE WHEN keep IS NULL THEN 'missing' WHEN keep THEN 'keep' ELSE 'demote' END) > 1 AS flipped FROM
  (SELECT g.title, g.run, v.keep FROM (SELECT title, run FROM (SELECT DISTINCT title FROM v_vote), (VALUES (0), (1), (2)) r(run)) g LEFT JOIN v_vote v ON v.title = g.title AND v.run = g.run) GROUP BY title""")


@query("flip_rate", """SELECT 'all' AS scope, count(*) FILTER (WHERE flipped) AS flipped, count(*) AS total, count(*) FILTER (WHERE flipped) / CAST(count(*) AS DOUBLE) AS rate FROM v_flip
  UNION ALL SELECT 'anchors', count(*) FILTER (WHERE flipped), count(*), count(*) FILTER (WHERE flipped) / CAST(count(*) AS DOUBLE) FROM v_flip SEMI JOIN v_anchor USING (title)""")
def flip_rate(t):
    v = V.votes(t)
    return ST.flip_rate(v, N_RUNS).withColumn("scope", L("all")).unionByName(ST.flip_rate(v, N_RUNS, V.anchors(t)).withColumn("scope", L("anchors")))


view_sql("v_room_pair", """WITH s AS (SELECT run, room, count(DISTINCT title) AS n FROM v_vote GROUP BY ALL),
  x AS (SELECT a.run AS run_a, b.run AS run_b, a.room AS a, b.room AS b, count(*) AS n FROM v_vote a JOIN v_vote b ON b.title = a.title AND a.run < b.run GROUP BY ALL)
  SELECT x.run_a, x.run_b, x.a, x.b, x.n / CAST(sa.n + sb.n - x.n AS DOUBLE) AS jaccard,
    row_number() OVER (PARTITION BY x.run_a, x.run_b ORDER BY x.n / CAST(sa.n + sb.n - x.n AS DOUBLE) DESC, x.a DESC, x.b DESC) AS ord
  FROM x JOIN s sa ON sa.run = x.run_a AND sa.room = x.a JOIN s sb ON sb.run = x.run_b AND sb.room = x.b""")
view_sql("v_greedy", """WITH RECURSIVE g AS (SELECT run_a, run_b, a, b, jaccard, ord, true AS took, [a] AS ua, [b] AS ub FROM v_room_pair WHERE ord = 1
  UNION ALL SELECT p.run_a, p.run_b, p.a, p.b, p.jaccard, p.ord, NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b),
    CASE WHEN NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b) THEN list_append(g.ua, p.a) ELSE g.ua END,
    CASE WHEN NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b) THEN list_append(g.ub, p.b) ELSE g.ub END
  FROM g JOIN v_room_pair p ON p.run_a = g.run_a AND p.run_b = g.run_b AND p.ord = g.ord + 1)
  SELECT run_a, run_b, a, b, jaccard FROM g WHERE took""")


def matches(t):
    return ST.greedy_match(ST.room_pairs(V.votes(t), N_RUNS), ["run_a", "run_b"], "a", "b", "jaccard")


@query("greedy_match", "SELECT * FROM v_greedy")
def greedy_match(t):
    return matches(t)


@query("pair_stats", """WITH c AS (SELECT x.run AS run_a, y.run AS run_b, x.room AS a, y.room AS b, x.keep AS va, y.keep AS vb, g.a AS canon FROM v_vote x JOIN v_vote y ON y.title = x.title AND x.run < y.run
    LEFT JOIN v_greedy g ON g.run_a = x.run AND g.run_b = y.run AND g.b = y.room),
  m AS (SELECT run_a, run_b, count(*) AS common, count(*) FILTER (WHERE canon IS NULL OR canon <> a) AS moved_room, count(*) FILTER (WHERE va <> vb) AS moved_visibility FROM c GROUP BY ALL)
  SELECT m.*, j.mean_jaccard, j.min_jaccard, j.n_matched, round(moved_room / CAST(common AS DOUBLE), 4) AS moved_room_fraction, round(moved_visibility / CAST(common AS DOUBLE), 4) AS moved_visibility_fraction
  FROM m JOIN (SELECT run_a, run_b, round(avg(jaccard), 4) AS mean_jaccard, round(min(jaccard), 4) AS min_jaccard, count(*) AS n_matched FROM v_greedy GROUP BY ALL) j USING (run_a, run_b)""")
def pair_stats(t):
    return ST.pair_stats(V.votes(t), matches(t))


@query("anchor_stability", """SELECT a.title, count(DISTINCT v.run) FILTER (WHERE v.keep) AS visible_in_n_runs, count(DISTINCT v.run) FILTER (WHERE v.keep) = 3 AS in_all, count(DISTINCT v.run) FILTER (WHERE v.keep) > 0 AS in_any
  FROM v_anchor a LEFT JOIN v_vote v ON v.title = a.title GROUP BY a.title""")
def anchor_stability(t):
    return ST.anchor_stability(V.anchors(t), V.votes(t), N_RUNS)


view_sql("v_final", "SELECT title, arg_min(room, (status <> 'kept', room)) AS room, CASE WHEN bool_or(status = 'kept') THEN 'kept' ELSE 'demoted' END AS status FROM v_majority GROUP BY title")


def final_spec(t):
    """(title, room, status): one final room per title, a kept placement first."""
    m = ST.majority_keep(V.votes(t), N_RUNS, BUDGET)
    return m.groupBy("title").agg(F.min_by("room", F.struct(F.col("status") != "kept", "room")).alias("room"),
                                  F.when(F.bool_or(F.col("status") == "kept"), "kept").otherwise("demoted").alias("status"))


@query("anchor_eval", """SELECT a.title, a.should, CASE WHEN f.title IS NULL THEN 'missing' ELSE 'present' END AS status, f.status AS class, f.room,
  f.status = CASE WHEN a.should = 'keep' THEN 'kept' ELSE 'demoted' END AS correct FROM (
  SELECT title, should, CASE WHEN CAST(title[2:] AS BIGINT) % 10 = 0 THEN 'u' || (CAST(title[2:] AS BIGINT) + 1) ELSE title END AS actual FROM v_anchor) a LEFT JOIN v_final f ON f.title = a.actual""")
def anchor_eval(t):
    n = F.substring("title", 2, 20).cast("long")
    aliases = V.anchors(t).where(n % 10 == 0).select("title", F.concat(L("u"), (n + 1).cast("string")).alias("alias"))
    return ST.anchor_eval(V.anchors(t), aliases, final_spec(t))


@query("anchor_cohabit", """SELECT grp, count(*) AS members, count(f.room) AS present, count(DISTINCT f.room) AS n_rooms, count(DISTINCT f.room) = 1 AND count(f.room) = count(*) AS all_same_room
  FROM (SELECT title, CAST(title[2:] AS BIGINT) % 40 AS grp FROM v_anchor) a LEFT JOIN v_final f ON f.title = a.title GROUP BY grp""")
def anchor_cohabit(t):
    groups = V.anchors(t).select("title", (F.substring("title", 2, 20).cast("long") % 40).alias("grp"))
    return ST.cohabit(groups, final_spec(t))


@query("model_compare", """SELECT model, CAST(coalesce(sum(k) FILTER (WHERE run = 0), 0) AS BIGINT) AS run0, CAST(coalesce(sum(k) FILTER (WHERE run = 1), 0) AS BIGINT) AS run1, CAST(coalesce(sum(k) FILTER (WHERE run = 2), 0) AS BIGINT) AS run2,
  count(*) FILTER (WHERE hit AND k = 1) AS target_keep, count(*) FILTER (WHERE hit AND k = 0) AS target_demote FROM (
  SELECT 'm' || (room % 3) AS model, run, CAST(keep AS INTEGER) AS k, title IN (SELECT title FROM v_anchor) AS hit FROM v_vote) GROUP BY model""")
def model_compare(t):
    hit = V.anchors(t).select("title").distinct().withColumn("hit", L(True))
    v = V.votes(t).join(hit, "title", "left").select(F.concat(L("m"), (F.col("room") % 3).cast("string")).alias("model"), "run", F.col("keep").cast("long").alias("k"),
                                                     F.coalesce("hit", L(False)).alias("hit"))
    kept = v.groupBy("model").pivot("run", [0, 1, 2]).agg(F.sum("k")).na.fill(0)
    target = v.groupBy("model").agg(F.count_if(F.col("hit") & (F.col("k") == 1)).alias("target_keep"), F.count_if(F.col("hit") & (F.col("k") == 0)).alias("target_demote"))
    return kept.select("model", *[F.col(str(r)).alias(f"run{r}") for r in range(3)]).join(target, "model")


# ---------------------------------------------------------------- rooms

view_sql("v_room_size", "SELECT s.doc_id, s.idx, CAST(count(a.title) AS INTEGER) AS size FROM v_section s LEFT JOIN v_assigned a ON a.doc_id = s.doc_id AND a.section = s.idx GROUP BY ALL")


@query("size_distribution", """SELECT doc_id, count(*) AS rooms, min(size) AS min, max(size) AS max, round(avg(size), 2) AS mean, count(*) FILTER (WHERE size = 0) AS empty,
  round(max(size) / nullif(min(size), 0)::DOUBLE, 4) AS ratio, round(stddev_pop(size), 4) AS std FROM v_room_size GROUP BY doc_id""")
def size_distribution(t):
    return A.size_distribution(P.rooms_with_sizes(V.sections(t), PP.assigned(t)), "doc_id")


@query("coverage_invariants", """SELECT doc_id, 'room_count' AS "check", count(DISTINCT section) AS value FROM v_room GROUP BY doc_id HAVING count(DISTINCT section) > 4
  UNION ALL SELECT doc_id, 'kept_over_budget', count(*) FROM v_room WHERE status = 'kept' GROUP BY doc_id, section HAVING count(*) > 2
  UNION ALL SELECT e.doc_id, 'placed_once', count(r.title) FROM v_ent e LEFT JOIN v_room r ON r.doc_id = e.doc_id AND r.title = e.title GROUP BY e.doc_id, e.title HAVING count(r.title) <> 1""")
def coverage_invariants(t):
    # limits below the real ones, so that violations exist to be reported
    return A.coverage_violations(V.rooms(t), V.entities(t), "doc_id", max_rooms=4, budget=2)


@query("keep_demote_totals", """SELECT doc_id, section, CAST(count(*) FILTER (WHERE status = 'kept') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE status = 'demoted') AS BIGINT) AS demoted, count(*) AS total FROM v_room GROUP BY ROLLUP (doc_id, section)""")
def keep_demote_totals(t):
    return A.keep_demote_totals(V.rooms(t), "doc_id", "section")


view_sql("v_dom_sum", """SELECT round(avg(ratio), 4) AS mean, round(median(ratio), 4) AS median, round(avg(CAST(ratio >= 0.5 AS INTEGER)), 4) AS ge_05, round(avg(CAST(ratio >= 0.6 AS INTEGER)), 4) AS ge_06,
  round(avg(CAST(ratio >= 0.8 AS INTEGER)), 4) AS ge_08, round(avg(touched), 4) AS touched_mean, CAST(median(touched) AS DOUBLE) AS touched_median, round(avg(CAST(touched = 1 AS INTEGER)), 4) AS touched_1,
  round(avg(CAST(touched <= 2 AS INTEGER)), 4) AS touched_le_2 FROM v_dominant""")


@query("dominance_summary", "SELECT * FROM v_dom_sum")
def dominance_summary(t):
    return A.dominance_summary(PP.dominant(t))


@query("verdict", """SELECT s.ge_05, s.touched_mean, a.split_anchors, a.special_ok, CASE WHEN ge_05 >= 0.8 AND touched_mean <= 2 AND special_ok AND split_anchors = 0 THEN 'GO'
  WHEN ge_05 < 0.8 AND (split_anchors > 0 OR NOT special_ok) THEN 'NO-GO' ELSE 'CONDITIONAL' END AS verdict FROM v_dom_sum s,
  (SELECT count(*) FILTER (WHERE ratio < 0.5) AS split_anchors, count(*) > 0 AS special_ok FROM v_dominant WHERE length(title) >= 10) a""")
def verdict(t):
    dom = PP.dominant(t)
    anchors = dom.where(F.length("title") >= 10).agg(F.count_if(F.col("ratio") < 0.5).alias("split_anchors"), (F.count("*") > 0).alias("special_ok"))
    # two one-row aggregates side by side
    return A.verdict(A.dominance_summary(dom).join(F.broadcast(anchors))).select("ge_05", "touched_mean", "split_anchors", "special_ok", "verdict")


# some positions are spoiled, so that rooms out of order exist
view_sql("v_shuffled_room", "SELECT * REPLACE (CASE WHEN pos % 97 = 5 THEN -pos ELSE pos END AS pos) FROM v_room")


@query("offset_stats", """SELECT count(*) AS n, count(*) FILTER (WHERE pos_source = 0) AS fine, count(*) FILTER (WHERE pos_source <> 0) AS fallback, count(*) FILTER (WHERE pos_source = 2) AS unresolved,
  count(DISTINCT (doc_id, section)) FILTER (WHERE status = 'kept' AND was > pos) AS unsorted_rooms, round(count(*) FILTER (WHERE pos_source = 0) / CAST(count(*) AS DOUBLE), 4) AS fine_share,
  count(*) FILTER (WHERE status = 'kept' AND was > pos) = 0 AS sorted FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, section, status ORDER BY rank) AS was FROM v_shuffled_room)""")
def offset_stats(t):
    rooms = V.rooms(t).withColumn("pos", F.when(F.col("pos") % 97 == 5, -F.col("pos")).otherwise(F.col("pos")))
    return A.offset_stats(rooms, ["doc_id", "section"])


@query("toc_quality", """SELECT r.doc_id, count(*) AS sections, count(*) FILTER (WHERE r.strategy = 'unresolved') AS warnings,
  coalesce(bool_and(r.start_offset < n.start_offset) FILTER (WHERE r.start_offset >= 0 AND n.start_offset >= 0), true) AS monotonic,
  count(DISTINCT r.start_offset) FILTER (WHERE r.start_offset >= 0) = count(*) FILTER (WHERE r.start_offset >= 0) AS "distinct",
  CAST(sum((length(d.text) - length(replace(d.text, r.start_marker, ''))) // length(r.start_marker)) AS BIGINT) AS hits
  FROM v_resolved r JOIN documents d ON d.doc_id = r.doc_id LEFT JOIN v_resolved n ON n.doc_id = r.doc_id AND n.idx = r.idx + 1 GROUP BY r.doc_id""")
def toc_quality(t):
    r = PP.resolved(t)
    s = P.section_spans(r, PP.docs(t)).select("doc_id", "idx", "monotonic", "distinct")
    return r.join(s, ["doc_id", "idx"]).groupBy("doc_id").agg(
        F.count("*").alias("sections"), F.count_if(F.col("strategy") == "unresolved").alias("warnings"), F.every("monotonic").alias("monotonic"),
        F.every("distinct").alias("distinct"), F.sum("hits").alias("hits"))


@query("tie_clusters", "SELECT size, count(*) AS n_values FROM (SELECT pos_first, count(*) AS size FROM v_pos GROUP BY pos_first) GROUP BY size")
def tie_clusters(t):
    return A.tie_clusters(PP.positions(t), "pos_first")


# ---------------------------------------------------------------- communities, buildings, types


@query("room_payload", """SELECT c.community, p.title AS report, p.summary, s.size, string_agg(m.title, '|' ORDER BY m.rn) AS members FROM v_community c JOIN v_report p ON p.community = c.community
  JOIN (SELECT community, count(*) AS size FROM v_member GROUP BY 1) s ON s.community = c.community
  JOIN (SELECT community, title, row_number() OVER (PARTITION BY community ORDER BY degree DESC, title) AS rn FROM v_member QUALIFY rn <= 10) m ON m.community = c.community GROUP BY ALL""")
def room_payload(t):
    return A.room_payload(V.members(t), V.communities(t).select("community"), V.reports(t))


@query("building_slots", """WITH g AS (SELECT community, community % 7 AS building, title FROM v_community WHERE level = 1),
  z AS (SELECT g.*, n FROM g JOIN (SELECT community, count(*) AS n FROM v_member GROUP BY 1) s ON s.community = g.community),
  h AS (SELECT building, arg_min(title, (-n, community)) AS name, '이 건물: ' || string_agg(title, ', ' ORDER BY community) AS summary FROM z GROUP BY building),
  u AS (SELECT DISTINCT building, id, m.title AS concept, degree FROM v_member m JOIN g ON g.community = m.community)
  SELECT u.building, row_number() OVER (PARTITION BY u.building ORDER BY degree DESC, concept) AS ord, concept, degree, name, summary, count(*) OVER (PARTITION BY u.building) AS size FROM u JOIN h ON h.building = u.building""")
def building_slots(t):
    c = V.communities(t).where("level = 1")
    return A.building_slots(c.select("community", (F.col("community") % 7).alias("building")), V.members(t).where("level = 1"), c.select("community", "title"))


@query("partition_check", """WITH e AS (SELECT vec_id FROM embeddings), a AS (SELECT vec_id + CASE WHEN vec_id % 90 = 1 THEN 1 WHEN vec_id % 90 = 50 THEN 1000000 ELSE 0 END AS vec_id, label FROM embeddings),
  n AS (SELECT vec_id, count(*) AS n FROM a GROUP BY 1)
  SELECT 'missing' AS "check", CAST(e.vec_id AS VARCHAR) AS item, CAST(0 AS BIGINT) AS n FROM e ANTI JOIN a ON a.vec_id = e.vec_id UNION ALL SELECT 'duplicate', CAST(vec_id AS VARCHAR), n FROM n WHERE n > 1
  UNION ALL SELECT 'unexpected', CAST(n.vec_id AS VARCHAR), n FROM n ANTI JOIN e ON e.vec_id = n.vec_id UNION ALL SELECT 'label_range', CAST(vec_id AS VARCHAR), 1 FROM a WHERE label NOT BETWEEN 0 AND 8
  UNION ALL SELECT 'wrong_k', NULL, count(DISTINCT label) FROM a HAVING count(DISTINCT label) <> 9""")
def partition_check(t):
    e = t("embeddings")
    m = F.col("vec_id") % 90
    a = e.select((F.col("vec_id") + F.when(m == 1, 1).when(m == 50, 1000000).otherwise(0)).alias("vec_id"), "label")
    return A.partition_check(e, a, "vec_id", "label", 9)


KOREAN_TYPE = {"ECONOMY": "역사 인물", "SMALL": "해상 전투", "MEDIUM": "지역", "PROMO": "정치 개념", "STANDARD": "건축물", "LARGE": "기타"}


def typed_parts(t):
    out = None
    for k, v in KOREAN_TYPE.items():
        out = F.when(F.col("p_type") == k, v) if out is None else out.when(F.col("p_type") == k, v)
    return t("part").withColumn("ktype", out.otherwise("?"))


view_sql("v_typed", "SELECT *, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KOREAN_TYPE.items()) + " ELSE '?' END AS ktype FROM part")


def _bucket_case(field: int) -> str:
    def like(kws):
        return " OR ".join(f"contains(ktype, '{k}')" for k in kws)
    return "CASE " + " ".join(f"WHEN {like(b[2])} THEN '{b[field]}'" for b in K.TYPE_BUCKETS) + " ELSE 'unknown' END"


view_sql("v_bucketed", f"SELECT *, {_bucket_case(0)} AS side, {_bucket_case(1)} AS bucket FROM v_typed")


@query("type_bucket", """SELECT side, bucket, count(*) AS n, array_to_string(list(p_name ORDER BY p_partkey)[1:5], ', ') AS examples FROM v_bucketed GROUP BY ALL""")
def type_bucket(t):
    return A.bucket_counts(typed_parts(t), "ktype", "p_name", "p_partkey")


view_sql("v_part_deg", "SELECT p.*, CAST(coalesce(n, 0) AS INTEGER) AS degree FROM v_bucketed p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey")


def part_degrees(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count("*").cast("int").alias("degree"))
    return typed_parts(t).join(n, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("degree", F.coalesce("degree", L(0)))


@query("degree_vs_type", """WITH e AS (SELECT p_brand AS room, p_partkey AS id, p_name AS title, side, degree FROM v_part_deg WHERE p_size <> 1), h AS (SELECT 'Brand#' || (1 + p_partkey % 25) AS room, p_partkey AS id, side FROM v_part_deg WHERE p_size = 1),
  d AS (SELECT room, id FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY degree DESC, title, id) AS rn FROM e) WHERE rn <= 20), k AS (SELECT room, id FROM e WHERE side = 'keep' UNION ALL SELECT room, id FROM h WHERE side = 'keep')
  SELECT coalesce(d.room, k.room) AS room, coalesce(d.id, k.id) AS id, d.id IS NOT NULL AS by_degree, k.id IS NOT NULL AS by_type FROM d FULL JOIN k ON k.room = d.room AND k.id = d.id""")
def degree_vs_type(t):
    # part names repeat, so the key is appended to make the title order total
    p = part_degrees(t).select(F.col("p_brand").alias("room"), F.col("p_partkey").alias("id"), F.struct("p_name", "p_partkey").alias("title"), F.col("ktype").alias("type"), "degree", "p_size")
    homed = p.where("p_size = 1").withColumn("room", F.concat(L("Brand#"), (F.col("id") % 25 + 1).cast("string")))
    return A.degree_vs_type(p.where("p_size <> 1"), homed)


@query("theme_cohesion", """WITH j AS (SELECT doc_id % 8 AS theme, e.label AS cluster, count(*) AS n FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id GROUP BY ALL)
  SELECT theme, arg_min(cluster, (-n, cluster)) FILTER (WHERE cluster IS NOT NULL) AS mode_cluster, max(n) FILTER (WHERE cluster IS NOT NULL) AS mode_count,
  CAST(coalesce(sum(n) FILTER (WHERE cluster IS NOT NULL), 0) AS BIGINT) AS found, CAST(coalesce(sum(n) FILTER (WHERE cluster IS NULL), 0) AS BIGINT) AS not_found FROM j GROUP BY theme""")
def theme_cohesion(t):
    themes = t("labels").select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") % 8).alias("theme"))
    return A.theme_cohesion(themes, t("embeddings").select("vec_id", F.col("label").alias("cluster")), "vec_id")


# ---------------------------------------------------------------- quiz, parity, readiness

view_sql("v_quiz", """SELECT conv_id AS quiz_id, CAST(turn AS INTEGER) AS idx, CASE WHEN role = 'user' THEN 'multiple_choice' ELSE 'short_answer' END AS type,
  CAST(turn % 4 AS INTEGER) AS answer_index, CASE WHEN role = 'user' THEN '' ELSE text END AS answer_text, text AS question, 'because ' || turn AS explanation FROM conversations""")


def quiz_rows(t):
    c = t("conversations")
    return c.select(
        F.col("conv_id").alias("quiz_id"), F.col("turn").cast("int").alias("idx"), F.when(F.col("role") == "user", "multiple_choice").otherwise("short_answer").alias("type"),
        (F.col("turn") % 4).cast("int").alias("answer_index"), F.when(F.col("role") == "user", "").otherwise(F.col("text")).alias("answer_text"),
        F.col("text").alias("question"), F.concat(L("because "), F.col("turn").cast("string")).alias("explanation"))


@query("quiz_verify", """WITH r AS (SELECT quiz_id, idx, CASE WHEN (quiz_id + idx) % 3 = 0 OR quiz_id % 11 = 0 THEN 'fail' ELSE 'PASS' END AS verdict, CASE WHEN idx % 2 = 0 THEN 'safe' ELSE ' ' END AS safe FROM v_quiz),
  k AS (SELECT q.quiz_id AS group_id, q.idx, q.question, coalesce(nullif(trim(r.safe), ''), q.explanation) AS explanation, 'verified' AS mode FROM v_quiz q JOIN r ON r.quiz_id = q.quiz_id AND r.idx = q.idx WHERE lower(verdict) = 'pass')
  SELECT * FROM k UNION ALL SELECT quiz_id, idx, 'Q ' || quiz_id, explanation, 'fallback' FROM v_quiz q WHERE quiz_id NOT IN (SELECT group_id FROM k)""")
def quiz_verify(t):
    q = quiz_rows(t).withColumnRenamed("quiz_id", "group_id")
    verdict = F.when(((F.col("group_id") + F.col("idx")) % 3 == 0) | (F.col("group_id") % 11 == 0), "fail").otherwise("PASS")
    safe = F.when(F.col("idx") % 2 == 0, "safe").otherwise(" ")
    last = q.select("group_id", "idx", verdict.alias("verdict"), safe.alias("safe_explanation"), L(2).alias("ord"))
    early = q.select("group_id", "idx", L("pass").alias("verdict"), L("old").alias("safe_explanation"), L(1).alias("ord"))
    spare = q.withColumn("question", F.concat(L("Q "), F.col("group_id").cast("string")))
    return Q.verify(q, early.unionByName(last), spare)


@query("quiz_grade", r"""WITH s AS (SELECT quiz_id, idx + CASE WHEN idx % 5 = 4 THEN 1000 ELSE 0 END AS idx, CASE idx % 3 WHEN 0 THEN CAST(answer_index AS VARCHAR) WHEN 1 THEN ' ' || question[1:6] || ' ' ELSE '' END AS answer FROM v_quiz),
  j AS (SELECT q.quiz_id, regexp_replace(s.answer, '^\s+|\s+$', '', 'g') AS u, q.* EXCLUDE (quiz_id) FROM s JOIN v_quiz q ON q.quiz_id = s.quiz_id AND q.idx = s.idx)
  SELECT quiz_id, CAST(sum(CASE WHEN u = '' THEN 0 WHEN type = 'short_answer' THEN CAST(contains(answer_text, u) AS INTEGER) ELSE CAST(coalesce(TRY_CAST(u AS INTEGER) = answer_index, false) AS INTEGER) END) AS INTEGER) AS score, CAST(count(*) AS INTEGER) AS total FROM j GROUP BY quiz_id""")
def quiz_grade(t):
    q = quiz_rows(t)
    k = F.col("idx") % 3
    ans = F.when(k == 0, F.col("answer_index").cast("string")).when(k == 1, F.concat(L(" "), F.substring("question", 1, 6), L(" "))).otherwise("")
    sub = q.select("quiz_id", (F.col("idx") + F.when(F.col("idx") % 5 == 4, 1000).otherwise(0)).alias("idx"), ans.alias("answer"))
    return Q.grade(q.select("quiz_id", "idx", "type", "answer_index", "answer_text"), sub)


@query("ingest_parity", """SELECT 'chunk_rows' AS "check", (SELECT count(*) FROM v_chunk) AS got, CAST((SELECT sum(ceil(len(p) / 110.0)) FROM v_piece) AS BIGINT) AS want
  UNION ALL SELECT 'vector_rows', (SELECT count(*) FROM embeddings), (SELECT count(DISTINCT vec_id) FROM embeddings) UNION ALL SELECT 'vector_width', (SELECT max(len(embedding)) FROM embeddings), 64""")
def ingest_parity(t):
    pieces = F.size(F.regexp_extract_all("text", L(r"([^ \t\n\r\f]+)"), L(1)))
    want = t("documents").agg(F.sum(F.ceil(pieces / 110)).cast("long").alias("want"))
    e = t("embeddings")

    def row(name, got, want):
        # each side is a one-row aggregate
        return got.join(F.broadcast(want)).select(L(name).alias("check"), "got", "want")

    return (row("chunk_rows", V.chunks(t).agg(F.count("*").alias("got")), want)
            .unionByName(row("vector_rows", e.agg(F.count("*").alias("got")), e.agg(F.count_distinct("vec_id").alias("want"))))
            .unionByName(e.agg(F.max(F.size("embedding")).cast("long").alias("got")).select(L("vector_width").alias("check"), "got", L(64).cast("long").alias("want"))))


view_sql("v_latest_job_full", "SELECT job_id, arg_max(state, event_id) AS state, arg_max(toc_ready, event_id) AS toc_ready, arg_max(rooms_ready, event_id) AS rooms_ready, arg_max(rag_ready, event_id) AS rag_ready, arg_max(ts, event_id) AS ts FROM v_job_log GROUP BY job_id")
view_sql("v_latest_job", "SELECT job_id, arg_max(state, event_id) AS state, arg_max(toc_ready, event_id) AS toc_ready, arg_max(rooms_ready, event_id) AS rooms_ready, arg_max(rag_ready, event_id) AS rag_ready, max(ts) AS ts FROM v_job_log GROUP BY job_id")


@query("readiness", """SELECT bool_or(s = 'ok') AS any_ready, bool_and(s = 'ok') AS all_ready, count(*) FILTER (WHERE s = 'pending') AS n_pending, count(*) FILTER (WHERE s = 'error') AS n_error, count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'warming') AS n_warming
  FROM (SELECT CASE state WHEN 'FAILED' THEN 'error' WHEN 'DONE' THEN 'ok' WHEN 'QUEUED' THEN 'pending' ELSE 'warming' END AS s FROM v_latest_job)""")
def readiness(t):
    from inkstone.operators.jobs import latest_state

    s = F.col("state")
    status = F.when(s == "FAILED", "error").when(s == "DONE", "ok").when(s == "QUEUED", "pending").otherwise("warming")
    return A.readiness(latest_state(V.job_log(t)).select(status.alias("status")))
