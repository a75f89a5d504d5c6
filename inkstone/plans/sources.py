"""Queries for sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import text_ops as O
from inkstone.plans import views as V
from inkstone.plans.registry import Tables, query, view_sql
from inkstone.plans.text import paged
from inkstone.session import shared_dir
from inkstone.sources import readers as R
from inkstone.sources import sinks

L = F.lit


def scratch(t: Tables, name: str) -> str:
    """A fresh folder under the shared folder for a query that writes and reads back."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def snapshot(t: Tables) -> dict:
    """The six knowledge tables of the whole corpus."""
    return {
        "documents": t("documents").select("doc_id", "text"), "text_units": V.chunks(t), "entities": V.entities(t),
        "relationships": V.edges(t), "communities": V.communities(t), "community_reports": V.reports(t),
    }


@query("snapshot_tables", """SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'text_units', count(*) FROM v_chunk
  UNION ALL SELECT 'entities', count(*) FROM v_ent UNION ALL SELECT 'relationships', count(*) FROM v_edge
  UNION ALL SELECT 'communities', count(*) FROM v_community UNION ALL SELECT 'community_reports', count(*) FROM v_report
  UNION ALL SELECT 'covariates', 0""")
def snapshot_tables(t):
    tables = snapshot(t)
    tables["covariates"] = t.spark.createDataFrame([], R.OPTIONAL_TABLES["covariates"])
    return R.table_counts(tables)


@query("entity_vectors", "SELECT e.vec_id AS doc_id, CAST(len(e.embedding) AS INTEGER) AS embedding_dim, quality FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def entity_vectors(t):
    vecs = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    # the entities are the rows that have a vector; one without fails the job
    ents = vecs.select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return R.entity_vectors(ents, vecs, "doc_id", "embedding").select("doc_id", F.size("embedding").alias("embedding_dim"), "quality")


@query("align_vectors", """WITH n AS (SELECT l.doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id)
  SELECT doc_id, unnest(range(len(v))) AS pos, round(unnest(v) / greatest(sqrt(list_dot_product(v, v)), 1e-9), 6) AS x,
  (SELECT count(*) FROM labels l ANTI JOIN embeddings e ON e.vec_id = l.doc_id) AS missing FROM n""")
def align_vectors(t):
    vecs = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ok = R.align_vectors(t("labels"), vecs, "doc_id", "embedding").select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    # the single count row is a one-row side
    return ok.join(F.broadcast(R.missing_vectors(t("labels"), vecs, "doc_id"))).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"), "missing")


METHOD = "CASE turn % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'local' WHEN 2 THEN 'drift' ELSE 'basic' END"


def with_method(df):
    k = F.col("turn") % 4
    return df.withColumn("wanted", F.when(k == 0, "global").when(k == 1, "local").when(k == 2, "drift").otherwise("basic"))


@query("stores_for_method", f"""SELECT conv_id, turn, wanted, store FROM (SELECT conv_id, turn, {METHOD} AS wanted FROM conversations) q
  LEFT JOIN (VALUES ('local', 'entity_description'), ('drift', 'entity_description'), ('drift', 'community_full_content'), ('basic', 'text_unit_text')) s(method, store) ON s.method = q.wanted""")
def stores_for_method(t):
    return R.stores_for_method(with_method(t("conversations")).select("conv_id", "turn", "wanted"), "wanted")


@query("corpus_read", "SELECT lang, doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def corpus_read(t):
    path = scratch(t, "corpus")
    sinks.write_records(t("documents").where("text IS NOT NULL").select("lang", "doc_id", "text"), path, "lang", "doc_id", "text")
    back = R.read_records(t.spark, path, "lang string")
    return back.select("lang", F.col("key").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("page_split", r"""WITH s AS (SELECT doc_id, string_split_regex(text, '\[page\d+\]\n?') AS b, regexp_extract_all(text, '\[page(\d+)\]', 1) AS m FROM v_paged),
  u AS (SELECT doc_id, CAST(unnest(m) AS INTEGER) AS page, unnest(b[2:]) AS body, unnest(range(len(m))) AS ord FROM s)
  SELECT doc_id, page, arg_max(body, ord) AS body FROM u GROUP BY doc_id, page""")
def page_split(t):
    return O.split_pages(paged(t))


def dashed(t):
    return paged(t).select("doc_id", F.regexp_replace("text", r"\[page(\d+)\]", "--- page $1 ---").alias("text"))


@query("page_split_dashed", rf"""WITH s AS (SELECT doc_id, string_split_regex(text, '\[page\d+\]') AS b, regexp_extract_all(text, '\[page(\d+)\]', 1) AS m FROM v_paged),
  u AS (SELECT doc_id, CAST(unnest(m) AS INTEGER) AS page, regexp_replace(unnest(b[2:]), '^\s+|\s+$', '', 'g') AS body, CAST(unnest(range(len(m))) AS INTEGER) AS ord FROM s)
  SELECT doc_id, ord, page, body, count(*) OVER (PARTITION BY doc_id) AS kept, n - count(*) OVER (PARTITION BY doc_id) AS dropped
  FROM u JOIN (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) USING (doc_id) WHERE length(body) >= 10""")
def page_split_dashed(t):
    mark = r"---\s*page\s+(\d+)\s*---"
    nums = F.regexp_extract_all("text", L(mark), L(1))
    bodies = F.split("text", mark, -1)
    rows = X.let(F.struct(nums.alias("n"), bodies.alias("b")), lambda s: F.transform(
        s["n"], lambda n, i: F.struct(i.alias("ord"), n.cast("int").alias("page"), X.strip(F.get(s["b"], i + 1)).alias("body"))))
    kept = X.let(rows, lambda a: F.struct(
        F.size(a).alias("n"), F.filter(a, lambda r: F.length(r["body"]) >= 10).alias("kept")))
    one = dashed(t).select("doc_id", F.inline(F.array(kept)))
    return one.select("doc_id", F.size("kept").cast("long").alias("kept"), (F.col("n") - F.size("kept")).cast("long").alias("dropped"), F.inline("kept"))


@query("semantic_docs_filter", r"SELECT * FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10")
def semantic_docs_filter(t):
    return t("documents").where(F.length(X.strip(F.col("text"))) >= 10)


@query("figures_scan", """SELECT 'f' || page_id AS id, CASE WHEN page_id % 4 = 1 THEN 0 ELSE CAST(page_id % 50 AS INTEGER) END AS page, CAST(page_id AS INTEGER) AS idx,
  'fig_' || (page_id % 50) || '_' || page_id || '.png' AS img_path, url AS caption FROM pages WHERE page_id % 5 <> 2""")
def figures_scan(t):
    p = F.col("page_id")
    js = F.to_json(F.array(F.struct(
        F.concat(L("f"), p.cast("string")).alias("id"), F.when(p % 4 == 1, L("n/a")).otherwise((p % 50).cast("string")).alias("page"),
        F.when(p % 5 == 2, L("")).otherwise(F.concat(L("fig_"), (p % 50).cast("string"), L("_"), p.cast("string"), L(".png"))).alias("img_path"),
        F.col("url").alias("caption"))))
    return R.figures_from_json(t("pages").select(js.alias("j")), "j").orderBy("page", "idx")


@query("captions_scan", r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS a FROM pages)
  SELECT page_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, regexp_replace(unnest(a), '^\s+|\s+$', '', 'g') AS caption FROM c""")
def captions_scan(t):
    return R.captions_scan(t("pages"), "page_id", "html", "title")


@query("captions_to_md", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM v_paged)
  SELECT doc_id, array_to_string(list_transform(a, lambda x: '<figcaption>' || regexp_replace(regexp_replace(regexp_replace(x, '\[page\d+\]', '', 'g'), '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g') || '</figcaption>'), chr(10) || chr(10)) || chr(10) AS md FROM l""")
def captions_to_md(t):
    return paged(t).select("doc_id", X.captions_to_md(F.col("text")).alias("md"))


@query("analyzer_figures", """WITH f AS (SELECT event_id, 'top' AS figure_id, CASE event_id % 3 WHEN 0 THEN ['pageHeader', 'pageFooter'] WHEN 1 THEN ['pageHeader', 'body'] ELSE [] END AS r FROM events
  UNION ALL SELECT event_id, 'inner', CASE WHEN event_id % 2 = 0 THEN ['pageFooter'] ELSE ['body'] END FROM events)
  SELECT event_id, figure_id, CAST(len(r) AS INTEGER) AS n_refs FROM f WHERE NOT (len(r) > 0 AND len(list_filter(r, lambda x: x NOT IN ('pageHeader', 'pageFooter'))) = 0)""")
def analyzer_figures(t):
    e = F.col("event_id")
    def fig(name, refs):
        return F.array(F.struct(L(name).alias("id"), refs.alias("elements")))
    none = F.array(L("/tables/0"))
    top = F.when(e % 3 == 0, F.array(L("/paragraphs/0"), L("/paragraphs/1"))).when(e % 3 == 1, F.array(L("/paragraphs/0"), L("/paragraphs/2"))).otherwise(none)
    inner = F.when(e % 2 == 0, F.array(L("/paragraphs/1"))).otherwise(F.array(L("/paragraphs/2")))
    js = F.to_json(F.struct(F.array(F.struct(
        F.array(*[F.struct(L(r).alias("role")) for r in ("pageHeader", "pageFooter", "body")]).alias("paragraphs"),
        fig("top", top).alias("figures"), F.array(F.struct(fig("inner", inner).alias("figures"))).alias("pages"))).alias("contents")))
    return R.analyzer_figures(t("events").select("event_id", js.alias("j")), "event_id", "j")


@query("usage_log_scan", """SELECT CASE WHEN event_id % 7 = 3 THEN '?' ELSE model END AS model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN event_id % 7 = 4 THEN 0 ELSE completion_tokens END) AS BIGINT) AS completion_tokens FROM v_usage WHERE event_id % 7 NOT IN (1, 2) GROUP BY 1""")
def usage_log_scan(t):
    k = F.col("event_id") % 7
    js = F.to_json(F.struct(F.when(k != 3, F.col("model")).alias("model"), "prompt_tokens", F.when(k != 4, F.col("completion_tokens")).alias("completion_tokens")))
    line = F.when(k == 1, L("  ")).when(k == 2, L('{"model": "cut')).otherwise(js)
    rows = R.parse_usage_lines(V.usage(t).select(line.alias("line")), "line")
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def cached_json(t):
    k = F.col("event_id") % 3
    usage = F.struct("prompt_tokens", F.when(F.col("event_id") % 4 != 0, F.col("completion_tokens")).alias("completion_tokens"),
                     (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    body = (F.when(k == 0, F.to_json(F.struct(F.struct(F.struct(usage.alias("usage")).alias("response")).alias("result"))))
            .when(k == 1, F.to_json(F.struct(F.struct(usage.alias("usage")).alias("result")))).otherwise(F.to_json(F.struct(usage.alias("usage")))))
    return V.usage(t).select("event_id", body.alias("j"))


@query("cache_token_scan", """SELECT CASE WHEN event_id % 4 <> 0 THEN 'chat' ELSE 'embedding' END AS kind, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN event_id % 4 <> 0 THEN completion_tokens ELSE 0 END) AS BIGINT) AS completion_tokens FROM v_usage GROUP BY 1""")
def cache_token_scan(t):
    return R.cache_tokens(cached_json(t), "j")


def nested_json(t):
    """Responses with a usage object (details inside, a total in some) under ``event_id % 9`` wrappers, objects and lists in turn.

    Beside it stand an embedding object and one with a total alone, which is none.
    """
    k, none = F.col("event_id") % 3, L("")
    num = lambda c: F.col(c).cast("string")
    total = (F.col("prompt_tokens") + F.col("completion_tokens")).cast("string")
    usage = F.concat(L('{"prompt_tokens":'), num("prompt_tokens"), F.when(k != 0, F.concat(L(',"completion_tokens":'), num("completion_tokens"))).otherwise(none),
                     L(',"details":{"cached_tokens":1,"parts":[{"n":2}]}'), F.when(k != 1, F.concat(L(',"total_tokens":'), total)).otherwise(none), L("}"))
    deep = F.col("event_id") % 9
    for i in range(8):
        wrapped = F.concat(L("["), usage, L("]")) if i % 2 else F.concat(L('{"result":'), usage, L("}"))
        usage = F.when(deep > i, wrapped).otherwise(usage)
    body = F.concat(L('{"a":'), usage, L(',"b":[{"prompt_tokens":7,"total_tokens":7},{"total_tokens":9}]}'))
    return V.usage(t).select("event_id", F.when(F.col("event_id") % 11 == 5, L('{"prompt_tokens":')).otherwise(body).alias("j"))


view_sql("v_nested", """SELECT event_id, CASE WHEN event_id % 11 = 5 THEN '{"prompt_tokens":' ELSE '{"a":' || list_reduce(list_prepend(
    '{"prompt_tokens":' || prompt_tokens || CASE WHEN event_id % 3 <> 0 THEN ',"completion_tokens":' || completion_tokens ELSE '' END || ',"details":{"cached_tokens":1,"parts":[{"n":2}]}'
      || CASE WHEN event_id % 3 <> 1 THEN ',"total_tokens":' || (prompt_tokens + completion_tokens) ELSE '' END || '}',
    list_transform(range(event_id % 9), lambda i: i::VARCHAR)), lambda x, i: CASE WHEN i::INTEGER % 2 = 1 THEN '[' || x || ']' ELSE '{"result":' || x || '}' END)
    || ',"b":[{"prompt_tokens":7,"total_tokens":7},{"total_tokens":9}]}' END AS j FROM v_usage""")


@query("deep_usage_scan", """WITH RECURSIVE w AS (SELECT event_id, j::JSON AS o, 0 AS depth FROM v_nested WHERE json_valid(j)
  UNION ALL SELECT event_id, e.value, depth + 1 FROM w, json_each(w.o) e WHERE depth < 6 AND json_type(w.o) IN ('OBJECT', 'ARRAY') AND e.type IN ('OBJECT', 'ARRAY'))
  SELECT event_id, CASE WHEN json_exists(o, '$.completion_tokens') THEN 'llm' ELSE 'embed' END AS kind, CAST(o->>'$.prompt_tokens' AS BIGINT) AS prompt_tokens,
    coalesce(CAST(o->>'$.completion_tokens' AS BIGINT), 0) AS completion_tokens, CAST(o->>'$.total_tokens' AS BIGINT) AS total_tokens
  FROM w WHERE json_type(o) = 'OBJECT' AND json_exists(o, '$.prompt_tokens') AND (json_exists(o, '$.completion_tokens') OR json_exists(o, '$.total_tokens'))""")
def deep_usage_scan(t):
    return R.deep_usage(nested_json(t), "event_id", "j")


@query("index_stats_flatten", """WITH u AS (SELECT doc_id, n_chars, unnest(['chunking', 'graph', 'reports']) AS workflow, unnest([1, 2, 3]) AS k FROM documents)
  SELECT doc_id, workflow, CAST(n_chars * k AS DOUBLE) AS overall, n_chars * k * 10 AS peak, n_chars - k AS delta, (n_chars * k) / (n_chars * 6.0) AS share FROM u""")
def index_stats_flatten(t):
    n = F.col("n_chars")
    pairs = [x for k, name in enumerate(("chunking", "graph", "reports"), 1) for x in (
        L(name), F.struct((n * k).alias("overall"), (n * k * 10).alias("peak_memory_bytes"), (n - k).alias("memory_delta_bytes")))]
    js = F.to_json(F.struct((n * 6).alias("total_runtime"), F.create_map(*pairs).alias("workflows")))
    return R.index_stats(t("documents").select("doc_id", js.alias("j")), "doc_id", "j")


@query("md_table_scan", """SELECT CAST(event_id AS INTEGER) AS row, 'img_' || event_id || '.png' AS path, CAST(user_id AS INTEGER) AS page, event_type AS title, 'caption ' || user_id AS caption,
  CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'cascade' END AS tier, CASE WHEN event_id % 3 < 2 THEN value END AS score,
  CASE WHEN event_id % 3 < 2 THEN 'n' || user_id END AS "match" FROM events""")
def md_table_scan(t):
    e, u, hit = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_id") % 3 < 2
    line = F.concat(L("| "), e, L(" | img_"), e, L(".png | "), u, L(" | `"), F.col("event_type"), L("` | caption "), u, L(" | "),
                    F.when(F.col("event_id") % 3 == 0, L("local")).when(F.col("event_id") % 3 == 1, L("cascade")).otherwise(L("-")), L(" | "),
                    F.when(hit, F.col("value").cast("string")).otherwise(L("-")), L(" | "), F.when(hit, F.concat(L("n"), u)).otherwise(L("-")), L(" |"))
    lines = t("events").select(F.explode(F.array(line, L("| # | path | page |"), L("text"))).alias("line"))
    return R.md_match_rows(lines, "line")


@query("csv_sink", "SELECT doc_id, title, frequency, degree FROM v_ent")
def csv_sink(t):
    path = scratch(t, "csv")
    sinks.write_csv(V.entities(t), path, ["doc_id", "title", "frequency", "degree"], ["doc_id", "title"])
    return t.spark.read.csv(path, header=True, schema="doc_id long, title string, frequency int, degree int")


@query("nested_json_sink", """SELECT doc_id % 4 AS run, doc_id, count(*) AS n_rooms FROM v_section GROUP BY doc_id""")
def nested_json_sink(t):
    path = scratch(t, "nested")
    rooms = V.sections(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "start_offset", "end_offset"))).alias("rooms"))
    sinks.write_nested_json(rooms.withColumn("run", F.col("doc_id") % 4), path, "run")
    back = t.spark.read.schema("doc_id long, rooms array<struct<idx:int,name:string>>, run long").json(path)
    return back.select("run", "doc_id", F.size("rooms").cast("long").alias("n_rooms"))


@query("snapshot_freeze", """SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'text_units', count(*) FROM v_chunk
  UNION ALL SELECT 'entities', count(*) FROM v_ent UNION ALL SELECT 'relationships', count(*) FROM v_edge
  UNION ALL SELECT 'communities', count(*) FROM v_community UNION ALL SELECT 'community_reports', count(*) FROM v_report UNION ALL SELECT 'covariates', 0""")
def snapshot_freeze(t):
    path, tables = scratch(t, "snapshot"), snapshot(t)
    sinks.freeze(tables, list(R.SNAPSHOT_TABLES), path)
    return R.table_counts(R.read_snapshot(t.spark, path, set(tables)))


@query("latest_version", """WITH v AS (SELECT user_id, event_id AS version, CASE WHEN event_type IN ('view', 'click') THEN 'v2' ELSE 'v1' END AS api FROM events)
  SELECT user_id, 'raw_' || max(version) FILTER (WHERE api = 'v2') AS path, max(version) + 1 AS next_version FROM v GROUP BY user_id""")
def latest_version(t):
    v = t("events").select("user_id", F.col("event_id").alias("version"), F.when(F.col("event_type").isin("view", "click"), "v2").otherwise("v1").alias("api"),
                           F.concat(L("raw_"), F.col("event_id").cast("string")).alias("path"))
    return R.latest_version(v, "user_id", "v2")


@query("keyed_upsert_sink", """SELECT id, model, tokens FROM (SELECT job_id || ':' || stage AS id, model, prompt_tokens + completion_tokens AS tokens,
  row_number() OVER (PARTITION BY job_id, stage ORDER BY event_id DESC) AS rn FROM v_usage) WHERE rn = 1""")
def keyed_upsert_sink(t):
    u = V.usage(t).select(F.concat(F.col("job_id").cast("string"), L(":"), "stage").alias("id"), "model",
                          (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), "event_id")
    early, late = u.where(F.col("event_id") % 2 == 0), u.where(F.col("event_id") % 2 == 1)
    path = scratch(t, "upsert")
    for epoch, part in enumerate((early, late)):
        sinks.upsert_buckets(part, path, epoch, ["id"], "event_id")
    return sinks.read_buckets(t.spark, path, u.schema).drop("event_id")
