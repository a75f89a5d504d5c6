"""Derived views over the given tables, each with its SQL twin.

They stand in for the knowledge tables (chunks, entities, edges, sections, votes, jobs, ...).
Per-document views are keyed by ``doc_id``; nothing here pairs all members of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.plans.registry import Tables, view_sql

CHUNK, OVERLAP = 120, 10

# ---------------------------------------------------------------- chunks, terms, mentions


def chunks(t: Tables) -> DataFrame:
    """(doc_id, chunk_no, text, n_tokens): verbatim token windows of each document."""
    return t("documents").select("doc_id", F.inline(X.chunk_tokens(F.col("text"), CHUNK, OVERLAP)))


view_sql("v_piece", r"""SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS p FROM documents""")
view_sql("v_chunk", r"""SELECT doc_id, CAST(s // 110 AS INTEGER) AS chunk_no, array_to_string(p[s+1:s+120], '') AS text,
  CAST(least(120, len(p) - s) AS INTEGER) AS n_tokens
  FROM (SELECT doc_id, p, unnest(range(0, len(p), 110)) AS s FROM v_piece)""")


def terms(t: Tables) -> DataFrame:
    """Distinct words as they are written: the entity dictionary."""
    return t("benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("title")
    ).distinct()


view_sql("v_term", r"""SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS title FROM benchmark""")


def mentions(t: Tables) -> DataFrame:
    return t.stored("mentions", lambda: build_mentions(t))


def build_mentions(t: Tables) -> DataFrame:
    """(doc_id, chunk_no, pos, title): dictionary words in chunk order (equi join on the word)."""
    toks = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))
    words = (
        chunks(t).select("doc_id", "chunk_no", toks.alias("w"))
        # the outer form: before the other one Spark sets a filter that finds the words twice more
        .select("doc_id", "chunk_no", F.posexplode_outer("w").alias("pos", "title"))
    )
    return words.join(terms(t), "title", "left_semi").select("doc_id", "chunk_no", "pos", "title")


view_sql("v_tok", r"""SELECT doc_id, chunk_no, unnest(w) AS title, CAST(unnest(range(len(w))) AS INTEGER) AS pos FROM
  (SELECT doc_id, chunk_no, regexp_extract_all(text, '\p{L}+') AS w FROM v_chunk)""")
view_sql("v_mention", "SELECT doc_id, chunk_no, pos, title FROM v_tok SEMI JOIN v_term USING (title)")


def occurrences(t: Tables) -> DataFrame:
    """(doc_id, title, chunk_no): which chunks each document entity is listed in."""
    return mentions(t).select("doc_id", "title", "chunk_no").distinct()


view_sql("v_occ", "SELECT DISTINCT doc_id, title, chunk_no FROM v_mention")


def edges(t: Tables) -> DataFrame:
    return t.stored("edges", lambda: build_edges(t))


def build_edges(t: Tables) -> DataFrame:
    """(doc_id, source, target, weight): neighbouring mentions inside a chunk, undirected.

    The window is one chunk (at most 120 words), so it never sees an unbounded group. The rows are dealt by document,
    which serves the window and the sums after it.
    """
    w = Window.partitionBy("doc_id", "chunk_no").orderBy("pos")
    nxt = mentions(t).repartition("doc_id").withColumn("nxt", F.lead("title").over(w)).where(F.col("nxt") != F.col("title"))
    return (
        nxt.groupBy("doc_id", F.least("title", "nxt").alias("source"), F.greatest("title", "nxt").alias("target"))
        .agg(F.count("*").cast("double").alias("weight"))
    )


view_sql("v_edge", """SELECT doc_id, least(title, nxt) AS source, greatest(title, nxt) AS target, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT *, lead(title) OVER (PARTITION BY doc_id, chunk_no ORDER BY pos) AS nxt FROM v_mention)
  WHERE nxt <> title GROUP BY ALL""")


def graph(t: Tables) -> DataFrame:
    """(source, target, weight): the same edges over the whole corpus."""
    return edges(t).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


view_sql("v_graph", "SELECT source, target, sum(weight) AS weight FROM v_edge GROUP BY ALL")


def entities(t: Tables) -> DataFrame:
    return t.stored("entities", lambda: build_entities(t))


def build_entities(t: Tables) -> DataFrame:
    """(doc_id, title, type, frequency, degree): one row per document entity, from one deal of its edges and chunks by document."""
    ends = edges(t).select("doc_id", F.explode(F.array("source", "target")).alias("title"), F.lit(None).cast("int").alias("chunk_no"))
    rows = ends.unionByName(mentions(t).select("doc_id", "title", "chunk_no")).repartition("doc_id")
    per = rows.groupBy("doc_id", "title", "chunk_no").agg(F.count("*").cast("int").alias("n"))
    end = F.col("chunk_no").isNull()
    return per.groupBy("doc_id", "title").agg(F.count("chunk_no").cast("int").alias("frequency"), F.coalesce(F.max(F.when(end, F.col("n"))), F.lit(0)).alias("degree")).select(
        "doc_id", "title", F.concat(F.lit("type"), (F.length("title") % 5).cast("string")).alias("type"), "frequency", "degree")


view_sql("v_deg", """SELECT doc_id, title, CAST(count(*) AS INTEGER) AS degree FROM
  (SELECT doc_id, source AS title FROM v_edge UNION ALL SELECT doc_id, target FROM v_edge) GROUP BY ALL""")
view_sql("v_ent", """SELECT o.doc_id, o.title, 'type' || (length(o.title) % 5) AS type, o.frequency, coalesce(d.degree, 0) AS degree
  FROM (SELECT doc_id, title, CAST(count(*) AS INTEGER) AS frequency FROM v_occ GROUP BY ALL) o
  LEFT JOIN v_deg d USING (doc_id, title)""")

# ---------------------------------------------------------------- sections and rooms


def markers(t: Tables) -> DataFrame:
    """(doc_id, idx, name, start_marker): the first words of every fifth line of a document."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return lines.where(F.col("line") % 5 == 0).select(
        "doc_id", (F.col("line") / 5).cast("int").alias("idx"),
        F.concat(F.lit("sec"), (F.col("line") / 5).cast("int").cast("string")).alias("name"),
        F.col("s").alias("start_marker"),
    )


view_sql("v_line", r"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS s FROM
  (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
view_sql("v_marker", "SELECT doc_id, line // 5 AS idx, 'sec' || (line // 5) AS name, s AS start_marker FROM v_line WHERE line % 5 = 0")


def sections(t: Tables) -> DataFrame:
    return t.stored("sections", lambda: build_sections(t))


def build_sections(t: Tables) -> DataFrame:
    """(doc_id, idx, name, start_offset, end_offset): every fifth line opens a section.

    The running length is summed per document over one narrow row per line.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = t("documents").select("doc_id", F.length("text").alias("n_text"),
                                  F.transform(F.split("text", "\n"), F.length).alias("lens"))
    rows = lines.select("doc_id", "n_text", F.posexplode("lens").alias("line", "len"))
    off = rows.withColumn(
        "start_offset",
        F.coalesce(F.sum(F.col("len") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"),
    ).where(F.col("line") % 5 == 0)
    return off.select(
        "doc_id", (F.col("line") / 5).cast("int").alias("idx"),
        F.concat(F.lit("sec"), (F.col("line") / 5).cast("int").cast("string")).alias("name"),
        "start_offset",
        F.coalesce(F.lead("start_offset").over(w), F.col("n_text")).alias("end_offset"),
    )


view_sql("v_section", """SELECT doc_id, idx, name, start_offset,
    coalesce(lead(start_offset) OVER (PARTITION BY doc_id ORDER BY idx), n_text) AS end_offset
  FROM (SELECT l.doc_id, line, line // 5 AS idx, 'sec' || (line // 5) AS name, CAST(length(d.text) AS INTEGER) AS n_text,
    CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY l.doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_offset
    FROM v_line l JOIN documents d ON d.doc_id = l.doc_id) WHERE line % 5 = 0""")

# ---------------------------------------------------------------- votes, anchors


def votes(t: Tables) -> DataFrame:
    """(run, room, title, ord, keep): n-run votes; ``ord`` is the order inside the run."""
    e = t("events")
    drift = F.when(F.col("user_id") % 7 == 0, F.col("event_id") % 3).otherwise(0)
    return e.groupBy(
        (F.col("event_id") % 3).cast("int").alias("run"), ((F.col("user_id") + drift) % 10).cast("int").alias("room"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("title"),
    ).agg(F.min("event_id").alias("ord"), (F.max("value") > 24).alias("keep"))


view_sql("v_vote", """SELECT CAST(event_id % 3 AS INTEGER) AS run, CAST((user_id + CASE WHEN user_id % 7 = 0 THEN event_id % 3 ELSE 0 END) % 10 AS INTEGER) AS room, 'u' || user_id AS title,
  min(event_id) AS ord, max(value) > 24 AS keep FROM events GROUP BY ALL""")


def anchors(t: Tables) -> DataFrame:
    """(title, should): quality rows should be shown, toxic rows should be demoted."""
    lab = t("labels")
    return lab.where((F.col("quality") == 1) | (F.col("toxic") == 1)).select(
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("toxic") == 1, "demote").otherwise("keep").alias("should"),
    )


view_sql("v_anchor", """SELECT 'u' || doc_id AS title, CASE WHEN toxic = 1 THEN 'demote' ELSE 'keep' END AS should
  FROM labels WHERE quality = 1 OR toxic = 1""")

# ---------------------------------------------------------------- usage, jobs, questions

_MODEL = {"view": "gpt-4.1-mini", "click": "gpt-4.1", "purchase": "gpt-5.4-mini", "signup": "gpt-5.4"}
_STATE = {"signup": "QUEUED", "view": "PREPROCESSING", "click": "INDEXING", "purchase": "DONE", "error": "FAILED"}


def _mapped(col: str, table: dict[str, str], default: str):
    out = None
    for k, v in table.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out.otherwise(default)


def _mapped_sql(col: str, table: dict[str, str], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def usage(t: Tables) -> DataFrame:
    """(event_id, ts, job_id, stage, model, prompt_tokens, completion_tokens): one row per call."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"),
        F.concat(F.lit("stage"), (F.col("event_id") % 4).cast("string")).alias("stage"),
        _mapped("event_type", _MODEL, "unlisted-model").alias("model"),
        (k * 100).alias("prompt_tokens"), (k + 1).alias("completion_tokens"),
    )


view_sql("v_usage", f"""SELECT event_id, ts, user_id AS job_id, 'stage' || (event_id % 4) AS stage,
  {_mapped_sql('event_type', _MODEL, 'unlisted-model')} AS model,
  CAST(props->>'k' AS BIGINT) * 100 AS prompt_tokens, CAST(props->>'k' AS BIGINT) + 1 AS completion_tokens FROM events""")


def job_log(t: Tables) -> DataFrame:
    """(job_id, ts, event_id, state, toc_ready, rooms_ready, rag_ready): append-only job updates."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        _mapped("event_type", _STATE, "QUEUED").alias("state"),
        (k % 2 == 0).alias("toc_ready"), (k % 5 == 0).alias("rooms_ready"), (k % 7 == 0).alias("rag_ready"),
    )


view_sql("v_job_log", f"""SELECT user_id AS job_id, ts, event_id, {_mapped_sql('event_type', _STATE, 'QUEUED')} AS state,
  CAST(props->>'k' AS INTEGER) % 2 = 0 AS toc_ready, CAST(props->>'k' AS INTEGER) % 5 = 0 AS rooms_ready,
  CAST(props->>'k' AS INTEGER) % 7 = 0 AS rag_ready FROM events""")


def questions(t: Tables) -> DataFrame:
    """(conv_id, turn, question): user turns."""
    return t("conversations").where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


view_sql("v_question", "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'")


def answers(t: Tables) -> DataFrame:
    """(conv_id, turn, answer): assistant turns with citation tags appended."""
    c, n = F.col("conv_id"), F.col("turn")
    tag = F.concat(
        F.lit(" [Data: Reports ("), c.cast("string"), F.lit(", "), (c + n).cast("string"),
        F.lit(", +more); Entities ("), (c * 7).cast("string"), F.lit("); Relationships ("),
        (c * 3).cast("string"), F.lit(","), c.cast("string"), F.lit("); Sources ("),
        c.cast("string"), F.lit(")]"),
    )
    return t("conversations").where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.concat("text", tag).alias("answer"))


view_sql("v_answer", """SELECT conv_id, turn, text || ' [Data: Reports (' || conv_id || ', ' || (conv_id + turn)
  || ', +more); Entities (' || (conv_id * 7) || '); Relationships (' || (conv_id * 3) || ',' || conv_id
  || '); Sources (' || conv_id || ')]' AS answer FROM conversations WHERE role = 'assistant'""")

# ---------------------------------------------------------------- communities and reports


def communities(t: Tables) -> DataFrame:
    """(community, level, parent, title): regions above nations above suppliers."""
    r = t("region").select(F.col("r_regionkey").cast("long").alias("community"), F.lit(0).alias("level"), F.lit(-1).cast("long").alias("parent"), F.col("r_name").alias("title"))
    n = t("nation").select((F.col("n_nationkey") + 100).cast("long").alias("community"), F.lit(1).alias("level"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("title"))
    s = t("supplier").select((F.col("s_suppkey") + 1000).alias("community"), F.lit(2).alias("level"), (F.col("s_nationkey") + 100).cast("long").alias("parent"), F.col("s_name").alias("title"))
    return r.unionByName(n).unionByName(s)


view_sql("v_community", """SELECT CAST(r_regionkey AS BIGINT) AS community, 0 AS level, CAST(-1 AS BIGINT) AS parent, r_name AS title FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), 1, CAST(n_regionkey AS BIGINT), n_name FROM nation
  UNION ALL SELECT s_suppkey + 1000, 2, CAST(s_nationkey + 100 AS BIGINT), s_name FROM supplier""")


def members(t: Tables) -> DataFrame:
    return t.stored("members", lambda: build_members(t))


def build_members(t: Tables) -> DataFrame:
    """(community, level, title, degree): customers are the entities of their nation and region.

    Membership stays in rows; a community may hold a third of all entities.
    """
    deg = t("orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("degree"))
    c = (
        t("customer").join(deg, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type"), F.coalesce("degree", F.lit(0)).alias("degree"),
                (F.col("c_nationkey") + 100).cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    )
    both = F.array(F.struct(F.col("r").alias("community"), F.lit(0).alias("level")), F.struct(F.col("n").alias("community"), F.lit(1).alias("level")))
    return c.select("id", "title", "type", "degree", F.inline(both))


view_sql("v_customer", """SELECT c_custkey AS id, c_name AS title, c_mktsegment AS type, CAST(coalesce(d.n, 0) AS INTEGER) AS degree, CAST(c_nationkey + 100 AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) d ON d.o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""")
view_sql("v_member", """SELECT id, title, type, degree, r AS community, 0 AS level FROM v_customer UNION ALL SELECT id, title, type, degree, n, 1 FROM v_customer""")


def reports(t: Tables) -> DataFrame:
    """(human_readable_id, community, level, title, summary): one report per community."""
    return communities(t).select(
        (F.col("community") + 7).alias("human_readable_id"), "community", "level",
        F.concat(F.lit("Report on "), "title").alias("title"), F.concat(F.lit("About "), "title", F.lit(".")).alias("summary"))


view_sql("v_report", "SELECT community + 7 AS human_readable_id, community, level, 'Report on ' || title AS title, 'About ' || title || '.' AS summary FROM v_community")

# ---------------------------------------------------------------- rooms with status

BUDGET = 3


def rooms(t: Tables) -> DataFrame:
    return t.stored("rooms", lambda: build_rooms(t))


def build_rooms(t: Tables) -> DataFrame:
    """(doc_id, section, title, pos, pos_source, degree, rank, status): members of every section.

    ``kept`` is the best ``BUDGET`` members of a section by degree; the window is one section of
    one document.
    """
    from inkstone.plans.positions import ordered

    w = Window.partitionBy("doc_id", "section").orderBy(F.desc("graph_degree"), "title")
    m = ordered(t).withColumn("status", F.when(F.row_number().over(w) <= BUDGET, "kept").otherwise("demoted"))
    return m.select("doc_id", "section", "title", "pos", "pos_source", F.col("graph_degree").alias("degree"), "rank", "status")


view_sql("v_room", """SELECT doc_id, section, title, pos, pos_source, graph_degree AS degree, rank,
  CASE WHEN row_number() OVER (PARTITION BY doc_id, section ORDER BY graph_degree DESC, title) <= 3 THEN 'kept' ELSE 'demoted' END AS status FROM v_member_order""")
