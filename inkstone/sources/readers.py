"""Sources: knowledge tables, vectors, page-marked text, figure lists, usage logs, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions import text as X
from inkstone.functions import vectors as VEC

SNAPSHOT_TABLES = ("documents", "text_units", "entities", "relationships", "communities", "community_reports")
OPTIONAL_TABLES = {"covariates": "id string, human_readable_id long, subject_id string, type string, description string"}


def read_snapshot(spark: SparkSession, root: str, present: set[str]) -> dict[str, DataFrame]:
    """The six tables; optional ones are empty frames with their schema when absent."""
    missing = [n for n in SNAPSHOT_TABLES if n not in present]
    if missing:
        raise FileNotFoundError(f"snapshot {root} lacks {missing}")
    out = {n: spark.read.parquet(f"{root}/{n}") for n in SNAPSHOT_TABLES}
    for name, schema in OPTIONAL_TABLES.items():
        out[name] = spark.read.parquet(f"{root}/{name}") if name in present else spark.createDataFrame([], schema)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows): parquet footers answer each count; one row per table is unioned."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def entity_vectors(entities: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Entities with their vectors; a single missing vector fails the job."""
    joined = entities.join(vectors, key, "left")
    return joined.withColumn(
        vector, F.when(F.col(vector).isNull(), F.raise_error(F.concat(F.lit("entity without vector: "), F.col(key).cast("string"))))
        .otherwise(F.col(vector)))


def align_vectors(entities: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Inner join: entities without a vector are dropped; vectors are scaled to unit length."""
    return entities.join(vectors, key).withColumn(vector, VEC.normalize(F.col(vector), floor=1e-9))


def missing_vectors(entities: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return entities.join(vectors.select(key), key, "left_anti").agg(F.count("*").alias("missing"))


def read_whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text): every file is one document."""
    return spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


#: Ends a record of a corpus file, and parts a record's key from its text; neither occurs in text.
RECORD_END, KEY_END = "\x1e\n", "\x1f"


def read_records(spark: SparkSession, folder: str, parts: str) -> DataFrame:
    """(parts.., key, text): one row per document of the corpus files in ``folder``, which ``parts`` name the partitions of."""
    rows = spark.read.schema(f"value string, {parts}").option("lineSep", RECORD_END).text(folder)
    return rows.select(*[c for c in rows.columns if c != "value"], F.split_part("value", F.lit(KEY_END), F.lit(1)).alias("key"),
                       F.expr(f"substring(value, locate('{KEY_END}', value) + 1)").alias("text"))


def captions_scan(df: DataFrame, key: str, col: str, tag: str = "figcaption") -> DataFrame:
    """Trimmed bodies of every ``<tag>..</tag>`` in order."""
    found = F.regexp_extract_all(col, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return df.select(key, F.posexplode(F.transform(found, X.strip)).alias("pos", "caption"))


FIGURE_SCHEMA = "id string, page string, path string, img_path string, caption string, caption_title string"


def figures_from_json(lines: DataFrame, col: str) -> DataFrame:
    """Figure rows from JSON arrays; rows without an image path are skipped, page defaults to 0."""
    arr = F.from_json(col, f"array<struct<{FIGURE_SCHEMA.replace(' string', ':string')}>>")
    f = lines.select(F.inline(arr))
    path = F.coalesce(F.nullif("img_path", F.lit("")), F.nullif("path", F.lit("")))
    name = X.figure_name(path)
    return f.where(path.isNotNull()).select(
        "id", F.coalesce(F.expr("try_cast(page AS int)"), F.lit(0)).alias("page"),
        F.coalesce(name["idx"], F.lit(0)).alias("idx"), path.alias("img_path"),
        F.coalesce("caption", F.lit("")).alias("caption"))


ANALYZER_SCHEMA = (
    "struct<contents:array<struct<paragraphs:array<struct<role:string>>,figures:array<struct<id:string,elements:array<string>>>,"
    "pages:array<struct<figures:array<struct<id:string,elements:array<string>>>>>>>>"
)


def analyzer_figures(docs: DataFrame, key: str, col: str, dropped_roles=("pageHeader", "pageFooter")) -> DataFrame:
    """Figures of both nesting levels; dropped when they name paragraphs and all are page furniture."""
    c = docs.select(key, F.explode(F.from_json(col, ANALYZER_SCHEMA)["contents"]).alias("c"))
    inner = F.flatten(F.transform(F.coalesce("c.pages", F.array()), lambda p: F.coalesce(p["figures"], F.array())))
    figs = c.select(key, F.col("c.paragraphs.role").alias("roles"), F.explode(F.concat(F.coalesce("c.figures", F.array()), inner)).alias("f"))
    refs = F.transform(
        F.filter(F.coalesce("f.elements", F.array()), lambda e: e.rlike(r"^/paragraphs/\d+$")),
        lambda e: F.get(F.col("roles"), F.regexp_extract(e, r"(\d+)$", 1).cast("int")))
    furniture = (F.size(refs) > 0) & F.forall(refs, lambda r: F.coalesce(r.isin(*dropped_roles), F.lit(False)))
    return figs.where(~furniture).select(key, F.col("f.id").alias("figure_id"), F.size(refs).alias("n_refs"))


USAGE_SCHEMA = "model string, prompt_tokens long, completion_tokens long, _bad string"


def parse_usage_lines(lines: DataFrame, col: str) -> DataFrame:
    """One usage row per good JSON line; blank and broken lines are skipped, defaults filled in."""
    u = F.from_json(col, USAGE_SCHEMA, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    good = lines.where(X.strip(F.col(col)) != "").withColumn("u", u).where(F.col("u").isNotNull() & F.col("u._bad").isNull())
    return good.withColumns({
        "model": F.coalesce("u.model", F.lit("?")),
        "prompt_tokens": F.coalesce("u.prompt_tokens", F.lit(0)), "completion_tokens": F.coalesce("u.completion_tokens", F.lit(0)),
    }).drop("u")


def cache_tokens(files: DataFrame, col: str) -> DataFrame:
    """Totals of cached responses: rows with completion tokens are chat, the others embedding."""
    def first(field: str) -> Column:
        return F.coalesce(*[F.get_json_object(col, f"$.{p}.{field}") for p in ("result.response.usage", "result.usage", "usage")]).cast("long")

    u = files.select(F.coalesce(first("prompt_tokens"), F.lit(0)).alias("p"), F.coalesce(first("completion_tokens"), F.lit(0)).alias("c"),
                     first("total_tokens").alias("t"))
    kind = F.when(F.col("c") > 0, "chat").otherwise("embedding")
    return u.where("t is not null or p > 0 or c > 0").groupBy(kind.alias("kind")).agg(
        F.count("*").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))


def _children(nodes: Column) -> Column:
    """The values inside an array of VARIANT objects and lists; other values have none."""
    none = F.array().cast("array<variant>")

    def inside(v: Column) -> Column:
        return F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), none)

    return F.flatten(F.transform(nodes, inside))


def deep_usage(lines: DataFrame, key: str, col: str, depth: int = 6) -> DataFrame:
    """(key, kind, prompt_tokens, completion_tokens, total_tokens) of the usage objects at most ``depth`` levels down.

    Each object and list is a level; the document itself is level 0. An object with prompt and completion counts is a
    model call, one with prompt and total counts alone an embedding call, whatever else it holds. Broken JSON has none.
    The document is parsed once and its levels are walked inside its row.
    """
    levels = lines.select(key, F.array(F.try_parse_json(col)).alias("l0"))
    for k in range(depth):
        levels = levels.withColumn(f"l{k + 1}", _children(F.col(f"l{k}")))
    nodes = levels.select(key, F.explode(F.concat(*[f"l{k}" for k in range(depth + 1)])).alias("o"))

    def has(name: str) -> Column:  # a null count is there too
        return F.try_variant_get("o", f"$.{name}", "variant").isNotNull()

    def count(name: str) -> Column:
        return F.try_variant_get("o", f"$.{name}", "long")

    call = has("completion_tokens")
    return nodes.where(has("prompt_tokens") & (call | has("total_tokens"))).select(
        key, F.when(call, "llm").otherwise("embed").alias("kind"), F.coalesce(count("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.when(call, F.coalesce(count("completion_tokens"), F.lit(0))).otherwise(F.lit(0)).alias("completion_tokens"), count("total_tokens").alias("total_tokens"))


def index_stats(docs: DataFrame, key: str, col: str) -> DataFrame:
    """Workflow map flattened to rows with each workflow's share of the run total."""
    s = F.from_json(col, "total_runtime double, workflows map<string,struct<overall:double,peak_memory_bytes:long,memory_delta_bytes:long>>")
    rows = docs.select(key, s.alias("s")).select(key, F.col("s.total_runtime").alias("total"), F.explode("s.workflows").alias("workflow", "w"))
    return rows.select(key, "workflow", F.col("w.overall").alias("overall"), F.col("w.peak_memory_bytes").alias("peak"),
                       F.col("w.memory_delta_bytes").alias("delta"), (F.col("w.overall") / F.col("total")).alias("share"))


def md_match_rows(lines: DataFrame, col: str) -> DataFrame:
    """The eight-column match table of a markdown report; '-' becomes null."""
    g = [F.regexp_extract(col, K.MATCH_ROW, i) for i in range(1, 9)]
    text = [F.nullif(x, F.lit("-")) for x in g]
    return lines.where(F.col(col).rlike(K.MATCH_ROW)).select(
        g[0].cast("int").alias("row"), text[1].alias("path"), g[2].cast("int").alias("page"), text[3].alias("title"),
        text[4].alias("caption"), text[5].alias("tier"), text[6].cast("double").alias("score"),
        text[7].alias("match"))


def latest_version(df: DataFrame, key: str, wanted_api: str) -> DataFrame:
    """Per key: newest path of the wanted API version (null when none) and the next free number."""
    return df.groupBy(key).agg(
        F.max_by("path", F.when(F.col("api") == wanted_api, F.col("version"))).alias("path"),
        (F.max("version") + 1).alias("next_version"))


# which vector tables each search method opens
METHOD_STORES = (
    ("local", "entity_description"), ("drift", "entity_description"), ("drift", "community_full_content"), ("basic", "text_unit_text"),
)


def stores_for_method(requests: DataFrame, method: str) -> DataFrame:
    """Requests with the vector tables they need; methods needing none keep one row with null."""
    spark = requests.sparkSession
    stores = spark.createDataFrame(list(METHOD_STORES), "method string, store string")
    return requests.join(F.broadcast(stores), requests[method] == stores["method"], "left").drop(stores["method"])
