"""The corpus operators as registered queries over the whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import (
    chosen_path, context_tree, cover_tree, decontaminate, dual_tree, fuzzy_lines, hd_language, kneser_ney, pareto_mix, piece_table, quality_rules,
    token_counts, token_files,
)
from inkstone.llm.common import documents

CONTEXT = 1024  # tokens of a training context
END_ID = 2  # appended to each document


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "web-2"), "base-1", "base_kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = token_counts.prefix_table(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), width=2, threshold=80)


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.fresh_folder(spark)
    token_files.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), END_ID, folder)
    return token_files.digests(spark, folder)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_language.identify(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.cross_validated(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuzzy_lines.dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines_dropped", F.sha2("text", 256).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = cover_tree.candidates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id"), label, F.col("embedding"))
    return cover_tree.hard_negatives(rows, F.col("id") % 50 == 0)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_quality_classifier, op3_benchmark_decontamination, op4_token_counts, op5_minhash_near_dedup,
    op6_token_id_output, op7_language_id, op8_lm_scoring, op9_sentencepiece, op10_line_dedup,
    op11_hard_negatives, op12_source_mix, op13_lexical_search)}

WORD = r"[^ \t\n\x0B\f\r]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT r, unnest(CASE WHEN len(w) < 3 THEN [] ELSE range(1, len(w) - 1) END) AS p, w FROM m),
t AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM t WHERE n > 1) GROUP BY r),
f AS (SELECT m.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '\p{{L}}+', '', 'g')) AS n_letters
      FROM m LEFT JOIN c USING (r)),
b AS (SELECT *, coalesce(chars, 0) AS word_chars FROM f),
k AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 12 * n_words)::BIGINT
        + 64 * (2 * n_upper > n_letters AND n_letters > 0)::BIGINT AS failed_bits FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM k""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.a""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, label, v FROM e WHERE vec_id % 50 = 0),
s AS (SELECT row_number() OVER () AS r, a.vec_id AS anchor_id, a.label AS own, a.v AS av, e.vec_id, e.label, list_dot_product(a.v, e.v)::BIGINT AS score
      FROM a, e WHERE a.vec_id <> e.vec_id),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id, own, av ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.r, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.r ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.av = p.av AND s.label <> s.own
      WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_source_mix": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size / w AS bar, sum(w) OVER () AS wt, 1.5::DOUBLE * sum(source_size) OVER () AS t,
        coalesce(sum(2::DOUBLE * source_size) OVER o, 0) AS cut, coalesce(sum(w) OVER o, 0) AS gone FROM s
      WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((t - cut) / (wt - gone), bar) FILTER (bar >= (t - cut) / (wt - gone)) AS level FROM c),
g AS (SELECT source, source_size, least(w * level, 2::DOUBLE * source_size) AS target FROM c, l),
k AS (SELECT source, 1::DOUBLE / (1::BIGINT << ((length(bin(size)) - 1) // 4)::BIGINT) AS lean, sum(size)::DOUBLE AS words FROM d WHERE size > 0 GROUP BY ALL),
h AS (SELECT k.*, target, coalesce(sum(2 * words) OVER o, 0) AS cut, coalesce(sum(lean * words) OVER o, 0) AS gone, sum(lean * words) OVER (PARTITION BY k.source) AS wt
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source WINDOW o AS (PARTITION BY k.source ORDER BY lean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT source, min_by((target - cut) / (wt - gone), 2 / lean) FILTER (2 / lean >= (target - cut) / (wt - gone)) AS level FROM h GROUP BY source),
e AS (SELECT h.source, h.lean, least(h.lean * v.level, 2::DOUBLE) AS e FROM h JOIN v ON h.source IS NOT DISTINCT FROM v.source),
f AS (SELECT d.*, 1::DOUBLE / (1::BIGINT << ((length(bin(size)) - 1) // 4)::BIGINT) AS lean, target, 64 * size > target AS long FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE size > 0),
x AS (SELECT f.*, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM f JOIN e ON f.source IS NOT DISTINCT FROM e.source AND e.lean = f.lean WHERE long),
q AS (SELECT x.*, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS z FROM x WHERE p > 0),
n0 AS (SELECT source, any_value(target) AS target, sum(CASE WHEN long THEN 0 ELSE size END) AS short FROM f GROUP BY source),
n1 AS (SELECT n0.source, n0.target, short, coalesce(any_value(h.given), 0) AS given, coalesce(any_value(h.share), 0) AS share FROM n0 LEFT JOIN
       (SELECT source, sum(whole * size) AS given, sum(p * size) AS share FROM x GROUP BY source) h ON h.source IS NOT DISTINCT FROM n0.source GROUP BY n0.source, n0.target, short),
n2 AS (SELECT *, target - given - 2 * short AS need, greatest(share, target - given - 2 * short) AS want FROM n1),
a1 AS (SELECT q.*, want, need, sum(size) OVER (PARTITION BY q.source ORDER BY z, doc_id, size ROWS UNBOUNDED PRECEDING) <= want AS fits FROM q JOIN n2 ON q.source IS NOT DISTINCT FROM n2.source),
a2 AS (SELECT *, want - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS rest, need - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) > 0 AS must FROM a1),
a3 AS (SELECT r, source, size FROM a2 WHERE fits UNION ALL SELECT r, source, size FROM (SELECT * FROM a2 WHERE NOT fits AND (must OR abs(rest - size) < rest)
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(rest - size), z, r) = 1)),
n3 AS (SELECT n2.source, n2.short, any_value(target) - any_value(given) - coalesce(sum(a3.size), 0) AS rest FROM n2 LEFT JOIN a3 ON a3.source IS NOT DISTINCT FROM n2.source GROUP BY n2.source, n2.short),
k2 AS (SELECT f.source, lean, sum(size)::DOUBLE AS words, least(greatest(any_value(rest), 0), 2::DOUBLE * any_value(short)) AS total FROM f JOIN n3 ON f.source IS NOT DISTINCT FROM n3.source WHERE NOT long GROUP BY f.source, lean),
h2 AS (SELECT *, coalesce(sum(2 * words) OVER o, 0) AS cut, coalesce(sum(lean * words) OVER o, 0) AS gone, sum(lean * words) OVER (PARTITION BY source) AS wt
       FROM k2 WINDOW o AS (PARTITION BY source ORDER BY lean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v2 AS (SELECT source, coalesce(min_by((total - cut) / (wt - gone), 2 / lean) FILTER (2 / lean >= (total - cut) / (wt - gone)), max(2 / lean)) AS level FROM h2 GROUP BY source),
x2 AS (SELECT f.*, floor(least(f.lean * level, 2::DOUBLE))::BIGINT AS whole, least(f.lean * level, 2::DOUBLE) - floor(least(f.lean * level, 2::DOUBLE)) AS p FROM f JOIN v2 ON f.source IS NOT DISTINCT FROM v2.source WHERE NOT long),
q2 AS (SELECT x2.*, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS z FROM x2 WHERE p > 0),
n4 AS (SELECT n3.source, any_value(rest) - coalesce(sum(whole * size), 0) AS rest FROM n3 LEFT JOIN x2 ON x2.source IS NOT DISTINCT FROM n3.source GROUP BY n3.source),
b0 AS (SELECT r, doc_id, source, size, long, z FROM q2 UNION ALL SELECT r, doc_id, source, size, long, z FROM q WHERE r NOT IN (SELECT r FROM a3)),
b1 AS (SELECT b0.*, rest, NOT long AND sum(CASE WHEN long THEN 0 ELSE size END) OVER (PARTITION BY b0.source ORDER BY z, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM b0 JOIN n4 ON b0.source IS NOT DISTINCT FROM n4.source),
c0 AS (SELECT * EXCLUDE (rest), rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS rest FROM b1),
c1 AS (SELECT * EXCLUDE (fits), size <= rest AND sum(CASE WHEN size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY z, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS fits FROM c0 WHERE NOT fits),
e0 AS (SELECT * EXCLUDE (rest), rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0) AS rest FROM c1),
e1 AS (SELECT r FROM e0 WHERE NOT fits AND abs(rest - size) < rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(rest - size), z, r) = 1),
w AS (SELECT r, whole FROM x UNION ALL SELECT r, whole FROM x2),
y AS (SELECT r FROM a3 UNION ALL SELECT r FROM b1 WHERE fits UNION ALL SELECT r FROM c1 WHERE fits UNION ALL SELECT r FROM e1)
SELECT d.doc_id, d.size, g.source_size, g.target, (coalesce(w.whole, 0) + (y.r IS NOT NULL)::BIGINT) * d.size AS taken, coalesce(w.whole, 0) + (y.r IS NOT NULL)::BIGINT AS copies
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN w ON d.r = w.r LEFT JOIN y ON d.r = y.r""",
    "op13_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS i, item_id, t FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t, text FROM benchmark WHERE text IS NOT NULL)),
n AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
f AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf, any_value(m) AS m FROM (SELECT r, doc_id, unnest(d.t) AS t, 75 + (25 * len(d.t) * n.n) // n.l AS m FROM d, n) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, n GROUP BY t),
b AS (SELECT i, any_value(item_id) AS item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(i.t) AS t FROM i) GROUP BY i, t),
s AS (SELECT b.i, any_value(b.item_id) AS item_id, f.r, any_value(f.doc_id) AS doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM b JOIN w USING (t) JOIN f USING (t) GROUP BY b.i, f.r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
}
