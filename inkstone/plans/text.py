"""Queries for the text projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions import text as X
from inkstone.operators import text_ops as O
from inkstone.plans import views as V
from inkstone.plans.registry import query, spread, view_sql

L = F.lit


def S(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sq(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  {e}, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), '[ \t\f\v\r]+\n', chr(10), 'g'), '[ \t\f\v\r]+$', ''),
  '^\n\n+', chr(10)), '\n\n\n+', chr(10) || chr(10), 'g'), '\n+$', '') || chr(10)"""

# inputs with untidy layout, page markers and comments, derived from every document


def untidy(t):
    """Documents with CRLF ends, trailing blanks and blank-line runs."""
    return t("documents").select("doc_id", F.replace(F.replace("text", L(". "), L(".  \r\n\n\n")), L("\n"), L("\t\n")).alias("text"))


view_sql("v_untidy", r"SELECT doc_id, replace(replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10)), chr(10), chr(9) || chr(10)) AS text FROM documents")


def paged(t):
    """Documents whose lines carry ``[pageN]`` markers; page numbers repeat in long documents."""
    lines = F.split("text", "\n")
    tagged = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(
        F.concat(L("[page"), (i % 7 + 1).cast("string"), L("]\n"), x)))
    return t("documents").select("doc_id", F.array_join(tagged, "\n").alias("text"))


view_sql("v_paged", """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN x
  ELSE '[page' || ((i - 1) % 7 + 1) || ']' || chr(10) || x END), chr(10)) AS text FROM documents""")


def commented(t):
    """Documents with page-range and page-break comments and some markup in front of their lines."""
    tagged = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when(i % 4 == 1, F.concat(L("<!-- page "), i.cast("string"), L("-99 -->")))
        .when(i % 4 == 2, L("<!-- PageBreak --># ")).when(i % 4 == 3, L("<table>\nx</table>• ")).otherwise(L("$a$")), x))
    return t("documents").select("doc_id", F.array_join(tagged, "\n").alias("text"))


view_sql("v_commented", """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE (i - 1) % 4
  WHEN 1 THEN '<!-- page ' || (i - 1) || '-99 -->' WHEN 2 THEN '<!-- PageBreak --># ' WHEN 3 THEN '<table>' || chr(10) || 'x</table>• '
  ELSE '$a$' END) || x), chr(10)) AS text FROM documents""")
# page comments by unnesting: the k-th break continues from the last range comment
view_sql("v_page_marked", r"""SELECT doc_id, string_agg(CASE WHEN i = 1 THEN p ELSE '[page' || (last + i - 1) || ']' || p END, '' ORDER BY i) AS text FROM (
  SELECT doc_id, last, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id,
    coalesce(CAST(regexp_extract_all(text, '<!--\s*page\s+(\d+)[–\-]\d+\s*-->', 1)[-1] AS INTEGER), 1) AS last,
    string_split_regex(regexp_replace(text, '<!--\s*page\s+0*(\d+)[–\-]\d+\s*-->', '[page\1]', 'g'), '<!--\s*PageBreak\s*-->') AS p
    FROM v_commented)) GROUP BY doc_id""")


@query("clean_lines", f"SELECT doc_id, {CLEAN.format(e='text')} AS text FROM v_untidy")
def clean_lines(t):
    return untidy(t).select("doc_id", X.clean_lines(F.col("text")).alias("text"))


@query("clean_report", rf"""WITH c AS (SELECT doc_id, text, {CLEAN.format(e='text')} AS done FROM v_untidy)
  SELECT doc_id, length(text) AS chars_before, length(done) AS chars_after, length(done) - length(text) AS chars_delta,
  length(text) - length(replace(text, chr(10), '')) + 1 AS lines_before, length(done) - length(replace(done, chr(10), '')) AS lines_after,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: {S('x')} = '')) AS BIGINT) AS blank_before,
  CAST(len(list_filter(string_split(done, chr(10)), lambda x: {S('x')} = '')) AS BIGINT) AS blank_after FROM c""")
def clean_report(t):
    df = untidy(t).withColumn("done", X.clean_lines(F.col("text")))

    def lines(c):
        return F.length(c) - F.length(F.replace(c, L("\n"), L("")))

    def blank(c):
        return F.size(F.filter(F.split(c, "\n", -1), lambda x: X.strip(x) == ""))

    out = df.select(
        "doc_id", F.length("text").alias("chars_before"), F.length("done").alias("chars_after"),
        (F.length("done") - F.length("text")).alias("chars_delta"), (lines(F.col("text")) + 1).alias("lines_before"),
        lines(F.col("done")).alias("lines_after"), blank(F.col("text")).alias("blank_before"), blank(F.col("done")).alias("blank_after"))
    return out.select("doc_id", *[F.col(c).cast("long") for c in out.columns if c != "doc_id"])


MARKUP = [r"(?s)<table>.*?</table>", r"(?s)<figure>.*?</figure>"]
AFTER = [r"(?s)<!--.*?-->", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+?\$", r"(?m)^#{1,6}\s*", r"(?m)^[•·]\s*"]


def _chain(e: str, pats) -> str:
    for p in pats:
        e = f"regexp_replace({e}, '{p}', '', 'g')"
    return e


@query("strip_markup", rf"""WITH a AS (SELECT page_id, {_chain("replace(html, '<p>', '<p><!-- PageBreak -->' || chr(10) || '# ')", MARKUP)} AS x FROM pages),
  b AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p ELSE '[page' || i || ']' || p END, '' ORDER BY i) AS x
    FROM (SELECT page_id, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT page_id, string_split_regex(x, '<!--\s*PageBreak\s*-->') AS p FROM a)) GROUP BY page_id)
  SELECT page_id, {S(f"regexp_replace({_chain('x', AFTER)}, '{chr(92)}n{chr(92)}n{chr(92)}n+', chr(10) || chr(10), 'g')")} AS text FROM b""")
def strip_markup(t):
    src = F.replace("html", L("<p>"), L("<p><!-- PageBreak -->\n# "))
    return t("pages").select("page_id", X.strip_markup(src).alias("text"))


@query("page_markers", "SELECT doc_id, text FROM v_page_marked")
def page_markers(t):
    return commented(t).select("doc_id", X.page_markers(F.col("text")).alias("text"))


INLINE = r"(?mi)^(?:그림\s*\d+[.\s]|Figure\s*\d+[.\s])|(?:\|.*\|.{0,100})$"


@query("inline_captions", rf"""WITH s AS (SELECT doc_id, 'Figure 7. ' || replace(text, ', ', ' | ') AS x FROM documents)
  SELECT doc_id, regexp_replace(x, '{INLINE}', '', 'g') AS body, array_to_string(list_transform(regexp_extract_all(x, '{INLINE}'),
  lambda m: {S('m')}), '~') AS captions FROM s""")
def inline_captions(t):
    x = F.concat(L("Figure 7. "), F.replace("text", L(", "), L(" | ")))
    return t("documents").select("doc_id", X.without_inline_captions(x).alias("body"),
                                 F.array_join(X.inline_caption_list(x), "~").alias("captions"))


def leaked(t):
    """Documents whose lines hold one bar and a region name, with page breaks and blank lines."""
    return t("documents").select("doc_id", F.replace(F.replace(
        F.regexp_replace("text", r"(?m)^([^,\n]*), ", "$1 | 서울 "), L("!\n"), L("!\n\n")), L("?"), L("<!-- PageBreak -->")).alias("text"))


@query("body_captions", rf"""WITH d AS (SELECT doc_id, replace(replace(regexp_replace(text, '(?m)^([^,\n]*), ', '\1 | 서울 ', 'g'), '!' || chr(10), '!' || chr(10) || chr(10)), '?', '<!-- PageBreak -->') AS text FROM documents),
  l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM d)),
  f AS (SELECT *, {S('line')} AS s FROM l),
  g AS (SELECT *, s <> '' AND s[1] NOT IN ('#', '<', '|') AND len(regexp_extract_all(s, '[|ㅣ]')) = 1
      AND regexp_matches({S("regexp_replace(s, '^[^|ㅣ]*[|ㅣ]', '')")}, '^(?:{"|".join(K.CAPTION_REGIONS)})(?:[^\p{{L}}\p{{N}}_]|$)') AS cap,
      s = '' OR s[1] IN ('#', '<', '|') AS stop FROM f),
  h AS (SELECT *, sum(CASE WHEN cap OR stop THEN 1 ELSE 0 END) OVER w AS island, coalesce(sum(length(line) + 1) OVER p, 0) AS st,
      coalesce(sum(len(regexp_extract_all(line, '<!--\s*PageBreak\s*-->'))) OVER p, 0) AS br FROM g
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos), p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT doc_id, CAST(min(st) AS BIGINT) AS start, CAST(min(br) + 1 AS INTEGER) AS page, {sq("string_agg(s, ' ' ORDER BY pos)")} AS caption
  FROM h GROUP BY doc_id, island HAVING arg_min(cap, pos)""")
def body_captions(t):
    return O.body_captions(leaked(t))


FOOT = r"\s*\d{1,3}\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫIVXWvwx]+\s*\.\s*[가-힣][가-힣\s·]*$"


@query("strip_footer", rf"""SELECT doc_id, regexp_replace(regexp_replace(text || ' ' || (doc_id % 300) || ' V. 조선의 발전', '{FOOT}', ''), '\s+$', '') AS text FROM documents""")
def strip_footer(t):
    c = F.concat("text", L(" "), (F.col("doc_id") % 300).cast("string"), L(" V. 조선의 발전"))
    return t("documents").select("doc_id", X.strip_footer(c).alias("text"))


@query("compact_text", f"SELECT doc_id, {sq('text')}[1:900] AS text FROM documents")
def compact_text(t):
    return t("documents").select("doc_id", X.compact_text(F.col("text")).alias("text"))


@query("split_sentences", rf"""WITH p AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+'),
    lambda x: {sq('x')}[1:260]) AS a FROM documents),
  k AS (SELECT doc_id, list_filter(a, lambda x: length(x) >= 35)[1:18] AS a FROM p)
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS sentence FROM k""")
def split_sentences(t):
    return t("documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("summarize_list", rf"""WITH k AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS a FROM documents)
  SELECT doc_id, CASE WHEN len(a) = 0 THEN '없음' WHEN len(a) > 10 THEN array_to_string(a[1:10], ', ') || ' 외 ' || (len(a) - 10) || '개'
  ELSE array_to_string(a, ', ') END AS summary FROM k""")
def summarize_list(t):
    return t("documents").select("doc_id", X.summarize_list(F.split(F.replace("text", L("\n"), L(" ")), " ")).alias("summary"))


PART = "(으로|에서|에게|까지|부터|라고|은|는|이|가|을|를|의|에|로|와|과|도|만)$"


@query("tokenize_topic", rf"""WITH q AS (SELECT conv_id, turn, string_split_regex({S(r"regexp_replace(lower(replace(question, ' d', '는 설명 d')), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g')")}, '\s+') AS a FROM v_question),
  e AS (SELECT conv_id, turn, flatten(list_transform(a, lambda x: CASE WHEN regexp_replace(x, '{PART}', '') NOT IN ('', x) THEN [x, regexp_replace(x, '{PART}', '')] ELSE [x] END)) AS a FROM q),
  u AS (SELECT conv_id, turn, unnest(a) AS token, unnest(range(len(a))) AS i FROM e)
  SELECT conv_id, turn, token, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) - 1 AS INTEGER) AS pos FROM u
  WHERE length(token) >= 2 AND token NOT IN ('퀴즈','문제','생성','만들어줘','알려줘','설명','한국사') GROUP BY conv_id, turn, token""")
def tokenize_topic(t):
    q = F.replace("question", L(" d"), L("는 설명 d"))
    return V.questions(t).select("conv_id", "turn", F.posexplode(X.topic_tokens(q)).alias("pos", "token"))


@query("tokenize_space", rf"""WITH k AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS a FROM documents)
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS token FROM k""")
def tokenize_space(t):
    return t("documents").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "token"))


TITLE = "p_name || CASE p_partkey % 3 WHEN 0 THEN '(' || p_brand || ')' WHEN 1 THEN ' (' || p_type || ')' ELSE '(' || p_brand || ') ' || p_type END"


def titled(t):
    """Parts with parenthesised remarks at the end or in the middle of their names."""
    k = F.col("p_partkey") % 3
    tail = (F.when(k == 0, F.concat(L("("), "p_brand", L(")"))).when(k == 1, F.concat(L(" ("), "p_type", L(")")))
            .otherwise(F.concat(L("("), F.col("p_brand"), L(") "), F.col("p_type"))))
    return t("part").withColumn("title", F.concat("p_name", tail))


view_sql("v_titled", f"SELECT *, {TITLE} AS title FROM part")


@query("strip_trailing_paren", rf"SELECT p_partkey, {S(chr(114)+'egexp_replace(title, ' + chr(39) + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's*$' + chr(39) + ', ' + chr(39)*2 + ')')} AS title FROM v_titled")
def strip_trailing_paren(t):
    return titled(t).select("p_partkey", X.strip_trailing_paren(F.col("title")).alias("title"))


@query("split_joined_caption", rf"""WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' | ' || p_name || '(x) | ' || p_brand[1:5] WHEN 1 THEN title || ' | ' || p_type ELSE title END AS caption FROM v_titled),
  s AS (SELECT *, string_split_regex(caption, '\s*[|￨ㅣ]\s*') AS p FROM c),
  j AS (SELECT *, len(p) = 3 AND length(p[3]) BETWEEN 1 AND 6 AND contains(p[2], ' ') AS two FROM s),
  r AS (SELECT p_partkey, 0 AS part, p[1] AS title, CASE WHEN two THEN p[1] || ' | ' || split_part(p[2], ' ', 1) ELSE caption END AS caption FROM j
    UNION ALL SELECT p_partkey, 1, regexp_replace(p[2], '^[^ ]* ', ''), regexp_replace(p[2], '^[^ ]* ', '') || ' | ' || p[3] FROM j WHERE two)
  SELECT p_partkey, part, {S("regexp_replace(title, '" + r"\s*\([^)]*\)\s*$" + "', '')")} AS title, caption FROM r""")
def split_joined_caption(t):
    k = F.col("p_partkey") % 3
    cap = (F.when(k == 0, F.concat("p_name", L(" | "), "p_name", L("(x) | "), F.substring("p_brand", 1, 5)))
           .when(k == 1, F.concat("title", L(" | "), "p_type")).otherwise(F.col("title")))
    return titled(t).select("p_partkey", F.posexplode(X.joined_captions(cap)).alias("part", "c")).select(
        "p_partkey", "part", "c.title", "c.caption")


@query("split_printed_caption", rf"""WITH b AS (SELECT item_id, i, {sq('p')} AS x FROM (SELECT item_id, unnest(a) AS p, unnest(range(len(a))) AS i FROM
    (SELECT item_id, string_split_regex(replace(text, ' th', ' (th) | '), '[.,]') AS a FROM benchmark)))
  SELECT item_id, CAST(i AS INTEGER) AS part, x AS caption, CASE WHEN x = '' THEN '' WHEN regexp_matches(x, '[|￨ㅣ]') THEN {S("regexp_replace(x, '" + r"(?s)\s*[|￨ㅣ].*$" + "', '')")}
   WHEN length(x) > 30 OR regexp_matches(x, '(?:다|음|함|임|됨|요|이다|지도|문서)\.?$|[.。!?]$') THEN ''
   ELSE {S("regexp_replace(x, '" + r"\s*\([^)]*\)\s*$" + "', '')")} END AS title FROM b""")
def split_printed_caption(t):
    parts = F.split(F.replace("text", L(" th"), L(" (th) | ")), "[.,]", -1)
    rows = t("benchmark").select("item_id", F.posexplode(parts).alias("part", "p"))
    return rows.withColumn("c", X.printed_caption(F.col("p"))).select("item_id", "part", "c.caption", "c.title")


@query("lenient_json", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE event_type END AS title,
  CASE event_id % 3 WHEN 2 THEN 'plain ' || event_type || ' text' ELSE 'k ' || (props->>'k') END AS caption, event_id % 3 < 2 AS parsed FROM events""")
def lenient_json(t):
    js = F.to_json(F.struct(F.concat(L(" "), F.col("event_type"), L("  ")).alias("caption_title"),
                            F.concat(L("k  "), F.get_json_object("props", "$.k")).alias("caption")))
    k = F.col("event_id") % 3
    raw = (F.when(k == 0, F.concat(L("```json\n"), js, L("\n```"))).when(k == 1, F.concat(L("Sure: "), js, L(" done")))
           .otherwise(F.concat(L("plain  "), F.col("event_type"), L(" text\n"))))
    return t("events").select("event_id", X.lenient_json(raw).alias("j")).select("event_id", "j.*")


@query("surface_variants", rf"""WITH v AS (SELECT p_partkey, {S("title || CASE WHEN p_size % 2 = 0 THEN ';' ELSE '' END")} AS t FROM v_titled),
  a AS (SELECT p_partkey, [t, regexp_replace(t, '\s+', '', 'g'), regexp_replace(t, '[.,;:]+$', '')] AS a FROM v),
  u AS (SELECT p_partkey, unnest(a) AS variant, unnest([0, 1, 2]) AS i FROM a)
  SELECT p_partkey, variant, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY min(i)) - 1 AS INTEGER) AS pos FROM u WHERE variant <> '' GROUP BY p_partkey, variant""")
def surface_variants(t):
    title = F.concat("title", F.when(F.col("p_size") % 2 == 0, L(";")).otherwise(L("")))
    return titled(t).select("p_partkey", F.posexplode(X.surface_variants(title)).alias("pos", "variant"))


@query("normalize_title", r"""SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'unnamed') AS norm FROM v_titled""")
def normalize_title(t):
    return titled(t).select("p_partkey", X.normalize_title(F.col("title")).alias("norm"))


FIRST = rf"""CASE WHEN x = '' THEN '' WHEN strpos(x, '다. ') > 1 THEN {S("x[1:strpos(x, '다. ') + 1]")} WHEN strpos(x, '다.' || chr(10)) > 1 THEN {S("x[1:strpos(x, '다.' || chr(10)) + 1]")}
 WHEN strpos(x, '. ') > 1 THEN {S("x[1:strpos(x, '. ')]")} WHEN strpos(x, '.' || chr(10)) > 1 THEN {S("x[1:strpos(x, '.' || chr(10))]")}
 WHEN ends_with(x, '.') THEN x ELSE {S('x[1:200]')} END"""


@query("first_sentence", f"SELECT doc_id, {FIRST} AS sentence FROM (SELECT doc_id, {S('text')} AS x FROM documents)")
def first_sentence(t):
    return t("documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("clean_evidence", rf"""WITH e AS (SELECT conv_id, turn, '. ' || replace(answer, ', ', ' 중요도: 8.5. , ') AS x FROM v_answer),
  a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, '\[Data:[^\]]*\]', '', 'g'), '중요도:\s*[0-9]+(?:\.[0-9]+)?\.?', '', 'g'), '\s+([.;,])', '\1', 'g') AS x FROM e),
  b AS (SELECT conv_id, turn, regexp_replace(x, '(?:[.;,]\s*)+([.;,])', '\1', 'g') AS x FROM a)
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '^[\s.;,]+', ''), '\s\s+', ' ', 'g')) AS text FROM b""")
def clean_evidence(t):
    x = F.concat(L(". "), F.replace("answer", L(", "), L(" 중요도: 8.5. , ")))
    return V.answers(t).select("conv_id", "turn", X.clean_evidence(x).alias("text"))


@query("escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM pages")
def escape_html(t):
    return t("pages").select("page_id", X.escape_html(F.col("html")).alias("text"))


def _scrub_sql(e: str) -> tuple[str, str]:
    n = []
    for p in K.PII_PATTERNS:
        if p == K.PII_LONG_DIGITS:
            continue
        n.append(f"len(regexp_extract_all({e}, '{p}'))")
        e = f"regexp_replace({e}, '{p}', '', 'g')"
    return rf"regexp_replace({e}, '[ \t][ \t]+', ' ', 'g')", " + ".join(n)


PII_IN = "text || ' 010-1234-5678 call M' || (10000000 + doc_id) || ' or 02-345-6789.'"


def with_contacts(t):
    return F.concat("text", L(" 010-1234-5678 call M"), (F.col("doc_id") + 10000000).cast("string"), L(" or 02-345-6789."))


@query("pii_scrub", f"SELECT doc_id, {_scrub_sql('x')[0]} AS text, CAST({_scrub_sql('x')[1]} AS INTEGER) AS n FROM (SELECT doc_id, {PII_IN} AS x FROM documents)")
def pii_scrub(t):
    return t("documents").select("doc_id", X.pii_scrub(with_contacts(t)).alias("s")).select("doc_id", "s.*")


@query("pii_flag", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in K.PII_PATTERNS) + " AS has_pii FROM documents")
def pii_flag(t):
    return t("documents").select("doc_id", X.pii_flag(F.col("text")).alias("has_pii"))


@query("chunk_tokens", "SELECT doc_id, chunk_no, text, n_tokens FROM v_chunk")
def chunk_tokens(t):
    return V.chunks(t)


@query("chunk_paragraphs", rf"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
  part AS (SELECT doc_id, unnest(a) AS p, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n\n+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS a FROM src WHERE length(text) > 2000)),
  fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS piece, length(p) AS cur, p FROM part WHERE i = 0
    UNION ALL SELECT f.doc_id, n.i, f.piece + CASE WHEN f.cur + length(n.p) > 2000 AND f.cur > 0 THEN 1 ELSE 0 END,
      CASE WHEN f.cur + length(n.p) > 2000 AND f.cur > 0 THEN length(n.p) ELSE f.cur + length(n.p) END, n.p FROM fold f JOIN part n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
  SELECT doc_id, CAST(piece AS INTEGER) AS piece, string_agg(p, '' ORDER BY i) AS text FROM fold GROUP BY doc_id, piece HAVING string_agg(p, '' ORDER BY i) <> ''
  UNION ALL SELECT doc_id, 0, text FROM src WHERE length(text) <= 2000""")
def chunk_paragraphs(t):
    src = F.replace("text", L("\n"), L("\n\n"))
    return t("documents").select("doc_id", F.posexplode(X.chunk_paragraphs(src, 2000)).alias("piece", "text"))


@query("pagewise_apply", rf"""WITH s AS (SELECT doc_id, string_split_regex(text, '\[page\d+\]') AS b, regexp_extract_all(text, '\[page\d+\]') AS m FROM v_paged),
  u AS (SELECT doc_id, m, unnest(b) AS body, unnest(range(len(b))) AS i FROM s),
  c AS (SELECT doc_id, i, m, CASE WHEN {S('body')} = '' THEN '' ELSE {CLEAN.format(e='body')} END AS done FROM u),
  p AS (SELECT doc_id, i, CASE WHEN i = 0 THEN done ELSE regexp_replace(m[i] || chr(10) || done, '\s+$', '') END AS part FROM c)
  SELECT doc_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY i) FILTER (WHERE part <> ''), '') AS text FROM p GROUP BY doc_id""")
def pagewise_apply(t):
    return O.pagewise(paged(t), X.clean_lines)


@query("drop_page_tags", rf"""SELECT doc_id, {S("regexp_replace(regexp_replace(text, '" + r"\[page\d+\]\n?', '', 'g'), '\n\n\n+'" + ", chr(10) || chr(10), 'g')")} AS text FROM v_paged""")
def drop_page_tags(t):
    return paged(t).select("doc_id", X.drop_page_tags(F.col("text")).alias("text"))


@query("hide_columns", "SELECT conv_id, turn, text AS question FROM conversations")
def hide_columns(t):
    quiz = t("conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") % 4).alias("answer_index"), F.col("role").alias("answer_text"),
        F.col("text").alias("explanation"), F.col("conv_id").cast("string").alias("source_ids"))
    return quiz.drop(*K.ANSWER_FIELDS)


@query("types_line_parse", """WITH s AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS a FROM documents)
  SELECT doc_id, CASE WHEN len(a) BETWEEN 3 AND 30 THEN array_to_string(a, ',') ELSE 'person,organization,location,event,concept,method,artifact,work,role,measure' END AS types,
  CASE WHEN len(a) BETWEEN 3 AND 30 THEN 'discover' ELSE 'fallback' END AS source FROM s""")
def types_line_parse(t):
    words = F.split(F.replace("text", L("\n"), L(" ")), " ")
    listed = F.array_join(F.filter(words, lambda x: x.rlike("^[A-Za-z]+$")), " , ")
    prompt = F.concat(L("Extract.\nOne of the following types: ["), listed, L("]\nEnd."))
    return t("documents").select("doc_id", X.types_line(prompt).alias("r")).select(
        "doc_id", F.array_join("r.types", ",").alias("types"), "r.source")


def record_text(t):
    """One delimited extraction record list per order line: two entities and a relationship."""
    def ent(name, typ):
        return F.concat(L('("entity"<|>'), name, L("<|>"), typ, L("<|>about "), name, L(")"))
    part, supp = F.concat(L("part "), F.col("l_partkey").cast("string")), F.concat(L("supplier "), F.col("l_suppkey").cast("string"))
    rel = F.concat(L('("relationship"<|>'), part, L("<|>"), supp, L("<|>supplied by<|>"), F.col("l_linenumber").cast("string"), L(")"))
    bad = F.when(F.col("l_linenumber") == 3, L('##\n("entity"<|>broken)')).otherwise(L(""))
    return spread(t("lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", F.concat(
        ent(part, L("PART")), L("\n##\n"), ent(supp, L("SUPPLIER")), L("\n##\n"), rel, bad, L("\n<|COMPLETE|>")).alias("records"))


def parsed_records(t):
    body = F.regexp_replace("records", r"<\|COMPLETE\|>\s*$", "")
    fields = F.transform(F.split(body, "##", -1), X.delimited_fields)
    recs = record_text(t).select("l_orderkey", "l_linenumber", F.posexplode(fields).alias("pos", "f"))
    return recs.where(
        ((F.col("f")[0] == "entity") & (F.size("f") == 4)) | ((F.col("f")[0] == "relationship") & (F.size("f") == 5)))


view_sql("v_record", """SELECT l_orderkey, l_linenumber, 0 AS pos, 'entity' AS kind, 'part ' || l_partkey AS a, 'PART' AS b, 'about part ' || l_partkey AS c, CAST(NULL AS DOUBLE) AS strength FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, 'entity', 'supplier ' || l_suppkey, 'SUPPLIER', 'about supplier ' || l_suppkey, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'relationship', 'part ' || l_partkey, 'supplier ' || l_suppkey, 'supplied by', CAST(l_linenumber AS DOUBLE) FROM lineitem""")


def records(t):
    f = F.col("f")
    return parsed_records(t).select("l_orderkey", "l_linenumber", "pos", f[0].alias("kind"), f[1].alias("a"), f[2].alias("b"),
                                    f[3].alias("c"), F.get(f, L(4)).cast("double").alias("strength"))


@query("delimited_records", "SELECT * FROM v_record")
def delimited_records(t):
    return records(t)


@query("findings_explode", """SELECT event_id, CAST(i AS INTEGER) AS finding, 's' || i || ' ' || event_type AS summary, 'value ' || user_id AS explanation
  FROM events, (VALUES (1), (2), (3)) n(i) WHERE i <= 1 + event_id % 3""")
def findings_explode(t):
    item = F.transform(F.sequence(L(1), (F.col("event_id") % 3 + 1).cast("int")), lambda i: F.struct(
        F.concat(L("s"), i.cast("string"), L(" "), F.col("event_type")).alias("summary"),
        F.concat(L("value "), F.col("user_id").cast("string")).alias("explanation")))
    js = F.to_json(F.struct(F.col("event_type").alias("title"), item.alias("findings")))
    parsed = F.from_json(js, "title string, findings array<struct<summary:string,explanation:string>>")
    rows = t("events").select("event_id", F.posexplode(parsed["findings"]).alias("pos", "f"))
    return rows.select("event_id", (F.col("pos") + 1).alias("finding"), "f.summary", "f.explanation")


@query("localize_no_data", f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN '{K.NO_DATA_LOCAL}' ELSE text END AS answer FROM conversations""")
def localize_no_data(t):
    raw = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, L(f" {K.NO_DATA_ANSWER}\n")).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", raw.alias("raw")).select(
        "conv_id", "turn", F.when(X.strip(F.col("raw")) == K.NO_DATA_ANSWER, K.NO_DATA_LOCAL).otherwise(F.col("raw")).alias("answer"))


@query("title_list", "SELECT p_partkey, p_name AS title FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def title_list(t):
    raw = F.when(F.col("p_partkey") % 7 == 0, L(None).cast("string")).when(F.col("p_partkey") % 11 == 0, L(" \t")).otherwise(F.concat(L(" "), F.col("p_name"), L("\n")))
    return t("part").select("p_partkey", X.strip(raw).alias("title")).where("title <> ''")


@query("id_list_coerce", """WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['id' || user_id, 'id' || event_id] ELSE ['abcdef' || (10 + user_id % 90)] END AS a FROM events)
  SELECT event_id, len(a) AS n, array_to_string(a, '|') AS ids FROM a""")
def id_list_coerce(t):
    k, u, e = F.col("event_id") % 3, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    raw = (F.when(k == 1, F.concat(L("['id"), u, L("', 'id"), e, L("']")))
           .when(k == 2, F.concat(L("<abcdef"), (F.col("user_id") % 90 + 10).cast("string"), L("> xyz"))))
    ids = X.id_list(raw)
    return t("events").select("event_id", F.size(ids).cast("long").alias("n"), F.array_join(ids, "|").alias("ids"))


@query("bbox_parse", """WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber AS page, round(l_discount * 10, 2) AS x0, round(l_tax * 20, 2) AS y0, round(l_discount * 10 + l_quantity / 10, 2) AS x1, round(l_tax * 20 + l_quantity / 20, 2) AS y1 FROM lineitem),
  p AS (SELECT l_orderkey, l_linenumber, page, CAST(trunc(x0 * 144) AS INTEGER) AS px0, CAST(trunc(y0 * 144) AS INTEGER) AS py0, CAST(trunc(x1 * 144) AS INTEGER) AS px1, CAST(trunc(y1 * 144) AS INTEGER) AS py1 FROM b)
  SELECT *, (px1 - px0) * (py1 - py0) AS area FROM p WHERE (px1 - px0) * (py1 - py0) >= 900""")
def bbox_parse(t):
    def num(c):
        return F.round(c, 2).cast("decimal(12,2)").cast("string")
    x0, y0 = F.col("l_discount") * 10, F.col("l_tax") * 20
    x1, y1 = x0 + F.col("l_quantity") / 10, y0 + F.col("l_quantity") / 20
    src = F.concat(L("D("), F.col("l_linenumber").cast("string"), *[p for c in (x0, y0, x1, y0, x1, y1, x0, y1) for p in (L(","), num(c))], L(");D()"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.inline(X.boxes_from_source(src)))
    px = [(F.col(c) * 144.0).cast("int").alias("p" + c) for c in ("x0", "y0", "x1", "y1")]
    out = rows.select("l_orderkey", "l_linenumber", "page", *px)
    return out.withColumn("area", (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))).where("area >= 900")


@query("figure_name_parse", """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS page, l_linenumber AS idx,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS INTEGER) END AS child FROM lineitem""")
def figure_name_parse(t):
    name = F.concat(L("images/fig_"), F.col("l_partkey").cast("string"), L("_"), F.col("l_linenumber").cast("string"),
                    F.when(F.col("l_linenumber") % 2 == 0, F.concat(L("_cv_"), F.col("l_suppkey").cast("string"))).otherwise(L("")), L(".png"))
    return t("lineitem").select("l_orderkey", "l_linenumber", X.figure_name(name).alias("n")).select("l_orderkey", "l_linenumber", "n.*")


@query("truncate_desc", "SELECT doc_id, text[1:200] AS short, CASE WHEN length(text) > 600 THEN replace(text, chr(10), ' ')[1:600] || '...' ELSE replace(text, chr(10), ' ') END AS dotted FROM documents")
def truncate_desc(t):
    return t("documents").select("doc_id", X.truncate_desc(F.col("text"), 200).alias("short"), X.truncate_desc(F.col("text"), 600, True).alias("dotted"))


@query("format_context", """SELECT doc_id, string_agg('[' || (chunk_no + 1) || '] text_unit | ' || doc_id || ' | chunk ' || chunk_no || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_no) AS context FROM v_chunk GROUP BY doc_id""")
def format_context(t):
    c = V.chunks(t)
    line = F.concat(L("["), (F.col("chunk_no") + 1).cast("string"), L("] text_unit | "), F.col("doc_id").cast("string"), L(" | chunk "),
                    F.col("chunk_no").cast("string"), L("\n"), F.col("text"))
    return O.format_context(c, "doc_id", "chunk_no", line)


@query("quiz_normalize", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'multiple_choice' ELSE 'short_answer' END AS type,
  CAST(CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 3 END AS INTEGER) AS answer_index,
  CASE WHEN conv_id % 2 = 0 THEN 'given' ELSE 'choice ' || (CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 3 END) END AS answer_text,
  3 AS n_choices, 'medium' AS difficulty FROM conversations WHERE regexp_matches(text, '\\S')""")
def quiz_normalize(t):
    from inkstone.operators import quiz as Q

    raw = t("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", L("essay")).otherwise(L("short_answer")).alias("type"),
        F.array(*[L(f"choice {i}") for i in range(3)]).alias("choices"),
        F.when(F.col("turn") % 3 == 0, L("first")).otherwise((F.col("turn") % 3).cast("string")).alias("answer_index"),
        F.when(F.col("conv_id") % 2 == 0, L("given")).otherwise(L("")).alias("answer_text"),
        L(None).cast("string").alias("difficulty"), F.col("text").alias("question"))
    q = Q.normalize(raw)
    back = Q.shuffle_choices(q, seed=7, key=["conv_id", "turn"])
    # the shuffle moves the answer with its choice, so undoing it restores the index
    restored = F.regexp_extract(F.get("choices", F.col("answer_index")), r"(\d+)$", 1).cast("int")
    return back.select("conv_id", "turn", "type", F.when(F.col("type") == "multiple_choice", restored).otherwise(F.col("answer_index")).alias("answer_index"),
                       "answer_text", F.size("choices").alias("n_choices"), "difficulty")


view_sql("v_doc_page", "SELECT doc_id, line AS page_no, length(s) AS n_chars FROM v_line")


@query("scan_detect", """WITH n AS (SELECT doc_id, count(*) AS n FROM v_doc_page GROUP BY doc_id)
  SELECT doc_id, avg(n_chars) AS mean_chars, avg(n_chars) < 100 AS scanned FROM v_doc_page JOIN n USING (doc_id)
  WHERE page_no IN (n // 2, least(n // 2 + 1, n - 1)) GROUP BY doc_id""")
def scan_detect(t):
    pages = t("documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), F.length)).alias("page_no", "n_chars"))
    return O.scan_detect(pages)


@query("report_markdown", """WITH m AS (SELECT model, count(*) AS calls, sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM v_usage GROUP BY model)
  SELECT 0 AS ord, '| model | calls | prompt | completion |' AS line UNION ALL SELECT 1, '|---|---|---|---|'
  UNION ALL SELECT 2, '| ' || model || ' | ' || calls || ' | ' || p || ' | ' || c || ' |' FROM m""")
def report_markdown(t):
    from inkstone.sources.sinks import markdown_rows

    m = V.usage(t).groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    return markdown_rows(m)
