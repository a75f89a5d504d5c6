"""Column functions on text. All stay JVM-side; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import constants as K


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``.

    An expression captured by a higher-order function is evaluated again for every element;
    a lambda variable is not. Anything costly used inside a lambda goes through here.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def squeeze(c: Column) -> Column:
    """White-space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """White-space separated tokens without empties."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def find(text: Column, needle: Column) -> Column:
    """0-based code point offset of the first occurrence, -1 when absent or needle empty."""
    return F.when(needle == "", F.lit(-1)).otherwise(F.instr(text, needle) - 1)


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise((gone / F.length(needle)).cast("int"))


# ---------------------------------------------------------------- cleaning

def clean_lines(c: Column) -> Column:
    c = F.regexp_replace(c, "^﻿", "")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"^\n{2,}", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"\n+\z", "")
    return F.concat(c, F.lit("\n"))


def page_markers(c: Column) -> Column:
    """Page comments become ``[pageN]``.

    Range comments carry their own first number. Break comments are numbered in a second pass
    that continues from the *last* range comment of the text, as the reference does.
    """
    last = F.coalesce(
        F.try_element_at(F.regexp_extract_all(c, F.lit(K.PAGE_RANGE_COMMENT), F.lit(1)), F.lit(-1)).cast("int"),
        F.lit(1),
    )
    set_marks = F.regexp_replace(c, K.PAGE_RANGE_COMMENT, "[page$1]")
    parts = F.split(set_marks, K.PAGE_BREAK_COMMENT, -1)

    def tag(b: Column) -> Column:
        return F.array_join(F.transform(b["parts"], lambda s, i: F.when(i == 0, s).otherwise(
            F.concat(F.lit("[page"), (b["last"] + i).cast("string"), F.lit("]"), s))), "")

    return let(F.struct(parts.alias("parts"), last.alias("last")), tag)


def strip_markup(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<table>.*?</table>", "")
    c = F.regexp_replace(c, r"(?s)<figure>.*?</figure>", "")
    c = page_markers(c)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?s)\$\$.*?\$\$", "")
    c = F.regexp_replace(c, r"\$[^$\n]+?\$", "")
    c = F.regexp_replace(c, r"(?mdU)^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"(?mdU)^[•·]\s*", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def inline_caption_list(c: Column) -> Column:
    """Trimmed caption-shaped matches found inside body text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(K.INLINE_CAPTION), F.lit(0)), strip)


def without_inline_captions(c: Column) -> Column:
    return F.regexp_replace(c, K.INLINE_CAPTION, "")


def strip_footer(c: Column) -> Column:
    return rstrip(F.regexp_replace(c, K.RUNNING_FOOTER, ""))


def captions_to_md(c: Column) -> Column:
    """Each non-blank line becomes a tagged caption without its page tag and outer quotes."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def tag(line: Column) -> Column:
        bare = strip(F.regexp_replace(line, r"\[page\d+\]", ""))
        return F.concat(F.lit("<figcaption>"), F.regexp_replace(bare, r'^"+|"+\z', ""), F.lit("</figcaption>"))

    return F.concat(F.array_join(F.transform(lines, tag), "\n\n"), F.lit("\n"))


def drop_page_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"\[page\d+\]\n?", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# ---------------------------------------------------------------- shortening

def compact_text(c: Column, max_len: int = 900) -> Column:
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, max_len)


def sentences(c: Column, limit: int = 18, max_len: int = 260, min_len: int = 35) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?。！？])\s+|\n+")
    short = F.transform(parts, lambda p: compact_text(p, max_len))
    return F.slice(F.filter(short, lambda p: F.length(p) >= min_len), 1, limit)


def summarize_list(items: Column, limit: int = 10) -> Column:
    def render(kept: Column) -> Column:
        shown = F.array_join(F.slice(kept, 1, limit), ", ")
        hidden = F.size(kept) - limit
        more = F.concat(shown, F.lit(" " + K.MORE_PREFIX + " "), hidden.cast("string"), F.lit(K.MORE_SUFFIX))
        return F.when(F.size(kept) == 0, F.lit(K.NOTHING_LISTED)).when(hidden > 0, more).otherwise(shown)

    given = F.coalesce(items, F.array().cast("array<string>"))
    return let(F.filter(given, lambda x: x.isNotNull() & (x != "")), render)


def first_sentence(c: Column, max_len: int = 200) -> Column:
    """Separators are tried in a fixed order, not by position; an index of 0 does not count."""
    t = strip(F.coalesce(c, F.lit("")))
    out = F.when(t == "", F.lit(""))
    for sep, keep in K.SENTENCE_BREAKS:
        at = F.instr(t, sep)
        out = out.when(at > 1, strip(F.substr(t, F.lit(1), at - 1 + keep)))
    return out.when(t.endswith("."), t).otherwise(strip(F.substring(t, 1, max_len)))


def truncate_desc(c: Column, n: int, dots: bool = False) -> Column:
    if not dots:
        return F.substring(F.coalesce(c, F.lit("")), 1, n)
    flat = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


# ---------------------------------------------------------------- titles and tokens

def topic_tokens(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    toks = words(F.regexp_replace(low, r"(?U)[^\w\s]", " "))

    def with_stem(tok: Column) -> Column:
        stem = F.regexp_replace(tok, K.TRAILING_PARTICLE, "")
        return F.when((stem != "") & (stem != tok), F.array(tok, stem)).otherwise(F.array(tok))

    seen = F.array_distinct(F.flatten(F.transform(toks, with_stem)))
    return F.filter(seen, lambda x: (F.length(x) >= 2) & ~x.isin(*K.TOPIC_STOPWORDS))


def strip_trailing_paren(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s*\([^)]*\)\s*$", ""))


def surface_variants(title: Column) -> Column:
    t = strip(title)
    joined = F.regexp_replace(t, r"(?U)\s+", "")
    bare = F.regexp_replace(t, r"[.,;:]+\z", "")
    return F.array_distinct(F.filter(F.array(t, joined, bare), lambda v: v != ""))


def normalize_title(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"[^\p{L}\p{N}_]+", "_")
    s = F.lower(F.regexp_replace(s, r"^_+|_+\z", ""))
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def joined_captions(c: Column) -> Column:
    """Array of (title, caption): two entries when two captions were run together."""
    parts = F.split(c, K.CAPTION_BAR, -1)
    p1, p2, p3 = (strip(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))) for i in range(3))
    rest = F.regexp_replace(p2, r"(?s)^[^ ]* ", "")
    author = F.regexp_extract(p2, r"(?s)^([^ ]*) ", 1)
    two = (F.size(parts) == 3) & F.length(p3).between(1, 6) & p2.contains(" ")

    def pair(title: Column, cap: Column) -> Column:
        return F.struct(strip_trailing_paren(title).alias("title"), cap.alias("caption"))

    return F.when(
        two, F.array(pair(p1, F.concat(p1, F.lit(" | "), author)), pair(rest, F.concat(rest, F.lit(" | "), p3)))
    ).otherwise(F.array(pair(p1, c)))


def printed_caption(c: Column) -> Column:
    """Struct (title, caption): caption is always whole, title only when it is certain."""
    t = squeeze(F.coalesce(c, F.lit("")))
    sentence = (F.length(t) > 30) | t.rlike(K.SENTENCE_END)
    title = (
        F.when(t == "", F.lit(""))
        .when(t.rlike(K.CAPTION_BAR), strip(F.get(F.split(t, K.CAPTION_BAR, 2), F.lit(0))))
        .when(sentence, F.lit(""))
        .otherwise(strip_trailing_paren(t))
    )
    return F.struct(title.alias("title"), t.alias("caption"))


def lenient_json(raw: Column) -> Column:
    """Struct (title, caption, parsed): outermost braces parsed; else the whole text is the caption."""
    s = strip(raw)
    fenced = s.startswith("```")
    inner = F.regexp_replace(s, r"^`+|`+\z", "")
    inner = F.when(inner.contains("\n"), F.regexp_replace(inner, r"(?s)^[^\n]*\n", "")).otherwise(inner)
    s = F.when(fenced, inner).otherwise(s)
    body = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    js = F.when(body == "", s).otherwise(body)
    obj = F.from_json(js, "caption_title string, caption string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = js.startswith("{") & obj.isNotNull() & obj["_bad"].isNull()
    return F.struct(
        F.when(ok, squeeze(F.coalesce(obj["caption_title"], F.lit("")))).otherwise(F.lit("")).alias("title"),
        F.when(ok, squeeze(F.coalesce(obj["caption"], F.lit("")))).otherwise(squeeze(raw)).alias("caption"),
        F.coalesce(ok, F.lit(False)).alias("parsed"),
    )


# ---------------------------------------------------------------- safety

def pii_scrub(c: Column) -> Column:
    """Struct (text, n): deterministic patterns removed one after another, blanks squeezed."""
    text, n = c, F.lit(0)
    for pat in K.PII_PATTERNS:
        if pat == K.PII_LONG_DIGITS:
            continue
        n = n + F.regexp_count(text, F.lit(pat))
        text = F.regexp_replace(text, pat, "")
    return F.struct(F.regexp_replace(text, r"[ \t]{2,}", " ").alias("text"), n.alias("n"))


def pii_flag(c: Column) -> Column:
    hit = F.lit(False)
    for pat in K.PII_PATTERNS:
        hit = hit | c.rlike(pat)
    return hit


def escape_html(c: Column) -> Column:
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def clean_evidence(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    for pat, repl in K.EVIDENCE_CLEANUP:
        s = F.regexp_replace(s, pat, repl)
    return F.trim(F.regexp_replace(s, r"(?U)\s{2,}", " "))


# ---------------------------------------------------------------- chunking

def chunk_tokens(c: Column, size: int = 1200, overlap: int = 100) -> Column:
    """Array of (chunk_no, text, n_tokens) windows; the text is verbatim, white space included."""
    step = size - overlap

    def windows(p: Column) -> Column:
        n = F.size(p)
        return F.transform(
            F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>")),
            lambda s, i: F.struct(
                i.alias("chunk_no"),
                F.array_join(F.slice(p, s + 1, size), "").alias("text"),
                F.least(F.lit(size), n - s).alias("n_tokens"),
            ),
        )

    return let(F.regexp_extract_all(c, F.lit(r"([^ \t\n\r\f]+[ \t\n\r\f]*)"), F.lit(1)), windows)


def chunk_paragraphs(c: Column, limit: int = 12000) -> Column:
    """Greedy packing of paragraphs (separators kept) into pieces of at most ``limit`` characters."""
    marked = F.regexp_replace(c, r"(\n{2,})", "\u0001$1\u0001")
    parts = F.split(marked, "\u0001", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, part: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(part) > limit) & (acc["cur"] != "")
        return F.when(
            full, F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), part.alias("cur"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], part).alias("cur")))

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.aggregate(parts, start, pack, finish))


# ---------------------------------------------------------------- structured strings

def types_line(c: Column) -> Column:
    """Struct (types, source): listed types when their number is sane, else the generic list."""
    body = F.regexp_extract(c, r"(?s)One of the following types:\s*\[(.+?)\]", 1)
    found = F.filter(F.transform(F.split(body, ","), strip), lambda x: x != "")
    ok = F.size(found).between(K.MIN_TYPES, K.MAX_TYPES)
    return F.struct(
        F.when(ok, found).otherwise(F.array(*[F.lit(t) for t in K.GENERIC_TYPES])).alias("types"),
        F.when(ok, F.lit("discover")).otherwise(F.lit("fallback")).alias("source"),
    )


def delimited_fields(record: Column) -> Column:
    """Fields of one ``(a<|>b<|>c)`` record, outer parentheses, quotes and blanks removed."""
    body = F.regexp_replace(record, r'(?U)^\s*\(?\s*"*|"*\s*\)?\s*\z', "")
    return F.split(body, r'(?U)"*\s*<\|>\s*"*', -1)


def id_list(c: Column) -> Column:
    """Null -> []; a list literal -> its strings; anything else -> hex-like ids of at least 8 characters."""
    quoted = F.regexp_replace(c, "'", '"')
    lit = F.from_json(quoted, "array<string>")
    return (
        F.when(c.isNull(), F.array().cast("array<string>"))
        .when(strip(c).startswith("[") & lit.isNotNull(), lit)
        .otherwise(F.regexp_extract_all(c, F.lit(r"([0-9a-fA-F-]{8,})"), F.lit(1)))
    )


def cited_numbers(c: Column, kind: str) -> Column:
    """Distinct numeric ids in ``Kind(1, 2, +more)`` tags."""
    inside = F.regexp_extract_all(c, F.lit(K.CITATION[kind]), F.lit(1))
    toks = F.flatten(F.transform(inside, lambda s: F.transform(F.split(s, ","), strip)))
    return F.array_distinct(F.transform(F.filter(toks, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long")))


def boxes_from_source(c: Column) -> Column:
    """Array of (page, x0, y0, x1, y1) in inches from ``D(page,x,y,..);D(..)``."""
    regions = F.regexp_extract_all(c, F.lit(r"D\((\d+,[\d.,]+)\)"), F.lit(1))

    def one(nums: Column) -> Column:
        xy = F.slice(nums, F.lit(2), F.size(nums) - 1)
        xs, ys = F.filter(xy, lambda v, i: i % 2 == 0), F.filter(xy, lambda v, i: i % 2 == 1)
        return F.struct(
            F.get(nums, F.lit(0)).cast("int").alias("page"),
            F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
            F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
        )

    parsed = F.transform(regions, lambda r: F.transform(F.split(r, ","), lambda x: x.cast("double")))
    return F.transform(parsed, one)


def figure_name(c: Column) -> Column:
    pat = r"fig_(\d+)_(\d+)(?:_cv_(\d+))?\.png$"
    part = [F.nullif(F.regexp_extract(c, pat, i), F.lit("")).cast("int") for i in (1, 2, 3)]
    return F.struct(part[0].alias("page"), part[1].alias("idx"), part[2].alias("child"))
