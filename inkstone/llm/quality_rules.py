"""Rule bitmask ledger: every rule is evaluated once per document; policies and ablations only read the bits.

Built from DataFrame functions alone. The repeated windows of a text are found inside its own row: window
hashes and positions share one sorted long array, and windows whose hash occurs twice are then compared as text.

Defined cases: a null or blank text has no words and fails ``too_short``; null ids and repeated rows keep a row each;
other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import BLANKS

#: name -> failure, from the measurements of a row. The order gives the bit; append only.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "shouting": "2 * n_upper > n_letters AND n_letters > 0",
}
#: version -> rules a document must pass. A new version is a new entry; old verdicts can be computed again from the ledger.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_short", "repeated_windows"),
    "web-1": ("too_short", "repeated_windows", "symbols", "duplicate_lines"),
    "web-2": tuple(RULES),
}
POSITION_BITS = 31


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _words(text: Column) -> Column:
    cut = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(cut) > 0, F.split(cut, f"[{BLANKS}]+")).otherwise(F.array().cast("array<string>"))


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that the pattern takes away."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements): counts of words, characters, symbols, lines and words in repeated windows."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = t.select(
        "doc_id", _words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{BLANKS}]+", ""))).cast("long").alias("blanks"),
        F.length("text").cast("long").alias("n_chars"), _removed(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        _removed(F.col("text"), r"\p{Lu}+").alias("n_upper"), _removed(F.col("text"), r"\p{L}+").alias("n_letters"))
    n = F.size("w")
    window = F.transform(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.shiftleft(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))
    d = d.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), (F.col("n_chars") - F.col("blanks")).alias("word_chars"), "n_chars", "n_symbols", "n_upper", "n_letters",
                 F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.sort_array(window).alias("s"))

    def near(column: str, same) -> Column:
        """Elements of a sorted array that ``same`` finds next to their like."""
        return F.filter(column, lambda x, k: F.coalesce(same(F.get(column, k - 1), x), F.lit(False)) | F.coalesce(same(x, F.get(column, k + 1)), F.lit(False)))

    twice = near("s", lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), POSITION_BITS) == 0)
    d = d.withColumn("s", F.transform(twice, lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")))
    d = d.withColumn("g", F.sort_array(F.transform("s", lambda p: F.struct(
        F.concat_ws(" ", F.get("w", p), F.get("w", p + 1), F.get("w", p + 2)).alias("g"), p.alias("p"))))).drop("w", "s")
    d = d.withColumn("p", F.sort_array(F.transform(near("g", lambda a, b: a.g == b.g), lambda x: x.p))).drop("g")
    gaps = F.transform("p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - p, F.lit(3))).cast("long"))
    return d.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("p")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements with ``failed_bits``: bit i is set when rule i of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed_bits", total)


def apply_policy(rows: DataFrame, version: str, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without) of a policy: what each rule rejects, alone, and what would be kept without it.

    Rows are first counted by their bits, so the work after one partial aggregate is rules x distinct bit patterns.
    """
    m = mask(POLICIES[version])
    by_bits = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if m >> i & 1]))
    x = by_bits.select("b", "n", table.alias("r")).select("b", "n", "r.rule", "r.bit")
    rest = F.col("b").bitwiseAND(F.bitwise_not("bit"))
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))
