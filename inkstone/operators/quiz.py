"""Quiz rows: normalising, seeded choice shuffle, review filter, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as X

QUIZ_TYPES = ("multiple_choice", "short_answer", "ox")


def normalize(raw: DataFrame, types: tuple[str, ...] = QUIZ_TYPES) -> DataFrame:
    """Unknown type -> multiple_choice, non-integer answer -> 0, answer text defaults to its choice."""
    idx = F.coalesce(F.expr("try_cast(answer_index AS int)"), F.lit(0))
    choices = F.coalesce("choices", F.array().cast("array<string>"))
    pick = F.when((idx >= 0) & (idx < F.size(choices)), F.get(choices, idx)).otherwise(F.lit(""))
    out = raw.withColumns({
        "type": F.when(F.col("type").isin(*types), F.col("type")).otherwise(F.lit("multiple_choice")),
        "answer_text": F.coalesce(F.nullif("answer_text", F.lit("")), pick),
        "answer_index": idx, "choices": choices,
        "difficulty": F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("medium")),
        "question": X.strip(F.coalesce("question", F.lit(""))),
    })
    return out.where("question <> ''")


def shuffle_choices(quiz: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Reorder the choices of multiple-choice rows by a seeded hash and move the index along."""
    tagged = F.transform("choices", lambda c, i: F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in key], i).alias("h"), i.alias("i"), c.alias("c")))
    mixed = F.array_sort(tagged)
    do = (F.col("type") == "multiple_choice") & (F.size("choices") > 1)
    where = F.array_position(F.transform(mixed, lambda x: x["i"]), F.col("answer_index")) - 1
    return quiz.withColumn("_m", mixed).withColumns({
        "answer_index": F.when(do, where.cast("int")).otherwise(F.col("answer_index")),
        "choices": F.when(do, F.transform("_m", lambda x: x["c"])).otherwise(F.col("choices")),
    }).drop("_m")


def verify(quiz: DataFrame, reviews: DataFrame, fallback: DataFrame) -> DataFrame:
    """Keep quizzes whose last review passes; a safe explanation wins; a group with none left falls back."""
    last = reviews.groupBy("group_id", "idx").agg(
        F.max_by(F.struct("verdict", "safe_explanation"), "ord").alias("r")).select("group_id", "idx", "r.*")
    ok = quiz.join(last.where(F.lower("verdict") == "pass"), ["group_id", "idx"]).withColumn(
        "explanation", F.coalesce(F.nullif(X.strip(F.col("safe_explanation")), F.lit("")), F.col("explanation")))
    kept = ok.select("group_id", "idx", "question", "explanation", F.lit("verified").alias("mode"))
    spare = fallback.join(kept.select("group_id").distinct(), "group_id", "left_anti")
    return kept.unionByName(spare.select("group_id", "idx", "question", "explanation", F.lit("fallback").alias("mode")))


def grade(quiz: DataFrame, submitted: DataFrame) -> DataFrame:
    """(quiz_id, score, total): only submitted, existing questions count."""
    j = submitted.join(quiz, ["quiz_id", "idx"])
    user = X.strip(F.coalesce("answer", F.lit("")))
    right = (
        F.when(user == "", False)
        .when(F.col("type") == "short_answer", F.contains(F.coalesce("answer_text", F.lit("")), user))
        .otherwise(F.coalesce(F.expr("try_cast(trim(answer) AS int)") == F.col("answer_index"), F.lit(False)))
    )
    return j.groupBy("quiz_id").agg(F.sum(right.cast("int")).cast("int").alias("score"), F.count("*").cast("int").alias("total"))
