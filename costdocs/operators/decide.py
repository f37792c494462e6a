"""Decisions over tables of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.text import strip_space, truncate

INTENTS = ("sql", "docs", "general")
SCORE_PARTS = ("completeness", "accuracy", "specificity", "clarity")
MISSING_SCORE = 5.0
PASS_ACCURACY = 0.8

# Reasons given for questions that were not classified.
BLANK_REASON = "빈 질문"
FAILED_REASON = "LLM 실패로 기본값 사용: "

# Answer limits and what is added to a cut answer.
LONG_ANSWER = (2000, "...\n\n(답변이 길어서 일부만 표시됩니다. 더 구체적인 질문을 해주세요.)")
LONG_REPLY = (1000, " …")


def normalise_intents(outputs: DataFrame) -> DataFrame:
    """Intent, confidence and reason from (question, label, confidence) and ``reason`` if there is one.

    A blank question is general with 0.5. An output that is missing, has an unknown label or a
    confidence that is no number is general with 0.3. Without a label, but with a confidence,
    it is general; without a confidence that is 0.
    """
    label, confidence = F.col("label"), F.col("confidence")
    blank = F.coalesce(strip_space(F.col("question")), F.lit("")) == ""
    missing = label.isNull() & confidence.isNull()
    number = F.coalesce(confidence.try_cast("double"), F.when(confidence.isNull(), 0.0))
    intent = F.coalesce(label, F.lit("general"))
    usable = ~missing & number.isNotNull() & intent.isin(*INTENTS)
    why = (
        F.when(missing, "no output")
        .when(number.isNull(), F.concat(F.lit("no number: "), confidence.cast("string")))
        .otherwise(F.concat(F.lit("Invalid intent: "), intent))
    )
    given = F.coalesce("reason", F.lit("")) if "reason" in outputs.columns else F.lit("")
    return outputs.withColumns(
        {
            "intent": F.when(blank | ~usable, "general").otherwise(intent),
            "intent_confidence": F.when(blank, 0.5).when(~usable, 0.3).otherwise(number),
            "intent_reason": F.when(blank, BLANK_REASON).when(~usable, F.concat(F.lit(FAILED_REASON), why)).otherwise(given),
        }
    )


def route_counts(intents: DataFrame) -> DataFrame:
    return intents.groupBy("intent").agg(F.count("*").alias("n"))


def write_routes(intents: DataFrame, path: str) -> None:
    """One folder per intent; rows stay in the tasks they are in."""
    intents.write.mode("overwrite").partitionBy("intent").parquet(path)


def needs_second_answer(min_length: int, answer: str = "answer") -> Column:
    """Overall below 6, any part below 4, or a short answer; missing scores count as 5 and ask for it."""
    scores = ["overall_score", *SCORE_PARTS]
    missing = F.lit(False)
    for s in scores:
        missing = missing | F.col(s).isNull()
    low = F.least(*[F.coalesce(s, F.lit(MISSING_SCORE)) for s in SCORE_PARTS]) < 4
    overall = F.coalesce("overall_score", F.lit(MISSING_SCORE)) < 6
    return missing | overall | low | (F.coalesce(F.length(answer), F.lit(0)) < min_length)


def best_of_two(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The second answer only where its score is strictly higher; a missing score is 0."""
    rival = second.select(key, F.col("answer").alias("_answer"), F.col("score").alias("_score"))
    joined = first.join(rival, key, "left")
    wins = F.coalesce("_score", F.lit(0.0)) > F.coalesce("score", F.lit(0.0))
    return joined.select(
        key,
        F.when(wins, F.col("_answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(wins, "second").otherwise("first").alias("chosen"),
    )


def accuracy(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Share of gold rows predicted right, and whether it passes."""
    joined = gold.select(key, F.col("label").alias("_gold")).join(
        predictions.select(key, F.col("label").alias("_predicted")), key, "left"
    )
    right = F.coalesce(F.col("_gold") == F.col("_predicted"), F.lit(False)).cast("int")
    counts = joined.agg(F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total"))
    return counts.select(
        "correct", "total", share.alias("accuracy"), F.coalesce(share >= PASS_ACCURACY, F.lit(False)).alias("passed")
    )


def cut_answer(c: Column) -> Column:
    return truncate(c, *LONG_ANSWER)


def cut_reply(c: Column) -> Column:
    return truncate(c, *LONG_REPLY)
