"""Joining answers of a language model with the analyses they were asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions.strict_json import with_object
from pulltally.functions.text import strip_fences
from pulltally.operators.activity import AUTHOR



def parse_responses(responses: DataFrame) -> DataFrame:
    """Answers with ``insights``, ``extra_recommendations`` and a ``problem`` where they are unusable.

    An answer is one JSON object, perhaps in a fence, and nothing else. Null items of its lists are left out.
    """
    answer = F.col("_answer")
    parsed = with_object(responses, "_answer", strip_fences(F.col("content")), schema.RESPONSE)
    problem = (
        F.when(F.col("content").isNull(), F.lit("no response"))
        .when(answer.isNull(), F.lit("not JSON"))
        .when(answer["insights"].isNull(), F.lit("no insights"))
        .when(answer["recommendations"].isNull(), F.lit("no recommendations"))
    )
    return parsed.select(
        *responses.columns,
        F.filter(answer["insights"], lambda x: x.isNotNull()).alias("insights"),
        F.filter(answer["recommendations"], lambda x: x.isNotNull()).alias("extra_recommendations"),
        problem.alias("problem"))


def one_response(responses: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """One row per group: its ``content``, and whether there are ``several`` different ones.

    Equal answers are one answer, and null ones none. Which of several different ones is right nobody can tell.
    """
    least, most = F.min("content"), F.max("content")
    return responses.groupBy(*keys).agg(least.alias("content"), (least != most).alias("several"))


def answered(analysis: DataFrame, responses: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Analyses with their parsed answers; good and failed ones together. Written once, it serves both results."""
    joined = analysis.join(one_response(responses, keys), list(keys), "left")
    parsed = parse_responses(joined)
    return parsed.withColumn("problem", F.when(F.col("several"), F.lit("several responses")).otherwise(F.col("problem")))


def split_answered(parsed: DataFrame, columns: Sequence[str], keys: Sequence[str] = AUTHOR) -> tuple[DataFrame, DataFrame]:
    """The good ones with the model's lists appended, in the analysis's ``columns``; and the failed ones."""
    merged = parsed.filter(F.col("problem").isNull()).withColumns({
        "findings": F.concat("findings", "insights"),
        "recommendations": F.concat("recommendations", "extra_recommendations"),
    })
    rejected = parsed.filter(F.col("problem").isNotNull()).select(*keys, "content", "problem")
    return merged.select(*columns), rejected


def merge_insights(
    analysis: DataFrame, responses: DataFrame, keys: Sequence[str] = AUTHOR
) -> tuple[DataFrame, DataFrame]:
    """Analyses with the model's insights and recommendations appended, and the failed ones.

    The second result holds the group, ``content`` and ``problem`` of every analysis whose answer is
    missing, unusable or not the only one; these give no report. ``responses`` may repeat answers.
    """
    return split_answered(answered(analysis, responses, keys), analysis.columns, keys)
