"""Rewards of generated verdicts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import ANSWER_TAG, binary_label, parse_answer, present, tagged

WEIGHTS = {"accuracy": 1.0, "length": 0.1, "format": 0.1}


def accuracy(completion: Column | str, solution: Column | str) -> Column:
    """1 if the verdict is the solution's label."""
    return F.when(parse_answer(completion, "") == binary_label(solution), F.lit(1.0)).otherwise(F.lit(0.0))


def length(completion: Column | str) -> Column:
    """By the explanation's words: rising to 1 at 8, 1 up to 140, falling to 0 at 200."""
    words = F.regexp_count(tagged(completion, "explanation"), F.lit("[A-Za-z0-9]+"))
    return (
        F.when(words < 8, words / F.lit(8.0))
        .when(words <= 140, F.lit(1.0))
        .when(words >= 200, F.lit(0.0))
        .otherwise(F.lit(1.0) - (words - 140) / F.lit(60.0))
    )


def format(completion: Column | str) -> Column:
    """The share of: an explanation, a strict answer tag, exactly one opening answer tag."""
    checks = (
        tagged(completion, "explanation") != "",
        present(completion).rlike(ANSWER_TAG),
        F.regexp_count(present(completion), F.lit("(?i)<answer>")) == 1,
    )
    return sum((c.cast("int") for c in checks), F.lit(0)) / F.lit(3.0)


def mix(completion: Column | str, solution: Column | str, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of all three (an extension: trainers add them up elsewhere)."""
    w = WEIGHTS if weights is None else weights
    return accuracy(completion, solution) * w["accuracy"] + length(completion) * w["length"] + format(completion) * w["format"]


#: Rewards by name; each takes (completion, solution).
REGISTRY = {"accuracy": accuracy, "length": lambda c, s: length(c), "format": lambda c, s: format(c)}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions reward_accuracy, reward_length and reward_format over (completion, solution).

    Their bodies are the same expressions written in SQL, so they stay in the JVM.
    """
    tag = r"regexp_extract(coalesce(c, ''), r'(?ius)<explanation>\s*(.*?)\s*</explanation>', 1)"
    words = f"regexp_count({tag}, '[A-Za-z0-9]+')"
    strict = r"regexp_extract(coalesce(c, ''), r'(?iu)<answer>\s*(real|fake)\s*</answer>', 1)"
    said = (
        f"coalesce(lower(nullif({strict}, '')), lower(try_element_at(regexp_extract_all(coalesce(c, ''), "
        r"r'(?iu)\b(real|fake)\b', 1), -1)), '')"
    )
    bodies = {
        "accuracy": f"CASE WHEN {said} = CASE WHEN lower(trim(s)) = 'real' THEN 'real' ELSE 'fake' END THEN 1D ELSE 0D END",
        "length": f"CASE WHEN {words} < 8 THEN {words} / 8D WHEN {words} <= 140 THEN 1D WHEN {words} >= 200 THEN 0D ELSE 1D - ({words} - 140) / 60D END",
        "format": f"(int({tag} <> '') + int({strict} <> '') + int(regexp_count(coalesce(c, ''), '(?i)<answer>') = 1)) / 3D",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reward_{name}(c STRING, s STRING) RETURNS DOUBLE RETURN {body}")
