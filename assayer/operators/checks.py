"""Assertions that end the job when rows break them.

An assertion column that nobody reads is pruned away, so each check is a
filter that all rows pass or that raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import binary_label, filled, strip


def demand(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """``df``; a row for which the condition isn't true ends the job."""
    said = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def demand_filled(df: DataFrame, *columns: str) -> DataFrame:
    """No blank values in the columns."""
    for c in columns:
        df = demand(df, strip(c) != "", f"{c} is empty")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def demand_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; a repeated key ends the job. One aggregation by key that combines on the map side, checked with the rows."""
    found = duplicate_keys(df, *keys).agg(F.min(F.concat_ws(", ", *keys)).alias("__repeated"))
    checked = df.join(F.broadcast(found))  # one row: a global aggregate
    return demand(checked, F.col("__repeated").isNull(), F.concat(F.lit("duplicate key: "), F.col("__repeated"))).drop("__repeated")


def demand_empty(df: DataFrame, rows: DataFrame, message: str) -> DataFrame:
    """``df``; ends the job if ``rows`` has any."""
    found = rows.agg(F.count(F.lit(1)).alias("__found"))
    return demand(df.join(F.broadcast(found)), F.col("__found") == 0, message).drop("__found")


def label_mismatches(rows: DataFrame, gold: str, other: str) -> DataFrame:
    """Rows whose second label, if it isn't blank, means something else than the first."""
    return rows.where((strip(other) != "") & ~binary_label(gold).eqNullSafe(F.when(filled(strip(other)).isNotNull(), binary_label(other))))


def missing_roles(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Rows with ``missing``, the roles whose text is blank; only those that miss any."""
    gaps = F.filter(F.array(*[F.when(strip(r) == "", F.lit(r)) for r in roles]), lambda x: x.isNotNull())
    return rows.withColumn("missing", gaps).where(F.size("missing") > 0)


def holds_answer_tag(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))).contains("<answer")


def argument(name: str, value, least=None, above=None, most=None, below=None):
    """The value, if it is a number within the limits given; else an error that names it."""
    limits = [(least, "at least", lambda v, x: v >= x), (above, "above", lambda v, x: v > x), (most, "at most", lambda v, x: v <= x), (below, "below", lambda v, x: v < x)]
    for limit, words, holds in limits:
        if limit is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not holds(value, limit)):
            raise ValueError(f"{name} must be {words} {limit}, not {value!r}")
    return value
