"""Resumable work: what is pending, which results hold, shards and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import in_order
from .checks import argument


def complete(mode: str, role_report: Column | str | None = None, answer: str = "answer") -> Column:
    """Whether a result counts as done: an observer's report isn't empty, another mode's answer is real or fake (as it is, but for case)."""
    if mode == "observer":
        c = F.col(role_report) if isinstance(role_report, str) else role_report
        return F.coalesce(c, F.lit("")) != ""
    return F.lower(F.coalesce(F.col(answer), F.lit(""))).isin("real", "fake")


def pending(inputs: DataFrame, results: DataFrame, key: str, done: Column) -> DataFrame:
    """Input rows without a complete result; failed ones are pending again."""
    return inputs.join(results.where(done).select(key), key, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: that of the highest sequence. An aggregation that combines on the map side."""
    return _pick(rows, keys, F.max_by, F.col(seq))


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the first in the given order."""
    return _pick(rows, keys, F.min_by, F.struct(*order))


def _pick(rows: DataFrame, keys: list[str], how, by: Column) -> DataFrame:
    best = rows.groupBy(*keys).agg(how(F.struct(*rows.columns), by).alias("__row"))
    return best.select("__row.*")


def merge_logs(final: DataFrame, partial: DataFrame, key: str) -> DataFrame:
    """Results of a final output and of a later partial log; within both, the last one of a key wins."""
    logs = final.withColumn("__log", F.lit(0)).unionByName(partial.withColumn("__log", F.lit(1)))
    rows = logs.withColumn("__seq", F.struct("__log", "pos"))
    return last_wins(rows, [key], "__seq").drop("__log", "__seq")


def shard(rows: DataFrame, shards: int, index: int, limit: int | None = None) -> DataFrame:
    """Every ``shards``-th row from position ``index``; a limit counts within the shard."""
    if not 0 <= index < shards:
        raise ValueError("the shard index must be below the number of shards")
    own = rows.where(F.col("pos") % shards == index)
    if limit is not None:
        argument("limit", limit, least=0)
    return own if limit is None else own.where(F.floor(F.col("pos") / shards) < limit)


def shard_name(stem: Column, index: Column, shards: int, suffix: str = ".jsonl") -> Column:
    return F.format_string("shards/%s.shard%05d-of-%05d%s", stem, index, F.lit(shards), F.lit(suffix))


def merge_shards(parts: list[DataFrame | None], keys: DataFrame, key: str) -> DataFrame | None:
    """All shards' results in input order, the first of a key winning; none while a shard is missing."""
    if any(p is None for p in parts):
        return None
    tagged = [p.withColumn("__shard", F.lit(i)) for i, p in enumerate(parts)]
    merged = first_wins(reduce(DataFrame.unionByName, tagged), [key], "__shard", "pos").drop("__shard")
    return in_order(keys, merged, key)


def foreign(results: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Results whose key isn't wanted."""
    return results.join(wanted.select(key), key, "left_anti")


def batches(size: int, pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / size).cast("long")


def retry_delay(attempt: Column, retry_after: Column, backoff: float = 2.0, most: float = 30.0) -> Column:
    """Seconds before the next try, without jitter."""
    return F.greatest(retry_after, F.least(F.lit(most), F.lit(backoff) * F.pow(F.lit(2.0), attempt)))
