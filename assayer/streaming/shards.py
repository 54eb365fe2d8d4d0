"""Shards of one input that finish by themselves, in any order and at the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.resume import merge_shards
from ..sources import sinks
from ..sources.records import read_records


def shard_path(output: str, shards: int, index: int) -> str:
    """Where a shard's results lie: shards/<stem>.shard<index>-of-<shards><suffix> beside the output."""
    if not 0 <= index < shards:
        raise ValueError("the shard index must be below the number of shards")
    folder, _, name = output.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    return f"{folder + '/' if folder else ''}shards/{stem}.shard{index:05d}-of-{shards:05d}{suffix}"


def missing(spark: SparkSession, output: str, shards: int) -> list[int]:
    """The shards that haven't finished."""
    out = []
    for i in range(shards):
        fs, at, _ = sinks._fs(spark, shard_path(output, shards, i))
        if not fs.exists(at):
            out.append(i)
    return out


def finish(results: DataFrame, output: str, shards: int, index: int, inputs: DataFrame, key: str, schema: str) -> DataFrame | None:
    """Commits a shard's results; the merged output if this was the last one, else None.

    A shard's file appears by a rename, whole or not at all. Whoever then
    finds all shards there merges them in input order, the first of a key winning,
    and the output appears by a rename, too. Two that finish at
    the same time both merge, to the same bytes, so the order of their renames doesn't matter; a
    shard that is run again just replaces its file and merges again.
    """
    spark = results.sparkSession
    sinks.write_records(results, shard_path(output, shards, index))
    if missing(spark, output, shards):
        return None
    parts = [read_records(spark, shard_path(output, shards, i), schema) for i in range(shards)]
    sinks.write_records(merge_shards(parts, inputs, key), output)
    return read_records(spark, output, schema)
