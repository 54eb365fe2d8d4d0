"""Joins by position and by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .checks import demand, demand_empty


def _zip(frames: dict[str, DataFrame], key: str, carry: dict[str, list[str]] | None) -> DataFrame:
    """Full outer join of all inputs by pos: pos, and for each input <name>_key and its carried columns."""
    out = None
    for name, df in frames.items():
        more = [F.col(c).alias(f"{name}_{c}") for c in (carry or {}).get(name, [])]
        side = df.select("pos", strip(key).alias(f"{name}_key"), F.lit(True).alias(f"{name}_here"), *more)
        out = side if out is None else out.join(side, "pos", "full_outer")
    return out


def zip_problems(frames: dict[str, DataFrame], key: str = "video_path") -> DataFrame:
    """Positions where inputs disagree: pos and ``problem`` (length, blank or key)."""
    names = list(frames)
    keys = F.array(*[F.col(f"{n}_key") for n in names])
    all_here = F.array(*[F.coalesce(F.col(f"{n}_here"), F.lit(False)) for n in names])
    problem = (
        F.when(F.exists(all_here, lambda x: ~x), F.lit("length"))
        .when(F.exists(keys, lambda x: x == ""), F.lit("blank"))
        .when(F.size(F.array_distinct(keys)) != 1, F.lit("key"))
    )
    return _zip(frames, key, None).select("pos", problem.alias("problem")).where("problem is not null")


def strict_zip(frames: dict[str, DataFrame], key: str = "video_path", carry: dict[str, list[str]] | None = None, upto: int | None = None) -> DataFrame:
    """Row i of every input side by side: pos, key, and each input's carried columns as <input>_<column>.

    Every input needs the same length and the same key at each position, or
    the job ends. The join is a full outer one by position, so a missing row
    is seen; the key takes no part in it. ``upto`` checks and keeps the
    positions before it, plus one more check, as an early stop does.
    """
    names = list(frames)
    if upto is not None:
        frames = {n: df.where(F.col("pos") <= upto) for n, df in frames.items()}
    out = _zip(frames, key, carry)
    same = F.lit(True)
    for n in names:
        same = same & F.coalesce(F.col(f"{n}_here"), F.lit(False)) & (F.col(f"{n}_key") != "") & (F.col(f"{n}_key") == F.col(f"{names[0]}_key"))
    out = demand(out, same, F.concat(F.lit("inputs differ at position "), F.col("pos").cast("string")))
    if upto is not None:
        out = out.where(F.col("pos") < upto)
    return out.select("pos", F.col(f"{names[0]}_key").alias(key), *[f"{n}_{c}" for n in names for c in (carry or {}).get(n, [])])


def lookup(left: DataFrame, right: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Inner join by key; with strict a left row without a partner ends the job."""
    out = left.join(right, key)
    return demand_empty(out, left.join(right, key, "left_anti"), f"no partner for some {key}") if strict else out


def in_order(keys: DataFrame, results: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Results in the order of the input's keys; keys without a result go."""
    return keys.select(pos, key).join(results.drop(pos), key).orderBy(pos)


def select_sample(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The rows of a key list in its order; a key without a row ends the job."""
    return lookup(sample.select(F.col("pos").alias("sample_pos"), key), rows, key).orderBy("sample_pos")


def tasks(models: DataFrame, selected: DataFrame) -> DataFrame:
    """The work list: every model with every selected row. Which side travels is left to Spark's size estimates."""
    return models.crossJoin(selected)


def pending_after_prefix(manifest: DataFrame, done: DataFrame, key: str = "video_path") -> DataFrame:
    """Rows of the manifest after those that an ordered output already holds.

    The output must be a prefix of the manifest, or the job ends.
    """
    n = done.agg(F.count(F.lit(1)).alias("n_done"))
    wrong = done.select("pos", F.col(key).alias("done_key")).join(manifest.select("pos", F.col(key).alias("wanted")), "pos", "left").where(
        ~F.col("done_key").eqNullSafe(F.col("wanted"))
    )
    left = manifest.join(F.broadcast(n)).where(F.col("pos") >= F.col("n_done")).drop("n_done")
    return demand_empty(left, wrong, "the output is no prefix of the manifest")
