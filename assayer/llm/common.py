"""Shared helpers of the corpus operators: tables, checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes handed to Python at once, at most, unless the session says otherwise. One longer row goes alone.
ARROW_LIMITS = {"maxRecordsPerBatch": ("10000", "256"), "maxBytesPerBatch": (str(64 << 20) + "b", str(8 << 20) + "b")}


def ready(spark: SparkSession) -> SparkSession:
    """Makes the session fit for Python functions over long texts; every operator calls it.

    Executors get the package, and memory follows a small batch of texts
    rather than a partition. Both settings stay in the session, as plans run
    after the operator has returned; values that the caller chose are left.
    """
    ship(spark)
    for name, (default, ours) in ARROW_LIMITS.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, read by Spark from whatever store holds it."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that spark.checkpoint.dir names; a temporary one only where none is named and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayer-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: later jobs don't repeat its work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet of known size, so that Catalyst may broadcast it if it is small.

    With ``plain`` neither compressed nor in dictionaries: numbers that repeat
    count for as much as they take in memory. The folder goes when the
    application ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    how = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**how).parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def drop_kept(df: DataFrame) -> None:
    """Deletes the folder of a table that :func:`kept` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus`` (null keys count as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def sampled(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The ``rows`` rows with the smallest seeded hash of the columns ``by``: a bounded, repeatable sample."""
    return df.orderBy(F.xxhash64(F.lit(20240611), *by), *by).limit(rows)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has the long columns a and b. Returns (node, component) with the
    smallest reachable node as component, for every node that is not itself the
    smallest of its component. Rounds alternate large-star and small-star
    steps; each is two aggregations with map-side combining and two equi-joins
    on the node, where adaptive execution splits a hub's edges (skew joins,
    which are on by default); each round's edges go to the checkpoint folder,
    as plain tables: a checkpoint would keep the estimated size of what it was made from, which an explosion of rows
    leaves as it was, and Catalyst would broadcast edges of any number. Empty edges give an empty result; self-loops
    and nulls are ignored.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = kept(e, "edges", plain=True)
    before = _fingerprint(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        last, e = e, kept(small, "edges", plain=True)
        drop_kept(last)
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
