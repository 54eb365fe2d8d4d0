"""Tables and files that a job writes to the shared folder and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named and Spark is local."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="assayer-")
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path there that nothing else has."""
    return f"{shared_folder(spark)}/{name + '-' if name else ''}{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table there: its work is done once, its rows don't change, and its size is known to Catalyst.

    With ``by``, in a folder for each value of these columns. The table goes when the application ends.
    """
    spark, at = df.sparkSession, new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # knows only what is there
    return spark.read.schema(df.schema).parquet(at).select(*[f"`{c}`" for c in df.columns])
