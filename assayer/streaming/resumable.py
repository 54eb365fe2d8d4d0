"""Maps that can stop at any point and go on where they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import argument
from ..operators.resume import last_wins, pending
from ..scratch import written
from ..sources import sinks
from .commits import CommitLog, results


def run(inputs: DataFrame, process: Callable[[DataFrame], DataFrame], log: str, schema: str, key: str, done: Column, batch_rows: int = 100_000) -> DataFrame:
    """Process what the log lacks, in batches by position, each committed to the log as it ends; all results in input order.

    ``inputs`` has pos and the key, ``process`` maps a batch to rows of the
    schema. A row whose result isn't done is pending again; the last result of
    a key wins. What is pending at the start is written to the shared folder,
    a part a batch, so it outlives executors. A batch counts once its commit
    is there (:class:`.commits.CommitLog`): wherever a run ends, the next one
    goes on after the last commit, and no row is missing or there twice.
    """
    argument("batch_rows", batch_rows, least=1)
    spark = inputs.sparkSession
    commits = CommitLog(spark, log)
    before = last_wins(commits.read(schema), [key], "log_seq")
    batch = F.floor(F.col("pos") / batch_rows).alias("__batch")
    wanted = written(pending(inputs, before, key, done).select("*", batch), "pending", by=("__batch",))
    for n in [r["__batch"] for r in wanted.select("__batch").distinct().orderBy("__batch").collect()]:
        commits.append(process(wanted.where(F.col("__batch") == n).drop("__batch")))
    return results(commits, schema, inputs, key)


def stream(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Process the JSONL files that arrived in ``source`` since last time, each once, into ``sink``.

    A file-source stream that handles all that is there and stops; the
    checkpoint remembers which files are done.
    """
    files = spark.readStream.schema(schema).json(source)

    def batch(rows: DataFrame, number: int) -> None:
        if not _has(spark, f"{sink}/batch={number}/_SUCCESS"):
            sinks.write_batch(process(rows), f"{sink}/batch={number}")

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _has(spark: SparkSession, path: str) -> bool:
    """Whether a batch was written before: a batch that is repeated after a failure adds nothing."""
    fs, p, _ = sinks._fs(spark, path)
    return fs.exists(p)
