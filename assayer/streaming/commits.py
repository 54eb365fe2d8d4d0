"""A log of batches that count from the moment that a rename says so."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import in_order
from ..operators.resume import last_wins
from ..sources import sinks

_MANIFEST = re.compile(r"(\d{12})-([0-9a-f]{32})\.(batch|snapshot)")


class CommitLog:
    """Batches of rows in a folder, each whole or not there at all.

    A batch's rows are written by all tasks of a job, as ``data/<name>``. Then
    ``commits/<number>-<name>`` appears by a rename, and from then on the batch
    counts. What a job leaves behind that ends in between is in no commit, so
    nobody reads it and :meth:`sweep` deletes it. Names are unique: writers at
    the same time don't disturb each other. A snapshot stands for all commits
    before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, at, _ = sinks._fs(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def commits(self) -> list[tuple[int, str]]:
        """(number, name) of the batches that count, from the last snapshot on."""
        found = [m.groups() for m in map(_MANIFEST.fullmatch, self._names("commits")) if m]
        last = max((i for i, f in enumerate(found) if f[2] == "snapshot"), default=0)
        return [(int(number), name) for number, name, _ in found[last:]]

    def append(self, rows: DataFrame, snapshot: bool = False) -> int:
        """Adds a batch; its number, which no earlier commit has."""
        number = max((n for n, _ in self.commits()), default=-1) + 1
        name = uuid.uuid4().hex
        sinks.write_batch(rows, f"{self.path}/data/{name}")
        self._commit(number, name, snapshot)
        return number

    def _commit(self, number: int, name: str, snapshot: bool) -> None:
        target = f"{self.path}/commits/{number:012d}-{name}.{'snapshot' if snapshot else 'batch'}"
        fs, at, jvm = sinks._fs(self.spark, target)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{name}")
        out = fs.create(draft)
        try:
            out.write(bytearray(json.dumps({"number": number, "data": f"data/{name}"}), "utf-8"))
        finally:
            out.close()
        fs.mkdirs(at.getParent())
        if not fs.rename(draft, at):
            raise OSError(f"not committed: {target}")

    def read(self, schema: str) -> DataFrame:
        """The rows of all commits, with their batch's number as ``log_seq``; none where there is no log."""
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], f"{schema}, log_seq bigint")
        rows = self.spark.read.schema(schema).option("mode", "FAILFAST").json([f"{self.path}/data/{name}" for _, name in commits])
        numbers = self.spark.createDataFrame([(name, number) for number, name in commits], "__name string, log_seq bigint")  # a row a batch
        name = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)
        return rows.withColumn("__name", name).join(numbers, "__name").drop("__name")

    def compact(self, schema: str, keys: list[str], wanted: DataFrame | None = None) -> None:
        """One batch in place of all: the last row of each key, of the wanted ones if they are given, in their order.

        Until the snapshot's rename, readers see the batches; from then on, the snapshot.
        """
        rows = last_wins(self.read(schema), keys, "log_seq").drop("log_seq")
        if wanted is not None:
            rows = rows.join(wanted.select(*keys, "pos"), keys).repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
        self.append(rows, snapshot=True)

    def sweep(self) -> None:
        """Deletes data and commits that nobody will read again. Only while no one writes."""
        used = {name for _, name in self.commits()}
        for folder in ("commits", "data", "drafts"):
            for file in self._names(folder):
                if not any(name in file for name in used):
                    fs, at, _ = sinks._fs(self.spark, f"{self.path}/{folder}/{file}")
                    fs.delete(at, True)


def results(log: CommitLog, schema: str, inputs: DataFrame, key: str) -> DataFrame:
    """The last result of each input that has one, in input order."""
    return in_order(inputs, last_wins(log.read(schema), [key], "log_seq").drop("log_seq"), key)
