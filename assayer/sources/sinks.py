"""Record sinks that appear whole or not at all, through whatever file system Spark writes to."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def insist(action: Callable[[], Any], attempts: int = 10, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What the action returns; where access is denied, as while another process reads the file, up to ``attempts`` tries with short pauses."""
    for attempt in range(attempts):
        try:
            return action()
        except (PermissionError, Py4JJavaError) as e:
            denied = isinstance(e, PermissionError) or any(n in str(e.java_exception) for n in ("AccessControlException", "AccessDeniedException"))
            if not denied or attempt == attempts - 1:
                raise
            sleep(0.2 + random.random() * 0.2)


def _parts(spark: SparkSession, folder: str) -> list:
    """The filled part files of a written folder, in their order."""
    fs, source, _ = _fs(spark, folder)
    parts = [s for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen()]
    return sorted(parts, key=lambda s: s.getPath().getName())


def _joined(spark: SparkSession, folder: str, path: str, before: bytes = b"", after: bytes = b"", less: int = 0) -> None:
    """A folder's part files one after the other as one file ``path``, which appears at once; the folder goes.

    Bytes are copied as a stream, so memory doesn't follow their number.
    ``before`` and ``after`` stand around them; of the last part, ``less``
    bytes are left out at the end.
    """
    fs, target, jvm = _fs(spark, path)
    parts = _parts(spark, folder)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    copy = jvm.org.apache.commons.io.IOUtils.copyLarge
    whole = jvm.org.apache.hadoop.fs.Path(f"{folder}/joined")
    out = fs.create(whole)
    try:
        out.write(bytearray(before))
        for i, part in enumerate(parts):
            stream = fs.open(part.getPath())
            try:
                copy(stream, out, 0, part.getLen() - (less if i == len(parts) - 1 else 0))
            finally:
                stream.close()
        out.write(bytearray(after))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    insist(lambda: context.rename(fs.makeQualified(whole), fs.makeQualified(target), options))
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def write_records(rows: DataFrame, path: str, order: str | None = "pos") -> None:
    """Rows in order as one file that replaces ``path`` at once: JSONL by that suffix, else a JSON array.

    Nulls are written. Ranges of the order are written in parallel, each record with
    the separator that follows it, and their bytes then copied into one file;
    without an order, rows stay as they come. :func:`write_folder` leaves the parts as they are.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != order]
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    array = not path.endswith(".jsonl")
    lines = rows.select(*([F.col(order).alias("__order")] if order else []), (F.concat(text, F.lit(",")) if array else text).alias("value"))
    if order:
        lines = lines.repartitionByRange("__order").sortWithinPartitions("__order").select("value")
    folder = f"{path}.{uuid.uuid4().hex}"
    lines.write.text(folder)
    if not array:
        _joined(spark, folder, path)
    elif _parts(spark, folder):
        _joined(spark, folder, path, b"[\n", b"\n]\n", less=2)  # the last record's comma and line end
    else:
        _joined(spark, folder, path, b"[]\n")


def write_folder(rows: DataFrame, path: str, order: str = "pos") -> None:
    """Rows as JSONL parts whose names follow the order: sorted by range, written in parallel."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a log folder; the committer makes each batch appear whole."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_batch(rows: DataFrame, path: str) -> None:
    """A batch's rows as a folder of its own, in place of what a broken attempt may have left there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """The one row of a small result as a JSON document, such as metrics beside a result file."""
    write_records(row.limit(2), path if path.endswith(".jsonl") else path, order=None)


def sidecar(path: str, kind: str) -> str:
    """The name of a document beside a result file: <stem>_<kind>.json."""
    stem = path.rsplit("/", 1)
    name = stem[-1].rsplit(".", 1)[0]
    return "/".join([*stem[:-1], f"{name}_{kind}.json"])
