"""Ordered JSON and JSONL records: scans that carry the position, repair, key lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.checks import demand, demand_unique
from ..shipping import ship


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Rows with their dense position in file order; of several files, those of the smaller path come first.

    Row numbers within a file's split, plus how many rows the splits before it
    hold: a second scan that only counts, and a join with one row a split. A
    scan's partitions tell no order, as Spark deals out splits by their size.
    Nothing is shuffled and nothing leaves the JVM. Only for rows straight from
    files, whose partitions are the same each time.
    """
    marked = rows.withColumns({"__at": F.monotonically_increasing_id(), "__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start")})
    counts = marked.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__begins"))
    before = F.sum("n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__file", "__start", "__begins", F.coalesce(before, F.lit(0)).alias("__offset"))
    joined = marked.join(F.broadcast(offsets), ["__file", "__start"])
    return joined.withColumn(name, F.col("__offset") + F.col("__at") - F.col("__begins")).drop("__at", "__file", "__start", "__begins", "__offset")


def ranked(rows: DataFrame, by: Column, name: str = "pos", width: int = 1 << 16) -> DataFrame:
    """Rows with their dense place in ascending order of the unique integer ``by``.

    Places within slices of ``width`` values, plus how many rows the slices
    before hold: the only window without a key is over the slices' counts.
    """
    cut = rows.withColumn("__by", by).withColumn("__slice", F.floor(F.col("__by") / width))
    counts = cut.groupBy("__slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__slice", F.coalesce(before, F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__slice").orderBy("__by")) - 1
    return cut.join(offsets, "__slice").withColumn(name, F.col("__offset") + within).drop("__by", "__slice", "__offset")


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't white space opens an array; of a folder's files, the first filled one's."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.globStatus(at) or [])
    if len(names) == 1 and fs.isDirectory(jvm.org.apache.hadoop.fs.Path(names[0])):
        listed = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(names[0]))]
        names = sorted(p.toString() for p in listed if not p.getName().startswith(("_", ".")))
    for file in names:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(file))
        try:
            byte = stream.read()
            while byte in (9, 10, 11, 12, 13, 32):
                byte = stream.read()
        finally:
            stream.close()
        if byte >= 0:
            return byte == ord("[")
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Filled lines of a JSONL file with pos, dense over them."""
    return numbered(spark.read.text(path, lineSep="\n").where(strip("value") != ""))


def _parsed(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Lines as structs ``row``, null where a line is no record of the schema."""
    kind = _schema(schema)
    marked = T.StructType([*kind.fields, T.StructField("__corrupt", T.StringType())])
    row = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    parsed = lines.withColumn("__row", row)
    good = F.col("__row.__corrupt").isNull() & F.trim("value").startswith("{")
    return parsed.select("pos", "value", F.when(good, F.struct(*[F.col(f"__row.`{f.name}`").alias(f.name) for f in kind.fields])).alias("row"))


def _records(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Parsed lines; one that is no record ends the job."""
    rows = _parsed(lines, schema)
    rows = demand(rows, F.col("row").isNotNull(), F.concat(F.lit("no JSON object in record "), (F.col("pos") + 1).cast("string")))
    return rows.select("pos", "row.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a JSONL file with pos. Blank lines don't count; one that is no record ends the job and is named by its number."""
    return _records(_lines(spark, path), schema)


def _state(text: str, inside: bool) -> tuple[bool, int]:
    """(inside, depth): whether a piece of JSON ends within a string, and how many brackets more it opens than it closes."""
    text = _ESCAPED.sub("", text)
    if inside:
        _, quote, text = text.partition('"')
        if not quote:
            return True, 0
    text, quote, _ = _STRING.sub("", text).partition('"')
    return bool(quote), text.count("{") + text.count("[") - text.count("]") - text.count("}")


_ESCAPED = re.compile(r"\\.", re.S)
_STRING = re.compile(r'"[^"]*"')
# What stands before an element and after the last one; commas may be missing or repeated.
_FIRST = re.compile(r"\ufeff?\s*\[[\s,]*(?=\{)")
_NEXT = re.compile(r"[\s,]*(?=\{)")
_END = re.compile(r"[\s,]*\]\s*")
_EMPTY = re.compile(r"\ufeff?\s*\[[\s,]*\]\s*")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(value, block): the file cut at closing braces, as Spark's text source splits it, and where each piece's split begins."""
    ship(spark)
    return spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_block_start").alias("block"))


def _surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block, and for a start outside and within a string: how it ends, and how often each depth, counted from its start, is met at a closing brace."""
    seen: dict[int, list[tuple[bool, int, Counter]]] = {}
    for b in batches:
        for value, block in zip(b["value"], b["block"], strict=True):
            both = seen.setdefault(block, [(False, 0, Counter()), (True, 0, Counter())])
            for i, (inside, depth, ends) in enumerate(both):
                inside, more = _state(value, inside)
                depth += more - (not inside)
                if not inside:
                    ends[depth] += 1
                both[i] = (inside, depth, ends)
    rows = [(block, start, inside, depth, dict(ends)) for block, both in seen.items() for start, (inside, depth, ends) in enumerate(both)]
    yield pd.DataFrame(rows, columns=["block", "start", "inside", "depth", "ends"])


def _starts(spark: SparkSession, path: str) -> dict[int, tuple[bool, int, int]]:
    """For each block whether it begins within a string, at what depth, and how many elements end before it. An array that isn't closed is an error."""
    rows = _blocks(spark, path).mapInPandas(_surveyed, "block long, start int, inside boolean, depth long, ends map<long, long>")
    found = {(r["block"], r["start"]): r for r in rows.collect()}  # two rows a block
    out, inside, depth, n = {}, False, 0, 0
    for block in sorted({b for b, _ in found}):
        out[block] = (inside, depth, n)
        r = found[block, int(inside)]
        n += r["ends"].get(1 - depth, 0)
        inside, depth = r["inside"], depth + r["depth"]
    # What follows the last closing brace was counted as if one followed it, too.
    if inside or depth != -1:
        raise ValueError(f"no closed JSON array: {path}")
    return out


def _cut_elements(starts: dict[int, tuple[bool, int, int]], path: str):
    """Elements of an array, or the parts of those that a block begins or ends in: pos, block, whole, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: int | None = None
        held: list[str] = []
        whole, inside, depth, n = True, False, 0, 0
        for b in batches:
            out = []
            for value, block in zip(b["value"], b["block"], strict=True):
                if block != now:
                    if held:
                        out.append((n, now, False, "".join(held)))
                    inside, depth, n = starts[block]
                    # Whatever lies at this depth, the block begins between elements or within one.
                    now, held, whole = block, [], not inside and depth <= 1
                if depth <= 1 and not inside:
                    # Depth 0 is that of the file's beginning, -1 what the closing bracket leaves.
                    gap = _FIRST.match(value) if depth == 0 else _NEXT.match(value) if depth == 1 else None
                    if gap is None:
                        if depth < 0 or not (_END if depth else _EMPTY).fullmatch(value):
                            raise ValueError(f"only objects can be elements of the JSON array, and nothing can follow it: {path}, after record {n}")
                        depth = -1
                        continue
                    depth, value = 1, value[gap.end() :]
                inside, more = _state(value, inside)
                depth += more - (not inside)
                held.append(value + "}")
                if depth <= 1 and not inside:
                    out.append((n, block, whole, "".join(held)))
                    held, whole, n = [], True, n + 1
            yield pd.DataFrame(out, columns=["pos", "block", "whole", "value"])
        if held:
            yield pd.DataFrame([(n, now, False, "".join(held))], columns=["pos", "block", "whole", "value"])

    return run


def read_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a file that is one JSON array, with pos; read by as many tasks as the file has splits.

    Spark cuts the file at closing braces, so a piece is never longer than a
    record. A first pass tells for each split how strings and brackets stand
    at its end, for either way in which it may begin; from these, a row or two a split,
    follow each split's beginning and the number of elements before it. Then
    each split is cut into elements. Only the parts of elements that reach
    over a split's border, two a split at most, meet by position.

    Commas may be missing or repeated between elements. A cut or broken array,
    elements that are no objects, and anything after the closing bracket end the job; an array
    that isn't closed is noticed at once.
    """
    if _tail(spark, path) != "]":
        raise ValueError(f"no closed JSON array: {path}")
    cut = _blocks(spark, path).mapInPandas(_cut_elements(_starts(spark, path), path), "pos long, block long, whole boolean, value string")
    pieces = cut.where("not whole").groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "").alias("value"))
    return _records(cut.where("whole").select("pos", "value").unionByName(pieces), schema)


def _tail(spark: SparkSession, path: str) -> str:
    """The last character of a file that isn't white space."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    place, stream = fs.getFileStatus(at).getLen() - 1, fs.open(at)
    try:
        while place >= 0:
            stream.seek(place)
            byte = stream.read()
            if byte not in (9, 10, 11, 12, 13, 32):
                return chr(byte)
            place -= 1
    finally:
        stream.close()
    return ""


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An array file or a JSONL file, by how it begins; an empty file has no records."""
    return read_array(spark, path, schema) if is_array(spark, path) else read_jsonl(spark, path, schema)


def from_table(df: DataFrame, order: str) -> DataFrame:
    """A table's rows as records whose position is a dense integer column."""
    return df.withColumn("pos", F.col(order).cast("long"))


def repair_truncated(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a JSONL log whose last line may have been cut off: that line alone may be broken, and goes."""
    if not path.endswith(".jsonl"):
        raise ValueError("only JSONL logs can be repaired")
    rows = _parsed(_lines(spark, path), schema)
    last = rows.agg(F.max("pos").alias("last"))
    rows = rows.join(F.broadcast(last))  # one row
    torn = F.col("row").isNull() & (F.col("pos") == F.col("last")) & ~F.trim("value").rlike(r"(?s)^([\[\d\"].*[\]\d\"]|true|false|null)$")
    # One condition, as a filter that raises may run before another one.
    broken = F.raise_error(F.concat(F.lit("broken record "), (F.col("pos") + 1).cast("string"))).cast("boolean")
    return rows.where(F.when(torn, F.lit(False)).when(F.col("row").isNotNull(), F.lit(True)).otherwise(broken)).select("pos", "row.*")


def read_indexed(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "video_path") -> DataFrame:
    """Records with a filled, unique key."""
    rows = read_records(spark, path, schema)
    rows = demand(rows.withColumn(key, strip(key)), F.col(key) != "", f"{key} is empty")
    return demand_unique(rows, key)


def read_keys(spark: SparkSession, path: str, key: str = "video_path") -> DataFrame:
    """A key list (pos, key): an array of texts or records (.json), records (.jsonl), or lines of text; unique."""
    if path.endswith(".jsonl"):
        rows = read_records(spark, path, f"{key} string").select("pos", strip(key).alias(key))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("pos", "item"))
        named = F.from_json("item", f"{key} string")[key]
        rows = items.select(F.col("pos").cast("long").alias("pos"), strip(F.when(F.trim("item").startswith("{"), named).otherwise(F.col("item"))).alias(key))
    else:
        rows = _lines(spark, path).select("pos", strip("value").alias(key))
    return demand_unique(demand(rows, F.col(key) != "", f"{key} is empty"), key)


def single(spark: SparkSession, key: str, value: str) -> DataFrame:
    """A table of one record."""
    return spark.createDataFrame([(0, value)], f"pos long, {key} string")


def named_sources(specs: list[str], known: tuple[str, ...] | None = None) -> dict[str, str]:
    """NAME=PATH specifications by name: names filled and unique; with ``known``, exactly those, whatever their case."""
    out: dict[str, str] = {}
    for spec in specs:
        name, eq, path = spec.partition("=")
        name = name.strip().lower() if known else name.strip()
        if not eq or not name or name in out or (known and name not in known):
            raise ValueError(f"invalid or repeated source: {spec!r}")
        out[name] = path
    if not out or (known and set(out) != set(known)):
        raise ValueError(f"missing sources: {sorted(set(known or ()) - set(out))}")
    return out


def output_name(root: str, model: str, tag: str, stem: str, judge_video: bool | None = None) -> str:
    """Where results go unless told otherwise: <root>/<slug of the model>/<tag>-<stem>.jsonl."""
    folder = re.sub(r"[^a-z0-9]+", "-", model.lower()).strip("-") or "model"
    kind = tag if judge_video is None else f"{tag}-{'video' if judge_video else 'text'}"
    return f"{root}/{folder}/{kind}-{stem}.jsonl"
