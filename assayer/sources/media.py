"""Media files as listings: what is where, and which frames stand for a video."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import FRAME_SUFFIXES, is_frame, is_video, media_candidates, natural_key, single_problem, uniform_indices
from ..functions.text import filled
from ..operators.order import ranks
from ..scratch import written
from ..shipping import ship


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind) of the media below a folder: images, videos, and folders that hold frames.

    Only names are read. Paths are as below ``root``, with ``root`` before them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    inside = F.substring_index(F.col("path"), base + "/", -1)
    names = files.select(F.concat(F.lit(base + "/"), inside).alias("path"))
    single = names.select("path", F.when(is_frame("path"), F.lit("image")).when(is_video("path"), F.lit("video")).alias("kind")).where("kind is not null")
    folders = names.where(is_frame("path")).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.lit("frames").alias("kind")).distinct()
    return single.unionByName(folders)


def _arrow_path(path: str):
    """The file system and path that Arrow knows a file by; None where it knows no such file system."""
    from pyarrow import ArrowInvalid, fs

    if re.match("(file:)?/", path):
        return fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path)
    store, rest = re.fullmatch("([^:/]+://[^/]*)?(.*)", path, re.S).groups()
    try:
        files, base = fs.FileSystem.from_uri(f"{store or 'file://'}/")
    except ArrowInvalid:
        return None
    return files, base.rstrip("/") + rest


def entries(folders: DataFrame) -> DataFrame:
    """(path, folder): what lies directly in the folders of the column ``path``, and whether it is a folder; folders that aren't there hold nothing.

    Each folder is listed once, by whichever task it falls to, through Arrow's file systems.
    """
    ship(folders.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for path in b["path"]:
                files, at = _arrow_path(path)
                found = files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if files.get_file_info(at).type == fs.FileType.Directory else []
                yield pd.DataFrame({"path": [f"{path}/{f.base_name}" for f in found], "folder": [f.type == fs.FileType.Directory for f in found]}).astype({"path": str, "folder": bool})

    return folders.select("path").distinct().repartition("path").mapInPandas(run, "path string, folder boolean")


def touch(files: DataFrame, root: str) -> None:
    """Makes the files of the column ``path`` below a folder, empty ones, each by the task that it falls to."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _arrow_path(root)
        for b in batches:
            for path in b["path"]:
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                store.open_output_stream(f"{base}/{path}").close()
            yield b.iloc[:0]

    files.select("path").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def locate_below(rows: DataFrame, root: str, key: str = "video_path") -> DataFrame:
    """Like :func:`locate`, but lists only the folders that candidates lie in, and then those candidates that are folders.

    So the work follows the rows, not what else ``root`` holds. File systems that only Spark
    reads are listed as a whole, as :func:`listing` does.
    """
    base = root.rstrip("/")
    if _arrow_path(base) is None:
        return locate(rows, listing(rows.sparkSession, base), base, key)
    candidates = rows.select(F.explode(media_candidates(key, base)).alias("path")).distinct()
    beside = entries(candidates.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")))
    found = written(beside.join(candidates, "path", "left_semi"), "candidates")
    inside = entries(found.where("folder")).where(~F.col("folder") & is_frame("path"))
    folders = inside.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), F.lit("frames").alias("kind")).distinct()
    single = found.where("not folder").select("path", F.when(is_frame("path"), F.lit("image")).when(is_video("path"), F.lit("video")).alias("kind"))
    return locate(rows, single.where("kind is not null").unionByName(folders), base, key)


def single(spark: SparkSession, path: str) -> tuple[str, str]:
    """(path, kind) of the one medium of a run: a video or image file, or a folder that holds frames; all else is an error."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    folder = fs.getFileStatus(at).isDirectory()
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isFile()] if folder else []
    frames = sum(n.lower().endswith(FRAME_SUFFIXES) for n in names) if folder else None
    row = spark.range(1).select(single_problem(F.lit(path), F.lit(frames).cast("int")).alias("problem"), is_video(F.lit(path)).alias("video")).first()
    if row["problem"]:
        raise ValueError(f"{path}: {row['problem']}")
    return path, "frames" if folder else "video" if row["video"] else "image"


def locate(rows: DataFrame, media: DataFrame, root: str, key: str = "video_path") -> DataFrame:
    """Rows with ``media_path`` and ``media_kind`` of the best candidate that exists; null where none does."""
    base = root.rstrip("/")
    candidates = rows.select(key, F.posexplode(media_candidates(key, base)).alias("rank", "path")).distinct()
    best = (
        candidates.join(media, "path")
        .groupBy(key)
        .agg(F.min(F.struct("rank", F.when(F.col("kind") == "frames", 0).otherwise(1).alias("later"), "path", "kind")).alias("b"))
        .select(key, F.col("b.path").alias("media_path"), F.col("b.kind").alias("media_kind"))
    )
    return rows.join(best, key, "left")


def sampled_frames(located: DataFrame, media: DataFrame, wanted: int) -> DataFrame:
    """Rows with ``frame_paths``, spread evenly over a folder's frames in natural order, or ``video_file``.

    Frames get their place in their folder by ranges of the order, so a folder
    of very many is no one task's; only the wanted ones meet in a row.
    """
    folder, name = (F.regexp_extract("path", r"^(.*)/([^/]*)$", i) for i in (1, 2))
    images = media.where("kind = 'image'").select(folder.alias("media_path"), name.alias("name"), natural_key(name).alias("key"))
    placed = ranks(images, ["key", "name"], ("media_path",), "at")
    indices = images.groupBy("media_path").agg(F.count(F.lit(1)).alias("n")).select("media_path", F.posexplode(uniform_indices("n", wanted)).alias("k", "at"))
    picked = placed.join(indices, ["media_path", "at"]).select("media_path", "k", F.concat(F.col("media_path"), F.lit("/"), F.col("name")).alias("frame"))
    spread = F.transform(F.array_sort(F.collect_list(F.struct("k", "frame"))), lambda x: x["frame"])
    out = located.join(picked.groupBy("media_path").agg(spread.alias("spread")), "media_path", "left")
    return out.select(
        *located.columns,
        F.when(F.col("media_kind") == "frames", F.col("spread")).when(F.col("media_kind") == "image", F.array("media_path")).alias("frame_paths"),
        F.when(F.col("media_kind") == "video", filled("media_path")).alias("video_file"),
    )
