"""Paths and frame indices as Column expressions; pixels stay out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, present

# Suffixes of frames and videos.
FRAME_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm")
#: Both, in code point order.
SUFFIXES = tuple(sorted({*FRAME_SUFFIXES, *VIDEO_SUFFIXES}))


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(present(path), r"[^/.]+(\.[^./]*)$", 1))


def is_frame(path: Column | str) -> Column:
    return suffix(path).isin(*FRAME_SUFFIXES)


def is_video(path: Column | str) -> Column:
    return suffix(path).isin(*VIDEO_SUFFIXES)


def uniform_indices(count: Column | str, wanted: int) -> Column:
    """``wanted`` indices of ``count`` frames, ends included, half to even; all if there are no more."""
    if wanted <= 0:
        raise ValueError("the number of frames must be positive")
    n = col(count).cast("int")
    everything = F.sequence(F.lit(0), n - 1)
    if wanted == 1:
        some = F.array(F.floor(n / 2).cast("int"))
    else:
        some = F.transform(
            F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(wanted - 1))).cast("int")
        )
    return F.when(n <= 0, F.raise_error(F.lit("the video contains no frames")).cast("array<int>")).when(n <= wanted, everything).otherwise(some)


def uniform_indices_distinct(count: Column | str, wanted: int) -> Column:
    """The lenient variant: at least one frame counts, one wanted gives the first, repeats go."""
    n = F.greatest(F.lit(1), col(count).cast("int"))
    target = F.greatest(F.lit(1), F.least(F.lit(wanted), n))
    spread = F.transform(F.sequence(F.lit(0), target - 1), lambda i: F.bround(i * (n - 1) / (target - 1)).cast("int"))
    return F.when(target == 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(spread)))


def even_frames(frames: Column) -> Column:
    """With the last frame twice if the number is odd."""
    return F.when(F.size(frames) % 2 == 1, F.array_append(frames, F.element_at(frames, -1))).otherwise(frames)


def natural_key(name: Column | str) -> Column:
    """Bytes by which names sort with their digit runs as numbers and other text without case, in code point order.

    Text and digit runs take turns, text first, if only an empty one. A text
    ends with a zero byte, so that a shorter one comes before what goes on
    with more; of a digit run, its length without leading zeros comes first, in six
    digits, so longer numbers come later. Names mustn't hold zero bytes. Names
    that differ in case or leading zeros only have the same key.
    """
    runs = F.regexp_extract_all(F.lower(present(name)), F.lit(r"([^0-9]*)([0-9]*)"), F.lit(0))

    def key(run: Column) -> Column:
        number = F.regexp_extract(run, "0*([0-9]*)$", 1)  # empty for zero
        ended = F.concat(F.regexp_extract(run, "^([^0-9]*)", 1), F.lit("\u0000"))
        return F.when(run.rlike("[0-9]$"), F.concat(ended, F.lpad(F.length(number).cast("string"), 6, "0"), number)).otherwise(ended)

    return F.array_join(F.transform(F.filter(runs, lambda r: r != ""), key), "").cast("binary")


def natural_sort(names: Column) -> Column:
    keyed = F.transform(names, lambda x: F.struct(natural_key(x).alias("k"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])


def duration_seconds(frames: Column | str, fps: Column | str) -> Column:
    return F.when((col(fps) > 0) & (col(frames) > 0), col(frames) / col(fps)).otherwise(F.lit(0.0))


def frames_dir(path: Column | str, root: str = "") -> Column:
    """The folder of a video's frames: videos/… becomes frames/…, an absolute path frames/<its stem>; null for others."""
    p = present(path)
    stem = F.regexp_extract(p, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.when(p.startswith("/") & is_video(p), F.concat(F.lit(f"{root}frames/"), stem)).when(
        p.startswith("videos/"), F.concat(F.lit(f"{root}frames/"), F.substring(p, 8, 1 << 30))
    )


def media_candidates(path: Column | str, root: str) -> Column:
    """Where a video's frames or file may be, best first."""
    p = present(path)
    inside = F.regexp_extract(p, r"^(?i)videos/(.*)$", 1)
    plain = F.array(F.concat(F.lit(f"{root}/"), p), F.concat(F.lit(f"{root}/frames/"), p))
    return (
        F.when(p.startswith("/"), F.array(p))
        .when(inside != "", F.concat(F.array(F.concat(F.lit(f"{root}/frames/"), inside), F.concat(F.lit(f"{root}/"), p)), plain))
        .otherwise(plain)
    )


def data_uri(image: Column | str, kind: str = "image/jpeg") -> Column:
    """Bytes as a data URI, without the line breaks that base64 puts after each 76 characters."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(col(image)), "\r\n", ""))


def frame_blocks(uris: Column, detail: str = "auto") -> Column:
    """A numbered caption and an image part for each frame, as a message's content."""
    n = F.size(uris).cast("string")

    def two(uri: Column, i: Column) -> Column:
        none = F.lit(None).cast("struct<url: string, detail: string>")
        caption = F.concat(F.lit("[frame "), (i + 1).cast("string"), F.lit("/"), n, F.lit("]"))
        return F.array(
            F.struct(F.lit("text").alias("type"), caption.alias("text"), none.alias("image_url")),
            F.struct(
                F.lit("image_url").alias("type"),
                F.lit(None).cast("string").alias("text"),
                F.struct(uri.alias("url"), F.lit(detail).alias("detail")).alias("image_url"),
            ),
        )

    return F.flatten(F.transform(uris, two))


def content_with_frames(prompt: Column | str, blocks: Column) -> Column:
    none = F.lit(None).cast("struct<url: string, detail: string>")
    lead = F.struct(F.lit("text").alias("type"), present(prompt).alias("text"), none.alias("image_url"))
    return F.concat(blocks, F.array(lead))


def single_problem(path: Column | str, frames: Column) -> Column:
    """What is wrong with a path as the one medium of a run, or null.

    ``frames`` is how many frames a folder holds, null for a file. A folder
    needs one, a file the suffix of a frame or a video.
    """
    kind = suffix(path)
    known = F.concat(F.when(kind == "", F.lit("a file without a suffix")).otherwise(kind), F.lit(f" is none of {', '.join(SUFFIXES)}"))
    return F.when(frames == 0, F.lit("a folder without frames")).when(frames.isNull() & ~kind.isin(*SUFFIXES), known)


def latest_version(name: Column | str) -> Column:
    """Aggregate: of names that carry numbers, such as checkpoints, the one that sorts last with digit runs as numbers."""
    return F.max_by(col(name), natural_key(name))
