"""Target-distribution importance resampling on hashed word n-grams, whose CRCs come from the words' CRCs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranks
from .common import kept, ready
from .windows import groups

BUCKETS = 10_000
LONGEST = 3  # words of a feature
SMOOTHED = 1000  # steps of a gain in one unit of the logarithm

#: Every byte that a word can't hold becomes a space, A-Z become a-z.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _bytewise() -> np.ndarray:
    """The CRC-32 register after one byte, for each value of its lowest byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, as its products with every value of each of the four bytes, times registers."""
    out = matrix[0][crc & 255]
    for j in (1, 2, 3):
        out = out ^ matrix[j][(crc >> np.uint32(8 * j)) & 255]
    return out


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """The matrices that shift a CRC by 0, 1 ... 63 bytes, and by 64, 128, 256 ... bytes."""
    step = _bytewise()
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = []
    for _ in range(64):
        short.append(now)
        now = (now >> np.uint32(8)) ^ step[now & 255]
    long = []
    for _ in range(26):
        long.append(now)
        now = _apply(now, now)  # the matrix squared: twice the length
    return np.stack(short), np.stack(long)


_SHORT, _LONG = _shifts()
_FLAT = _SHORT.ravel()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs carried over ``length`` more bytes: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    at = (length & 63) << 10
    out = _FLAT[at + (crc & 255)]
    for j in (1, 2, 3):
        out = out ^ _FLAT[at + (256 * j) + ((crc >> np.uint32(8 * j)) & 255)]
    rest, k = length >> 6, 0
    while rest.any():
        far = np.flatnonzero(rest & 1)
        out[far] = _apply(_LONG[k], out[far])
        rest, k = rest >> 1, k + 1
    return out


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for runs of 1, 2 ... words (the texts they are of, their buckets).

    Each different word's CRC is computed once. A longer run's CRC is that of
    the run without its last word, shifted by the last word and the space
    before it, plus theirs; no run is ever put together.
    """
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.translate(_WORDS).split()
        counts[i] = len(found)
        words += found
    owner = np.repeat(np.arange(len(texts)), counts)
    if not words:
        return counts, [(owner, owner)] * longest
    different = dict.fromkeys(words)
    for i, w in enumerate(different):
        different[w] = i
    at = np.fromiter(map(different.__getitem__, words), np.int64, len(words))
    crc = np.fromiter(map(zlib.crc32, different), np.uint32, len(different))
    size = np.fromiter(map(len, different), np.int64, len(different))
    spaced = shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
    run, added, size = crc[at], spaced[at], size[at] + 1
    out = [(owner, (run % np.uint32(buckets)).astype(np.int64))]
    for k in range(1, longest):
        run = shift(run[:-1], size[k:]) ^ added[k:]
        inside = owner[k:] == owner[: len(run)]
        out.append((owner[k:][inside], (run[inside] % np.uint32(buckets)).astype(np.int64)))
    return counts, out


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts in pieces of bounded size, with where each begins; nulls are empty."""
    every = [t or b"" for t in column.to_pylist()]
    for part in groups(every):
        yield part.start, every[part]


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all texts have in each bucket. A task sends a row a bucket, so what meets is bounded by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in _texts(b.column(0)):
                for _, where in features(texts, longest, buckets)[1]:
                    total += np.bincount(where, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: the smoothed log of how much commoner it is in the target."""
    k = len(corpus)
    whole, wanted = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(SMOOTHED * math.log((float(t + 1) * whole) / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): each document's sum of gains over its features."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, number, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for start, texts in _texts(b.column(1)):
                counts, runs = features(texts, longest, len(table.value))
                part = slice(start, start + len(texts))
                words[part] = counts
                for owner, where in runs:
                    number[part] += np.bincount(owner, minlength=len(texts))
                    weight[part] += _sums(owner, table.value[where], len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(number), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The integer sums of each owner's values; owners ascend."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return upto[ends[1:]] - upto[ends[:-1]]


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Documents drawn without repetition in proportion to how much likelier the target's texts make them.

    Features are runs of one to three words, counted in 10,000 hashed buckets
    over all documents and over all texts of ``target``. A document's weight is
    the sum of its features' gains; its score adds a Gumbel variable that the
    seed and its id fix, so the highest scores are such a draw. Of the documents with at
    least ``least_words`` words, ``percent`` in a hundred (rounded down) are
    drawn, ties to the smaller id.

    The corpus is read twice, for the counts and for the weights; each pass
    keeps a table of a number a bucket. Scores are ranked in ranges of their
    values, so no task sees them all.

    Nulls: a null text has no words, a null id counts as the empty text in the
    seed and orders last. Repeated rows are documents of their own, each with
    the same score and a rank of its own. Very long texts are read whole.
    Returns doc_id, n_features, weight, score, rank (from 1; null if not
    drawn), n_words, for every row; none for an empty table. Without target
    texts all buckets gain by how rare they are. Other columns play no part.
    """
    ready(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = kept(weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel), "weights")
    enough = F.col("n_words") >= least_words
    draw = scored.where(enough).count() * percent // 100
    place = ranks(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    rank = F.when(F.col("rank") < draw, F.col("rank") + 1)
    out = place.withColumn("rank", rank).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
