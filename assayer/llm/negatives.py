"""Hard negatives by a search through buckets of falling norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, ready
from .kdtopk import _count_up, _floor, _integers

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_ROWS = 1024  # rows of a bucket, and a quarter of that anchors of a block, at least
MOST_BYTES = 1 << 25  # of a bucket's components, as doubles
PIECES = 1024  # buckets, and blocks of anchors, that there should be
CELLS = 1 << 20  # scores looked at together
GROWTH = 16  # of the number of buckets from round to round
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def labelled(vectors: DataFrame, classes: int = 10, every: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q, n): floor(SCALE * x) of each component as double; equal rows once, with how many there are.

    Where the id is divisible by ``every``, the label is the next of
    ``classes`` ones. Rows with a null id, label or vector, or a component
    that is null or not finite, go.
    """
    v, label = F.col("v"), F.col("label")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(v.isNotNull() & label.isNotNull() & F.col("vec_id").isNotNull() & fine)
        .select("vec_id", F.when(F.col("vec_id") % every == 0, (label + 1) % classes).otherwise(label).alias("label"), F.transform(v, lambda x: _floor(x * F.lit(float(SCALE)))).alias("q"))
        .groupBy("vec_id", "label", "q")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class Store:
    """How components are held: their type, number, and whether doubles hold all scores."""

    def __init__(self, width: int, most: float):
        self.width = max(width, 1)
        self.kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        self.exact = most * most * self.width < 2.0**53

    def pack(self, rows) -> np.ndarray:
        x = np.zeros((len(rows), self.width), self.kind)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        return x

    def values(self, packed: bytes) -> np.ndarray:
        x = np.frombuffer(packed, self.kind).reshape(-1, self.width).astype(np.float64)
        return x if self.exact else _integers(x)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All inner products; beyond doubles as Python integers, cut to the range of long."""
        s = a @ b.T
        return s if self.exact else np.minimum(np.maximum(s, LOWEST), HIGHEST)


def _falling(rows: DataFrame, pieces: int) -> DataFrame:
    """Rows in ranges of falling norm, of equal norms by id, so that many equal vectors are no range of their own."""
    by = [F.desc("norm"), F.asc("vec_id"), F.asc("sign")]
    return rows.repartitionByRange(pieces, *by).sortWithinPartitions(*by)


def _reach(norm: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """At least the largest score that any vector of a bucket can have (Cauchy-Schwarz, with room for rounding)."""
    return norm * bucket * (1 + 1e-9) + 1


def bucketed(rows: DataFrame, store: Store, size: int, count: int) -> DataFrame:
    """(bucket, most, ids, labels, times, x): candidates by falling norm, ``size`` a bucket; ``most`` is the largest norm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _regrouped(batches, size):
            yield pd.DataFrame({"most": [b["norm"].max()], "ids": [b["vec_id"].tolist()], "labels": [b["label"].tolist()], "times": [b["n"].tolist()], "x": [store.pack(b["q"]).tobytes()]})

    fields = "most double, ids array<long>, labels array<long>, times array<long>, x binary"
    out = _falling(rows, -(-count // size)).select("norm", "vec_id", "label", "n", "q").mapInPandas(run, fields)
    return kept(out.withColumn("bucket", F.monotonically_increasing_id()), "buckets")


def blocked(asked: DataFrame, store: Store, size: int, count: int) -> DataFrame:
    """Anchors by falling norm, ``size`` a block, with their windows one after the other (``owner`` tells the anchor's place)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _regrouped(batches, size):
            windows = [(i, w["positive_id"], w["low"], w["top"], w["kth"]) for i, ws in enumerate(b["windows"]) for w in ws]
            owner, positive, low, top, kth = (list(c) for c in zip(*windows, strict=True)) if windows else ([],) * 5
            one = {"norms": b["norm"].tolist(), "ids": b["vec_id"].tolist(), "signs": b["sign"].tolist(), "labels": b["label"].tolist(), "x": store.pack(b["q"]).tobytes(),
                   "owner": owner, "positive": positive, "low": low, "top": top, "kth": kth}
            yield pd.DataFrame({k: [v] for k, v in one.items()})

    fields = "norms array<double>, ids array<long>, signs array<long>, labels array<long>, x binary, owner array<long>, positive array<long>, low array<long>, top array<long>, kth array<long>"
    out = _falling(asked, -(-count // size)).select("norm", "vec_id", "sign", "label", "q", "windows").mapInPandas(run, fields)
    return kept(out.withColumn("block", F.monotonically_increasing_id()), "anchors")


def _regrouped(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """A partition's rows, ``size`` at a time."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        while len(b):
            held.append(b.iloc[: size - n])
            b = b.iloc[size - n :]
            n += len(held[-1])
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def routes(blocks: DataFrame, tops: list[tuple[int, float]], start: int, stop: int) -> DataFrame:
    """(block, bucket): of the buckets from place ``start`` to ``stop``, those that some window of the block can have a row in."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(tops)  # two numbers a bucket, the largest norm first

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, most = (np.array(c) for c in zip(*shared.value, strict=True))
        for b in batches:
            for block, norms, owner, low, kth in b[["block", "norms", "owner", "low", "kth"]].itertuples(index=False):
                if not len(owner):
                    continue
                norm, limit = np.asarray(norms)[np.asarray(owner)], np.maximum(low, kth).astype(np.float64)
                # Norms fall, so what can be reached is a beginning of the buckets.
                near, far = 0, len(most)
                while near < far:
                    mid = (near + far) // 2
                    if (_reach(norm, most[mid]) >= limit).any():
                        near = mid + 1
                    else:
                        far = mid
                to = ids[start : min(near, stop)]
                yield pd.DataFrame({"block": np.full(len(to), block), "bucket": to})

    return blocks.select("block", "norms", "owner", "low", "kth").mapInPandas(run, "block long, bucket long")


def _best(score: np.ndarray, ids: np.ndarray, least: np.ndarray, top: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, column) of the k best scores of each window between its limits, ties to smaller ids."""
    fits = allowed & (score >= least[:, None]) & (score <= top[:, None])
    if score.dtype != object and np.count_nonzero(fits) > 8 * k * len(score) and score.shape[1] > k:
        held = np.where(fits, score, -np.inf)
        fits &= score >= np.partition(held, -k, axis=1)[:, -k][:, None]
    w, c = np.nonzero(fits)
    order = np.lexsort((ids[c], _falling_rank(score[w, c]), w))
    w, c = w[order], c[order]
    first = _count_up(w) < k
    return w[first], c[first]


def _falling_rank(values: np.ndarray) -> np.ndarray:
    """Numbers that order as the negated values do, also for Python integers."""
    if values.dtype != object:
        return -values
    place = {v: i for i, v in enumerate(sorted(set(values.tolist()), reverse=True))}
    return np.array([place[v] for v in values.tolist()], np.int64)


def visit(pairs: DataFrame, store: Store, k: int, same: bool) -> DataFrame:
    """(anchor_id, sign, positive_id, top, vec_id, n, score): each bucket's k best rows for each window that visits it.

    A bucket's rows are looked at in falling norm, some at a time, with the
    k-th best score so far as the limit of those to come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows, ids, labels, times = store.values(r.x), np.asarray(r.ids), np.asarray(r.labels), np.asarray(r.times)
                asked, norms, a_ids, a_labels = store.values(r.a_x), np.asarray(r.norms), np.asarray(r.a_ids), np.asarray(r.a_labels)
                owner, low, top, kth = (np.asarray(c) for c in (r.owner, r.low, r.top, r.kth))
                near = np.flatnonzero(_reach(norms[owner], r.most) >= np.maximum(low, kth))
                wide = max(1, min(len(ids), 4096))
                tall = max(1, CELLS // wide)
                for at in range(0, len(near), tall):
                    of = near[at : at + tall]
                    mine = owner[of]
                    who, local = np.unique(mine, return_inverse=True)
                    least, found = np.maximum(low[of], kth[of]), []
                    held = np.full((len(of), k), LOWEST, np.int64)
                    for start in range(0, len(ids), wide):
                        part = slice(start, start + wide)
                        allowed = ((a_labels[who][:, None] == labels[part]) == same) & (a_ids[who][:, None] != ids[part])
                        score = store.scores(asked[who], rows[part])[local]
                        w, c = _best(score, ids[part], least, top[of], allowed[local], k)
                        value = score[w, c].astype(np.int64)
                        found.append((w, c + start, value))
                        more = np.full((len(of), k), LOWEST, np.int64)
                        more[w, _count_up(w)] = value
                        held = -np.sort(-np.concatenate([held, more], axis=1), axis=1)[:, :k]
                        least = np.maximum(least, held[:, -1])
                    w, c, value = (np.concatenate(x) for x in zip(*found, strict=True))
                    good = value >= least[w]
                    w, c, value = w[good], c[good], value[good]
                    who = mine[w]
                    yield pd.DataFrame(
                        {"anchor_id": a_ids[who], "sign": np.asarray(r.signs)[who], "positive_id": np.asarray(r.positive)[of[w]], "top": top[of[w]],
                         "vec_id": ids[c], "n": times[c], "score": value}
                    )

    return pairs.mapInPandas(run, "anchor_id long, sign long, positive_id long, top long, vec_id long, n long, score long")


WINDOW = ["anchor_id", "sign", "positive_id", "top"]


def rounds(buckets: int) -> list[tuple[int, int]]:
    """Places of buckets that are looked into together: one, then GROWTH times as many each time."""
    out, start, wide = [], 0, 1
    while start < buckets:
        out.append((start, min(buckets, start + wide)))
        start, wide = start + wide, wide * GROWTH
    return out


def search(asked: DataFrame, buckets: DataFrame, tops: list[tuple[int, float]], store: Store, size: int, count: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each window: WINDOW, rank, vec_id, score.

    Blocks of anchors look into the buckets by falling norm, in a few rounds.
    After each, the k-th score that a window has so far becomes its limit, and
    a bucket whose norms can't reach any limit of a block isn't looked into.
    """
    best, by = None, Window.partitionBy(*WINDOW).orderBy(F.desc("score"), "vec_id")
    for start, stop in rounds(len(tops)):
        now = asked
        if best is not None:
            best = kept(best, "best")
            reached = best.groupBy(*WINDOW).agg(F.when(F.sum("n") >= k, F.min("score")).alias("kth")).where("kth is not null")
            reached = reached.groupBy(F.col("anchor_id").alias("vec_id"), "sign").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("positive_id", "top"), "kth"))).alias("reached"))  # a window each
            kth = lambda w: F.coalesce(F.try_element_at("reached", F.struct(w["positive_id"], w["top"])), w["kth"])
            now = asked.join(reached, ["vec_id", "sign"], "left").withColumn("windows", F.transform("windows", lambda w: w.withField("kth", kth(w)))).drop("reached")
        blocks = blocked(now, store, size, count)
        a = blocks.select("block", "norms", F.col("ids").alias("a_ids"), "signs", F.col("labels").alias("a_labels"), F.col("x").alias("a_x"), "owner", "positive", "low", "top", "kth")
        found = visit(routes(blocks, tops, start, stop).join(a, "block").join(buckets, "bucket").drop("block", "bucket"), store, k, same)
        best = (found if best is None else best.unionByName(found)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")
    copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))
    return best.withColumn("copy", copies).select(*WINDOW, F.row_number().over(by).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shifted: int = 7,
    classes: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Hard negatives of each anchor and positive: near the anchor, but not nearer than the positive.

    Anchors are the rows whose id is divisible by ``every``. An anchor's
    positives are its first rows of the same label, by integer inner product
    and then by id; a positive's negatives are the first rows of other labels
    that score between four fifths of it and all of it. A positive that scores
    below zero has none.

    Both are searches through the same buckets of candidates, sorted by norm:
    no row of a bucket can score more than the anchor's norm times the
    bucket's largest. A bucket is left out where that is below the window's
    lower limit, or below the k-th score that the window already has. Buckets
    and blocks of anchors grow with the table to bounded sizes and meet in a
    join, so no task holds more than one of each. Where all norms are equal,
    as of unit vectors, a bucket is left out only where a window asks for more
    than any row can give: each anchor then meets all rows, which is exact and costs what that costs.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part; shorter vectors count as padded with zeros. Rows
    that repeat an anchor's id are neither its positives nor its negatives.
    Repeated rows count as often as they occur among positives and negatives,
    but ask once; anchors that share an id and differ ask each for itself.
    Scores are exact, and cut to the range of long. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score; none for
    an empty table. Other columns play no part.
    """
    spark = ready(vectors.sparkSession)
    base = labelled(vectors, classes, shifted, id_col, vector_col, label_col)
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    base = kept(base.withColumns({"norm": F.sqrt(square), "sign": F.xxhash64("label", "q")}), "vectors")
    asks: Column = F.col("vec_id") % every == 0
    info = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(asks).alias("anchors"),
        F.max(F.size("q")).alias("width"),
        F.max(F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"),
    ).first()
    if not info["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    store = Store(info["width"], info["most"] or 0.0)
    most_rows = max(1, MOST_BYTES // (8 * store.width))
    size = min(most_rows, max(LEAST_ROWS, info["n"] // PIECES))
    block = min(most_rows, max(LEAST_ROWS // 4, info["anchors"] // PIECES))
    buckets = bucketed(base, store, size, info["n"])
    tops = [(r["bucket"], r["most"]) for r in buckets.select("bucket", "most").orderBy(F.desc("most"), "bucket").collect()]  # a row a bucket

    def window(positive: Column, low: Column, top: Column) -> Column:
        return F.struct(positive.alias("positive_id"), low.alias("low"), top.alias("top"), F.lit(LOWEST).alias("kth"))

    anchors = base.where(asks).select("vec_id", "sign", "label", "q", "norm")
    every_row = window(F.lit(None).cast("long"), F.lit(LOWEST), F.lit(HIGHEST))
    first = search(anchors.withColumn("windows", F.array(every_row.withField("positive_id", F.lit(0).cast("long")))), buckets, tops, store, block, info["anchors"], positives, True)
    near = first.where("score >= 0").select(F.col("anchor_id").alias("vec_id"), "sign", F.col("vec_id").alias("positive_id"), "score").distinct()
    # Four fifths, rounded up. Each anchor has POSITIVES windows at most.
    near = near.groupBy("vec_id", "sign").agg(F.collect_list(window(F.col("positive_id"), F.expr("score - score div 5"), F.col("score"))).alias("windows"))
    asked = kept(anchors.join(near, ["vec_id", "sign"]), "windows")
    found = search(asked, buckets, tops, store, block, info["anchors"], negatives, False)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE_SQL = r"""
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
WHERE rank <= 5
"""
