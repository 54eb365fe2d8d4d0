"""Exact top-k by inner product over KD-trees, one a shard, searched best-first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, ready, sampled

TOP = 10
SCALE = 1024
SHARD_ROWS = 8192  # vectors of a shard, about
SHARD_BYTES = 1 << 23  # and what their components take, at most
BLOCK_ROWS = 4096  # queries that visit a shard at a time, about
PIECE_ROWS = 4096  # visits that are written at a time, about
LEAF = 64  # vectors of a leaf
SPLIT_ROWS = 16384  # vectors that the splits above the shards are taken from, at most
BOX_BYTES = 1 << 25  # of the regions' boxes, which travel to all queries


class Tree:
    """A KD-tree by median splits, with the tight box of each node's vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        order = np.arange(len(x))
        lo, hi, left, right, span = [], [], [], [], []

        def build(a: int, b: int) -> int:
            part = x[order[a:b]]
            node = len(lo)
            lo.append(part.min(0))
            hi.append(part.max(0))
            left.append(-1)
            right.append(-1)
            span.append((a, b))
            wide = hi[node].astype(np.float64) - lo[node]
            axis = int(wide.argmax()) if len(wide) else 0
            if b - a > LEAF and len(wide) and wide[axis] > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
                left[node] = build(a, a + mid)
                right[node] = build(a + mid, b)
            return node

        if len(x):
            build(0, len(x))
        self.order, self.left, self.right, self.span = order, left, right, span
        self.lo, self.hi = np.array(lo), np.array(hi)

    def ready(self, exact: bool) -> None:
        """Values as the search adds them up: doubles, or Python integers where doubles lose some."""
        self.x, self.lo, self.hi = ((v.astype(np.float64) if exact else _integers(v)) for v in (self.x, self.lo, self.hi))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that any point of each node's box can have with each query."""
        return np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, kth: float, k: int) -> list[tuple]:
        """The k best (score, -id, place), ties to the smaller id, of what scores at least ``kth``; the query's own id isn't one.

        Best-first: the open node of the largest bound is next, and none whose
        bound is below the k-th best score so far can hold a better one.
        """
        best: list[tuple] = []  # (score, -id, place), the worst first
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            rows = self.order[slice(*self.span[node])]
            score = self.x[rows] @ q
            for i in np.flatnonzero(score >= kth):
                who = int(self.ids[rows[i]])
                if who == own:
                    continue
                item = (score[i], -who, int(rows[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return sorted(best, reverse=True)


def _floor(x: Column) -> Column:
    """The floor as a double; beyond 2^52 doubles have no fraction."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(SCALE * x) of each component, x as double; without rows that are null or not all finite."""
    limit = F.lit(float("inf"))
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(v.isNotNull() & F.col("vec_id").isNotNull() & fine)
        .select("vec_id", F.transform(v, lambda x: _floor(x * F.lit(float(SCALE)))).alias("q"))
    )


class Splits:
    """Median splits of a sample into regions: the upper levels of the KD-tree that all shards share."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.axis, self.at, self.child, self.regions = [], [], [], 0

        def build(rows: np.ndarray, wanted: int) -> int:
            x = sample[rows]
            wide = x.max(0) - x.min(0) if x.size else np.zeros(0)
            if wanted > 1 and len(wide) and wide.max() > 0:
                axis = int(wide.argmax())
                values = np.sort(x[:, axis])
                at = values[len(values) // 2]
                at = at if at > values[0] else values[values > values[0]][0]
                low = x[:, axis] < at
                node = len(self.axis)
                self.axis.append(axis)
                self.at.append(at)
                self.child.append((0, 0))
                self.child[node] = (build(rows[low], wanted // 2), build(rows[~low], wanted - wanted // 2))
                return node
            self.regions += 1
            return -self.regions

        self.root = build(np.arange(len(sample)), regions)

    def regions_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                low = x[rows, self.axis[node]] < self.at[node]
                todo += [(self.child[node][0], rows[low]), (self.child[node][1], rows[~low])]
        return out


@dataclass(frozen=True)
class Shards:
    """The vectors' shards with a tree each, and the boxes of the regions that they are parts of."""

    width: int
    exact: bool  # doubles hold all scores
    kind: str  # how components are stored
    rows: DataFrame  # vec_id, n, x, region, part: every vector
    trees: DataFrame  # region, part, tree
    count: int  # of shards
    region: np.ndarray  # regions that hold vectors
    parts: np.ndarray  # shards of each
    lo: np.ndarray
    hi: np.ndarray

    def values(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.kind).reshape(len(packed), self.width)


def shards(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Shards | None:
    """Every vector in its shard, and each shard's tree, built once; None if there are none.

    Median splits of a bounded sample cut space into regions of about a shard's
    size; a region with more vectors than that, such as many equal ones, is
    dealt into parts by hash. So a shard's box is that of neighbours.
    """
    ready(vectors.sparkSession)
    # Equal rows are one with a count, so a row repeated many times makes no shard large.
    base = kept(quantised(vectors, id_col, vector_col).groupBy("vec_id", "q").agg(F.count(F.lit(1)).alias("n")), "vectors")
    info = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("q")).alias("width"),
        F.max(F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"),
    ).first()
    if not info["n"]:
        return None
    n, width, most = info["n"], max(info["width"], 1), info["most"] or 0.0
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    size = min(SHARD_ROWS, max(1, SHARD_BYTES // (8 * width)))

    def matrix(rows) -> np.ndarray:
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        return x

    regions = min(-(-n // size), SPLIT_ROWS // 4, max(1, BOX_BYTES // (16 * width)))
    sample = [r["q"] for r in sampled(base, SPLIT_ROWS, "vec_id", "q").select("q").collect()] if regions > 1 else []
    splits = Splits(matrix(sample), regions)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["q"])
            yield pd.DataFrame({"vec_id": b["vec_id"], "n": b["n"], "x": [r.tobytes() for r in x.astype(kind)], "region": splits.regions_of(x)})

    placed = kept(base.mapInPandas(place, "vec_id long, n long, x binary, region int"), "placed")
    parts = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    # A row a region: SPLIT_ROWS / 4 of them at most.
    rows = placed.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), "parts").cast("int"))

    def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["vec_id", "x"], ignore_index=True)
        x = np.frombuffer(b"".join(b["x"]), kind).reshape(len(b), width)
        tree = Tree(x, b["vec_id"].to_numpy())
        tree.times = b["n"].to_numpy()
        lo, hi = x.min(0).astype("<f8").tobytes(), x.max(0).astype("<f8").tobytes()
        return pd.DataFrame({"region": [key[0]], "part": [key[1]], "lo": [lo], "hi": [hi], "tree": [pickle.dumps(tree)]})

    trees = kept(
        rows.select("region", "part", "vec_id", "n", "x").groupBy("region", "part").applyInPandas(build, "region int, part int, lo binary, hi binary, tree binary"),
        "trees",
    )

    def enclose(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.frombuffer(b"".join(b[c])).reshape(len(b), width) for c in ("lo", "hi"))
        return pd.DataFrame({"region": [key[0]], "parts": [len(b)], "lo": [lo.min(0).tobytes()], "hi": [hi.max(0).tobytes()]})

    boxes = trees.select("region", "lo", "hi").groupBy("region").applyInPandas(enclose, "region int, parts int, lo binary, hi binary").orderBy("region").collect()
    lo, hi = (np.stack([np.frombuffer(r[c]) for r in boxes]) for c in ("lo", "hi"))
    count = np.array([r["parts"] for r in boxes])
    exact = most * most * width < 2.0**53
    return Shards(width, exact, kind, rows.select("vec_id", "n", "x", "region", "part"), trees, int(count.sum()), np.array([r["region"] for r in boxes]), count, lo, hi)


ROUTE = "region int, part int, block int, vec_id long, sign long, x binary, kth double"


def routes(asked: DataFrame, built: Shards, blocks: int, first: bool) -> DataFrame:
    """(region, part, block, vec_id, sign, x, kth): the shards that queries visit.

    First a shard of the region with the largest bound; later, with a kth best
    score, all other shards whose region's bound reaches it. Where doubles
    don't hold the scores, all others.
    """
    tell = (built.width, built.exact, built.kind, built.region, built.parts, built.lo, built.hi)
    shared = asked.sparkSession.sparkContext.broadcast(tell)  # BOX_BYTES of boxes, about

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, exact, kind, region, parts, lo, hi = shared.value
        for b in batches:
            if not len(b):
                continue
            q = np.frombuffer(b"".join(b["x"]), kind).reshape(len(b), width).astype(np.float64)
            bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
            best = bound.argmax(1)
            own = b["salt"].to_numpy() % parts[best]
            if first:
                pieces = [(np.arange(len(b)), best, own)]
            else:
                near = bound >= b["kth"].to_numpy()[:, None] if exact else np.ones_like(bound, bool)
                pieces = _others(*np.nonzero(near), parts, best, own)
            for at, to, part in pieces:
                yield pd.DataFrame(
                    {"region": region[to], "part": part, "block": b["salt"].to_numpy()[at] // 1024 % blocks, "vec_id": b["vec_id"].to_numpy()[at],
                     "sign": b["sign"].to_numpy()[at], "x": b["x"].to_numpy()[at], "kth": b["kth"].to_numpy()[at]}
                )

    return asked.select("vec_id", "sign", "x", "kth", F.pmod(F.xxhash64(F.lit(1), "vec_id", "sign"), F.lit(1 << 30)).alias("salt")).mapInPandas(run, ROUTE)


def _others(at: np.ndarray, to: np.ndarray, parts: np.ndarray, best: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
    """(query, region, part) of all shards of the regions ``to`` that queries ``at`` reach, but for the one visited first, PIECE_ROWS at a time.

    Only a query's vector for PIECE_ROWS shards, or for those of one region, is held at once.
    """
    piece = np.cumsum(parts[to]) // PIECE_ROWS
    for hits in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
        times = parts[to[hits]]
        i, j = np.repeat(at[hits], times), np.repeat(to[hits], times)
        part = _count_up(i, j)
        other = (j != best[i]) | (part != own[i])
        yield i[other], j[other], part[other]


def _count_up(*keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


def visit(routed: DataFrame, built: Shards, k: int) -> DataFrame:
    """(query_id, sign, vec_id, n, about, score): the best k of each shard for each query that visits it.

    Queries come in blocks of about BLOCK_ROWS a shard, and a tree meets each
    block by a join: no task holds more than one tree and one block.
    """
    width, exact, kind = built.width, built.exact, built.kind
    blocks = routed.groupBy("region", "part", "block").agg(F.collect_list(F.struct("vec_id", "sign", "x", "kth")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = None, None
        for b in batches:
            for region, part, asked, packed in zip(b["region"], b["part"], b["asked"], b["tree"], strict=True):
                if held != (region, part):
                    held, tree = (region, part), pickle.loads(packed)
                    tree.ready(exact)
                q = np.frombuffer(b"".join(r["x"] for r in asked), kind).reshape(len(asked), width)
                q = q.astype(np.float64) if exact else _integers(q)
                bound, out = tree.bounds(q), []
                for i, r in enumerate(asked):
                    kth = r["kth"] if exact else -np.inf
                    for score, _, at in tree.search(q[i], r["vec_id"], bound[i], kth, k):
                        out.append((r["vec_id"], r["sign"], tree.ids[at], tree.times[at], float(score), max(-(1 << 63), min((1 << 63) - 1, int(score)))))
                yield pd.DataFrame(out, columns=["query_id", "sign", "vec_id", "n", "about", "score"])

    return (
        blocks.join(built.trees, ["region", "part"])
        .select("region", "part", "asked", "tree")
        .mapInPandas(run, "query_id long, sign long, vec_id long, n long, about double, score long")
    )


def _integers(x: np.ndarray) -> np.ndarray:
    """Python integers of the values, for sums beyond doubles."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other vectors.

    Queries are the rows whose id is divisible by ``every``. First each query
    searches a shard of the region whose box can hold its best vectors; its
    k-th score there goes along, and only shards whose region's box reaches it
    are visited next, where it prunes the tree from the start. The best k of
    each shard meet by query; ties go to the smaller id. Where boxes tell
    little, as in many dimensions without clusters, a query visits most shards:
    the search stays exact, and its cost is that of comparing all.

    Vectors null, or with null or non-finite components, take no part, nor do
    null ids; shorter vectors count as padded with zeros. Rows that repeat a
    query's id are no candidates of it; if their vectors differ, each asks for
    itself, under the same query_id; equal ones ask once. Scores are exact: doubles while sums
    stay below 2^53, Python integers beyond, cut to the range of long. Returns
    query_id, rank, vec_id, score; fewer than k where there aren't more, none
    for an empty table. Other columns of ``vectors`` play no part.
    """
    spark = vectors.sparkSession
    built = shards(vectors, id_col, vector_col)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = built.rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("x").alias("sign"), "x")
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    seeds = visit(routes(queries.withColumn("kth", F.lit(float("-inf"))), built, blocks, True), built, k)
    found = seeds
    if built.count > 1:
        seeds = kept(seeds, "seeds")
        found = seeds.unionByName(visit(routes(bounded(queries, seeds, k), built, blocks, False), built, k))
    by = Window.partitionBy("query_id", "sign").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
        .select("query_id", F.row_number().over(by).alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= k)
    )


def bounded(queries: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Queries with the k-th best score that their first shard gave, if it gave as many."""
    kth = seeds.groupBy(F.col("query_id").alias("vec_id"), "sign").agg(F.count(F.lit(1)).alias("c"), F.min("about").alias("least"))
    least = F.when(F.col("c") >= k, F.col("least")).otherwise(F.lit(float("-inf")))
    return queries.join(kth, ["vec_id", "sign"], "left").select("vec_id", "sign", "x", F.coalesce(least, F.lit(float("-inf"))).alias("kth"))


ORACLE_SQL = r"""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""
