"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, kept, ready, sampled

THRESHOLD = 0.9  # cosine from which two vectors link
FIT_ROWS = (8192, 65536)  # vectors that codebooks are fitted on: 16 a codeword, but at least and at most so many
ASK_ROWS = (512, 4096)  # balls, a vector of each, whose true links tell how many cells a traversal needs; the second if the first give few
ASK_LINKED = 64  # of them that have links, below which they are few
RECALL = 0.99  # of those links, a vote a ball
CELLS = (4, 256)  # cells that a traversal visits, at least, and up to which their number is measured to the cell
PER_CELL = 128  # vectors of a cell, about, that the grid is laid out for: comparing them costs less than more visits do
CODES = (2, 4096)  # codewords of a half, at least and at most
BLOCK = 2048  # vectors of a cell that one task holds
PAIR_BYTES = 1 << 19  # of a ball's members that are compared with another's at a time
WIDE = math.acos(THRESHOLD)
BALL = WIDE / 2 * (1 - 1e-9)  # radius within which all members of a ball link
EDGE = 1e-9  # angles this near the threshold are left to the vectors themselves


def unit(rows: pd.Series, width: int) -> np.ndarray:
    """Rows as double vectors of length 1, padded with zeros to one width."""
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)  # so that squares don't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, fine): fine if the vector can link, that is neither null nor zero and all finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)))


@dataclass(frozen=True)
class Index:
    """A codebook for each half of the vectors; their product is the grid of cells."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    visits: int = CELLS[0]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half of each vector to its codewords."""
        cut_at = self.width // 2
        return [(h * h).sum(1)[:, None] - 2 * h @ b.T + (b * b).sum(1)[None, :] for h, b in zip((x[:, :cut_at], x[:, cut_at:]), self.books, strict=True)]

    def traverse(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells nearest to each vector, nearest first, as the multi-sequence algorithm visits them.

        With each half's codewords in order of distance, cell (i, j) can only
        come once all (i', j') before it in both orders have, so the first n
        cells lie where (i + 1) * (j + 1) <= n: these few are summed up and
        put in order. Ties go to the smaller cell.
        """
        d1, d2 = self.halves(x)
        k1, k2 = d1.shape[1], d2.shape[1]
        n = min(self.visits if visits is None else visits, k1 * k2)
        many = np.minimum(n // np.arange(1, min(n, k1) + 1), k2)
        at1 = np.repeat(np.arange(len(many)), many)
        at2 = np.arange(len(at1)) - np.repeat(np.cumsum(many) - many, many)
        out = np.zeros((len(x), n), np.int32)
        step = max(1, min(1024, (1 << 22) // max(1, len(at1))))
        for a in range(0, len(x), step):
            s = slice(a, a + step)
            o1, o2 = np.argsort(d1[s], 1, kind="stable"), np.argsort(d2[s], 1, kind="stable")
            r1, r2 = np.take_along_axis(d1[s], o1, 1), np.take_along_axis(d2[s], o2, 1)
            total = r1[:, at1] + r2[:, at2]
            first = np.argsort(total, 1, kind="stable")[:, :n]
            out[s] = np.take_along_axis(o1[:, at1] * k2 + o2[:, at2], first, 1)
        return out

    def place(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each vector, how many cells its traversal visits before the given one, or ties with."""
        d1, d2 = self.halves(x)
        out = np.zeros(len(x), np.int64)
        for i, (a, b, c) in enumerate(zip(d1, d2, cells, strict=True)):
            out[i] = np.searchsorted(np.sort(b), a[c // len(b)] + b[c % len(b)] - a + EDGE, "right").sum() - 1
        return np.maximum(out, 0)


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's codewords of a sample, started from spread-out rows of it."""
    rng = np.random.default_rng(3)
    book = x[rng.permutation(len(x))[:k]].copy()
    step = max(1, (1 << 24) // max(1, len(book)))
    for _ in range(rounds):
        near = np.concatenate([((book * book).sum(1)[None, :] - 2 * x[a : a + step] @ book.T).argmin(1) for a in range(0, len(x), step)])
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def fit(rows: DataFrame) -> Index | None:
    """An index of rows (vec_id, v) that can link: codebooks fitted on a bounded sample, those with the smallest hashes of their ids."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return None
    n, width = size["n"], size["width"] + size["width"] % 2
    codes = int(np.clip(2 ** round(math.log2(max(1.0, math.sqrt(n / PER_CELL)))), *CODES))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [_flat(x) for x in unit(b["v"], width)]})

    some = sampled(rows, int(np.clip(16 * codes, *FIT_ROWS)), "vec_id", "v").select("v").mapInPandas(pack, "x binary").collect()
    sample = _stack(r["x"] for r in some)
    return Index(width, (_codebook(sample[:, : width // 2], codes), _codebook(sample[:, width // 2 :], codes)))


def reach(balls: DataFrame, index: Index) -> int:
    """How many cells leaders must visit to find RECALL of the links that leave a ball, a vote a ball.

    Of the ASK_ROWS balls with the smallest hashes one member each is asked, so
    that a group of copies, however large, is a vote or a few; more balls are
    asked if fewer than ASK_LINKED of them have such links. Its true links to
    the members of all other balls are counted by brute force. A link is found
    if either ball's leader visits the other's home, so its place is the nearer
    one of the two. Places are exact below CELLS[1] and rounded up to a power
    of two beyond, to all cells at most: what comes out always meets RECALL of
    what was asked. If few have links even so, vectors at THRESHOLD exactly, in
    random directions from those asked, must be found as well.
    """
    for rows in ASK_ROWS:
        ask, places = _places(balls, index, rows)
        if len({asked for asked, _, _ in places}) >= ASK_LINKED:
            return needed(places)
    return max(needed(places), needed(_planted(index, ask[: ASK_ROWS[0]])))


def _asked(balls: DataFrame, index: Index, rows: int) -> list:
    """Of the balls with the smallest hashes: uid, cell, leader, and one member."""
    wide = 8 * index.width
    k = F.pmod(F.xxhash64(F.lit(11), "uid"), F.col("size"))
    one = F.substring("members", k.cast("int") * wide + 1, F.lit(wide))
    return sampled(balls.select("uid", "cell", _leader(index).alias("leader"), one.alias("one")), rows, "uid").collect()


def _places(balls: DataFrame, index: Index, rows: int) -> tuple[list, list[tuple[int, int, int]]]:
    """The asked, and (asked, visits, n) of the links that leave their balls: so many are found by so many visits."""
    ask = _asked(balls, index, rows)
    uids, homes = np.array([r["uid"] for r in ask]), np.array([r["cell"] for r in ask])
    leaders, q = _stack(r["leader"] for r in ask), _stack(r["one"] for r in ask)
    shared = balls.sparkSession.sparkContext.broadcast((index, uids, homes, leaders, q))  # ASK_ROWS vectors at most

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, uids, homes, leaders, q = shared.value
        for b in batches:
            asked, at, links = [], [], []
            for k, (uid, x) in enumerate(zip(b["uid"], b["members"], strict=True)):
                n = (q @ np.frombuffer(x).reshape(-1, q.shape[1]).T >= THRESHOLD).sum(1)
                some = np.flatnonzero((n > 0) & (uids != uid))
                asked.append(some)
                at.append(np.full(len(some), k))
                links.append(n[some])
            if sum(map(len, asked)):
                asked, at = np.concatenate(asked), np.concatenate(at)
                other = np.stack([np.frombuffer(x[: 8 * index.width]) for x in b["members"]])
                visits = _visits(index, leaders[asked], homes[asked], other[at], b["cell"].to_numpy()[at])
                found = pd.DataFrame({"asked": asked, "visits": visits, "n": np.concatenate(links)})
                yield found.groupby(["asked", "visits"], as_index=False).sum()

    links = balls.select("uid", "cell", "members").mapInPandas(meet, "asked int, visits long, n long")
    return ask, [(r["asked"], r["visits"], r["n"]) for r in links.groupBy("asked", "visits").agg(F.sum("n").alias("n")).collect()]


def _visits(index: Index, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """The visits with which one of two leaders, a at home in at_a and b in at_b, comes to the other's home."""
    at = np.minimum(index.place(a, at_b), index.place(b, at_a))
    far = np.minimum(2 ** np.ceil(np.log2(at + 1)).astype(np.int64), len(index.books[0]) * len(index.books[1]))
    return np.where(at < CELLS[1], at + 1, far)


def _planted(index: Index, ask: list) -> list[tuple[int, int, int]]:
    """As :func:`_places`, of a vector made for each one asked: its cosine is THRESHOLD, in a random direction."""
    if index.width < 2 or not ask:
        return []
    x, rng = _stack(r["one"] for r in ask), np.random.default_rng(5)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-300)
    made = THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * side
    visits = _visits(index, _stack(r["leader"] for r in ask), np.array([r["cell"] for r in ask]), made, index.traverse(made, 1)[:, 0])
    return [(i, int(v), 1) for i, v in enumerate(visits)]


def needed(places: list[tuple[int, int, int]]) -> int:
    """Of rows (asked, visits, n): n links of an asked vector that so many visits find. The visits that find RECALL, a vote an asked vector."""
    total: dict[int, int] = {}
    for asked, _, n in places:
        total[asked] = total.get(asked, 0) + n
    have, visits = 0.0, CELLS[0]
    for asked, v, n in sorted(places, key=lambda p: p[1]):
        if have >= RECALL * len(total) and v > visits:
            break
        visits = max(visits, v)
        have += n / total[asked]
    return visits


def _stack(rows: Iterable[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r) for r in rows])


def _in_blocks(balls: DataFrame, width: int) -> DataFrame:
    """(uid, node, k, ids, members): the members of balls, at most PAIR_BYTES a row, k the place of the first."""
    each = max(1, PAIR_BYTES // (8 * width))
    k = F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1, F.lit(each)))
    return balls.select("uid", "node", "members", k.alias("k")).select(
        "uid", "node", "k", F.substring("members", F.col("k") * (8 * width) + 1, F.lit(each * 8 * width)).alias("members")
    )


def _leader(index: Index) -> Column:
    """A ball's leader: the first of its members."""
    return F.substring("members", 1, 8 * index.width)


def _balls(x: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
    """Vectors in balls: leader, members (the leader first), largest angle. All members of a ball link with one another."""
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            left = np.flatnonzero(free)
            angle = np.arccos(np.clip(x[left] @ x[i], -1, 1))
            own = angle <= BALL
            own[left == i] = True
            angle[left == i] = 0.0
            free[left[own]] = False
            out.append((i, left[own], float(angle[own].max())))
    return out


def _flat(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _forest(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links ``near`` between the nodes a and b."""
    label = b.copy()
    big = np.iinfo(np.int64).max
    while True:
        la = np.where(near, label[None, :], big).min(1)
        new = np.minimum(label, np.where(near, la[:, None], big).min(0))
        if (new == label).all():
            break
        label = new
    edges = [(x, y) for x, y in zip(a.tolist(), la.tolist(), strict=True) if y != big and x != y]
    linked = near.any(0)
    return edges + [(x, y) for x, y in zip(b[linked].tolist(), label[linked].tolist(), strict=True) if x != y]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Direct links and component of every vector under cosine >= THRESHOLD, in double precision.

    1. Vectors go to their home cell of the grid; a cell's vectors, in blocks
       of about BLOCK, are gathered in balls so narrow that all members link.
       A ball stands for its members from here on: near copies, however many,
       become a few rows.
    2. Each ball's leader visits the cells nearest to it (multi-sequence
       order) and meets the balls at home there. How many is measured on the
       balls (see :func:`reach`). By the triangle inequality
       of angles two balls link in whole, or not at all; or, near the
       threshold, it is left to their members. Cells with many rows are cut
       into pairs of blocks. Whole links add their counts and give a spanning
       forest's edges only.
    3. Members of the undecided pairs of balls are compared one by one, in
       blocks of PAIR_BYTES.
    4. Counts add up, and the forest's components are found by rounds of
       aggregations and joins.

    What is compared is exact; what is missed is only what the traversal
    doesn't reach. Null, zero and non-finite vectors link with
    nothing and are components of their own, as are rows with a null id, whose
    component is null. An empty table gives no rows; other columns of ``vectors``
    play no part, whatever their names. Shorter vectors count as padded with zeros. Rows that
    repeat an id are vectors of their own that share a component. Returns
    vec_id, n_links, component_id, kept, a row per row.
    """
    spark = ready(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    good = rows.where("fine").select("vec_id", "v")
    apart = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    index = fit(good)
    if index is None:
        return _result(apart)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of CODES[1] rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell": shared.value.traverse(unit(b["v"], shared.value.width), 1)[:, 0], "vec_id": b["vec_id"], "v": b["v"]})

    placed = cut(good.mapInPandas(place, "cell int, vec_id long, v array<double>"))
    # Cells of more than one block: a row for BLOCK vectors at most, so they travel to the vectors and no cell meets in one task.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # Read from files, rows have the same numbers each time; they part rows that repeat one another.
    numbered = placed.withColumn("row", F.monotonically_increasing_id())
    salt = F.coalesce(F.pmod(F.xxhash64("vec_id", "row"), "blocks"), F.lit(0)).cast("int")
    blocks = numbered.join(F.broadcast(sizes), "cell", "left").withColumn("salt", salt)

    def gather(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        cell, salt = key
        b = b.sort_values("vec_id", kind="stable", ignore_index=True)
        x, ids, out = unit(b["v"], shared.value.width), b["vec_id"].to_numpy(), []
        for i, own, radius in _balls(x):
            uid = (int(cell) << 40) | (int(salt) << 16) | i
            out.append((uid, int(ids[own].min()), int(cell), radius, len(own), ids[own].tolist(), _flat(x[own])))
        return pd.DataFrame(out, columns=["uid", "node", "cell", "radius", "size", "ids", "members"])

    balls = cut(
        blocks.groupBy("cell", "salt").applyInPandas(
            gather, "uid long, node long, cell int, radius double, size long, ids array<long>, members binary"
        )
    )
    visits = reach(balls, index)
    light = balls.select("uid", "node", "cell", _leader(index).alias("leader"), "radius", "size")
    wanted = spark.sparkContext.broadcast(replace(index, visits=visits))

    def travel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["visits"] = wanted.value.traverse(_stack(b["leader"])).tolist()
                yield b

    light = cut(light.mapInPandas(travel, "uid long, node long, cell int, leader binary, radius double, size long, visits array<int>"))
    at_home = light.withColumn("at", F.col("cell"))
    visitors = light.withColumn("at", F.explode("visits"))
    loads = kept(
        at_home.select("at", F.lit(1).alias("h"), F.lit(0).alias("v"))
        .unionByName(visitors.select("at", F.lit(0).alias("h"), F.lit(1).alias("v")))
        .groupBy("at")
        .agg(F.ceil(F.sum("h") / BLOCK).cast("int").alias("hb"), F.ceil(F.sum("v") / BLOCK).cast("int").alias("vb"))
        .where("hb > 0 and vb > 0"),
        "loads",
    )
    salted = F.xxhash64(F.lit(3), "uid")
    # A row a cell in which balls live: whether it is small enough to travel is Catalyst's choice.
    resident = at_home.join(loads, "at").withColumn("i", F.pmod(salted, "hb").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    visiting = visitors.join(loads, "at").withColumn("j", F.pmod(salted, "vb").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))

    def fresh(df: DataFrame, *more: str) -> DataFrame:
        """Under columns of their own: both sides come from one table."""
        return df.select(*[F.col(c).alias(c) for c in ("at", "i", "j", "uid", "node", "leader", "radius", "size", *more)])

    def meet(key: tuple, home: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, n): n > 0 adds n links to each member of ball a; 0 is an edge of nodes; -1 an undecided pair of balls."""
        out: list[tuple[int, int, int]] = []
        if len(home) and len(guest):
            at = key[0]
            h, g = _stack(home["leader"]), _stack(guest["leader"])
            cos = g @ h.T
            # Below this no two balls link; what is left is mostly small.
            may = cos >= math.cos(min(math.pi, WIDE + 2 * EDGE + home["radius"].max() + guest["radius"].max()))
            some_g, some_h = may.any(1), may.any(0)
            home, guest, cos = home[some_h], guest[some_g], cos[np.ix_(some_g, some_h)]
            hu, gu = home["uid"].to_numpy(), guest["uid"].to_numpy()
            hn, gn = home["node"].to_numpy(), guest["node"].to_numpy()
            # Where each would visit the other, the pair counts once: with the smaller one as the guest.
            cells = guest["cell"].to_numpy()
            back = np.zeros(cos.shape, bool)
            for j, v in enumerate(home["visits"]):
                back[:, j] = np.isin(cells, v)
            mine = (gu[:, None] != hu[None, :]) & (~back | (gu[:, None] < hu[None, :]))
            reach = guest["radius"].to_numpy()[:, None] + home["radius"].to_numpy()[None, :]
            angle = np.arccos(np.clip(cos, -1, 1))
            single = reach == 0
            whole = mine & np.where(single, cos >= THRESHOLD, angle + reach <= WIDE - EDGE)
            open_ = mine & ~single & ~whole & (angle - reach <= WIDE + EDGE)
            hs, gs = home["size"].to_numpy(), guest["size"].to_numpy()
            for u, n in (*zip(gu.tolist(), (whole @ hs).tolist(), strict=True), *zip(hu.tolist(), (gs @ whole).tolist(), strict=True)):
                if n:
                    out.append((u, at, n))
            if whole.any():
                out += [(a, b, 0) for a, b in _forest(gn, hn, whole)]
            out += [(int(gu[a]), int(hu[b]), -1) for a, b in zip(*np.nonzero(open_), strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "n"])

    met = cut(
        fresh(resident, "visits").groupBy("at", "i", "j").cogroup(fresh(visiting, "cell").groupBy("at", "i", "j")).applyInPandas(meet, "a long, b long, n long")
    )
    full = _in_blocks(balls, index.width)
    pairs = (
        met.where("n = -1").select("a", "b")
        .join(full.select(*[F.col(c).alias(f"{c}_a") for c in full.columns]), F.col("a") == F.col("uid_a"))
        .join(full.select(*[F.col(c).alias(f"{c}_b") for c in full.columns]), F.col("b") == F.col("uid_b"))
        .select("a", "b", "node_a", "node_b", "k_a", "k_b", "members_a", "members_b")
    )

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (uid, k, n): n > 0 links of member k of a ball; -1: an edge between the ids uid and k."""
        width = shared.value.width
        for p in batches:
            for ua, ub, na, nb, ka, kb, xa, xb in p.itertuples(index=False):
                xa, xb = np.frombuffer(xa).reshape(-1, width), np.frombuffer(xb).reshape(-1, width)
                near = xa @ xb.T >= THRESHOLD
                out = []
                for u, k, counts in ((ua, ka, near.sum(1)), (ub, kb, near.sum(0))):
                    out += [(u, k + int(i), int(counts[i])) for i in np.flatnonzero(counts)]
                if out:
                    out.append((na, nb, -1))
                    yield pd.DataFrame(out, columns=["uid", "k", "n"])

    single = cut(pairs.mapInPandas(settle, "uid long, k long, n long"))
    edges = met.where("n = 0").select("a", "b").unionByName(single.where("n = -1").select(F.col("uid").alias("a"), F.col("k").alias("b")).distinct())
    of = components(edges)
    extra = met.where("n > 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("more"))
    each = single.where("n > 0").groupBy("uid", "k").agg(F.sum("n").alias("few"))
    members = (
        balls.join(extra, "uid", "left")
        .select("uid", "node", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.posexplode("ids").alias("k", "vec_id"))
        .join(each, ["uid", "k"], "left")
        .join(of, "node", "left")
        .select("vec_id", (F.col("links") + F.coalesce("few", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    return _result(members.unionByName(apart))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
