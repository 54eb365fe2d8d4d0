"""Near-duplicates by 64-bit SimHash, linked through anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, kept, ready

SEED = 42
BITS = 3  # fingerprints link at this many differing bits or fewer
BLOCK = 2048  # fingerprints of one anchor that are compared at a time
COPIES = 100_000  # rows of one fingerprint that meet its component in one part, about


def fingerprint(text: str | None) -> int:
    """SimHash over 3-word shingles: a bit is 1 if set in over half the XXH64 values. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 3:
        ends, starts = [len(joined)], [0]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[:-2] + 1).tolist()]
        ends = [*gaps[2:].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sign): the fingerprint of every row's whole text as a signed long, and a hash of the text itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp, "sign": b["sign"]})

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sign")).mapInPandas(
        run, "doc_id long, fp long, sign long"
    )


def _anchors(fp: Column) -> Column:
    """Anchors of a fingerprint: structs (anchor, home).

    Each half of 32 bits has its own anchors: the codewords of the perfect
    [31, 26] Hamming code on 31 bits (covering radius 1) with the last bit
    as it is, 2^27 of them. Of two fingerprints with 3 differing bits or
    fewer, one half differs in one bit at most. One of them is compared at
    home, at its half's nearest anchor; the other goes to every anchor within
    covering radius plus threshold, 1 + 1, so it meets it there.
    """
    found = []
    for half in (0, 1):
        h = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        raw = h.bitwiseAND(F.lit(1 << 31))
        low = h.bitwiseAND(F.lit((1 << 31) - 1))
        s = F.lit(0)
        for j in range(5):
            mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
            s = s.bitwiseOR(F.shiftleft(F.bit_count(low.bitwiseAND(F.lit(mask))) % 2, j))
        found.append(F.struct(F.lit(half).alias("half"), low.alias("low"), raw.alias("raw"), s.cast("int").alias("s")))
    return F.array(*found)


def anchor_rows(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home): a row for each anchor that a fingerprint is replicated to."""
    halves = fps.select("fp", F.explode(_anchors(F.col("fp"))).alias("x")).select("fp", "x.*")
    near = F.expr("if(s = 0, low, low ^ shiftleft(1L, s - 1))")
    pairs = F.expr(
        "transform(filter(sequence(1, 31), i -> i < (i ^ s) and i <> s),"
        " i -> struct((low ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) | raw as code, false as home))"
    )
    tag = F.col("half").cast("long") * F.lit(1 << 32)
    at = halves.withColumn("near", near).select(
        "fp",
        tag.alias("tag"),
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.expr("near | raw").alias("code"), F.lit(True).alias("home")),
                    F.struct(F.expr("near | (raw ^ 2147483648L)").alias("code"), F.lit(False).alias("home")),
                ),
                pairs,
            )
        ).alias("a"),
    )
    return at.select((F.col("tag") + F.col("a.code")).alias("anchor"), "fp", F.col("a.home").alias("home"))


def _forest(home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between home fingerprints and all of one anchor."""
    n = len(fp)
    who = np.flatnonzero(home)
    near = np.bitwise_count(fp[who][:, None] ^ fp[None, :]) <= BITS
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(1)  # of each home
        new = np.minimum(label, np.where(near, least[:, None], n).min(0))
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(n))
    return fp[away], fp[label[away]]


def whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Rows of sorted batches anew, cut only between units (the first three columns)."""
    held = None
    for pdf in batches:
        x = pdf[["anchor", "i", "j", "fp", "home"]].to_numpy(np.int64)
        x = x if held is None else np.concatenate([held, x])
        change = np.flatnonzero((x[:, :3] != x[-1:, :3]).any(1))
        at = int(change[-1]) + 1 if len(change) else 0
        if at:
            yield x[:at]
        held = x[at:]
    if held is not None and len(held):
        yield held


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever links at BITS bits or fewer.

    Fingerprints are spread before they are replicated. Anchors with one
    fingerprint, or no home, are dropped after a count that combines on the
    map side. Anchors with over BLOCK fingerprints are cut
    into blocks by a hash of the fingerprint, and each pair of blocks is a
    unit of its own, so no task holds more than two blocks of an anchor. Each
    unit gives a spanning forest of its links, never all pairs. Catalyst takes
    the replicas for as few bytes as the fingerprints they come from, so the
    join with the counts is told to sort and merge: nothing of it is broadcast.
    """
    # A number of partitions, since a small table would be merged into a few before it grows 35-fold.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = anchor_rows(spread)
    busy = (
        rows.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home"))
        .where("n > 1 and any_home")
        .select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    units = (
        rows.join(busy.hint("merge"), "anchor")
        .withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "home")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_units(batches):
            edges = []
            for part in np.split(x, np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(1)) + 1):
                if len(part) > 1 and part[:, 4].any():
                    edges.append(np.stack(_forest(part[:, 4] > 0, part[:, 3].copy().view(np.uint64)), 1))
            if edges:
                e = np.concatenate(edges).view(np.int64)
                yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    return (
        units.repartition("anchor", "i", "j")
        .sortWithinPartitions("anchor", "i", "j")
        .mapInPandas(run, "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of every document under fingerprints that differ in BITS bits or fewer.

    Returns a row per row of ``docs``: doc_id, fingerprint (16 lowercase hex
    digits), component_id (smallest doc_id reachable, itself included).
    Exact copies of a fingerprint meet in one aggregation with map-side
    combining, so only distinct fingerprints are compared, and get their
    component in parts of about COPIES rows. A text is hashed by one task in
    memory of some 40 times its size; an empty table gives no rows; other
    columns play no part, whatever their names. Null and empty
    texts have fingerprint 0 and link like any other. Rows with a null id get
    the smallest id of what they link with, if any. Repeated rows stay.
    """
    ready(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    first = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("parts")), "prints")
    roots = _rooted(first)
    ids = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = roots.join(ids, "root").select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Fingerprints of over COPIES rows are dealt into parts: a row for COPIES rows at most.
    many = F.broadcast(first.where("parts > 1").select("fp", "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), "parts"), F.lit(0)).cast("int")
    dealt = prints.join(many, "fp", "left").select("doc_id", "fp", part.alias("part"))
    return dealt.join(by_print, ["fp", "part"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _rooted(prints: DataFrame) -> DataFrame:
    """``prints``, a row a fingerprint, with the root of its component: the smallest fingerprint."""
    of = components(links(prints.select("fp")))
    return prints.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id.

    A document is an id with a text. Where one id stands on different texts,
    each is in the group of its own text, and of those in one group that with
    the smallest hash of its text stays. Rows that repeat both are one
    document: of them one stays, by hash of its columns, so runs agree. Rows
    with a null id stay, as nothing tells which document they are.
    """
    ready(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sign"))).alias("least")
    first = _rooted(kept(prints.groupBy("fp").agg(least), "prints")).groupBy("root").agg(F.min("least").alias("least"))
    wanted = first.where("least is not null").select("least.doc_id", "least.sign")
    row = F.struct(*[F.col(c) for c in docs.columns])
    named = docs.where(F.col(id_col).isNotNull()).select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("sign"))
    by = F.xxhash64(F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col])))  # their texts are equal
    once = named.join(wanted, ["doc_id", "sign"], "left_semi").groupBy("doc_id", "sign").agg(F.min_by("row", by).alias("row"))
    return once.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
