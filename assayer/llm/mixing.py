"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hexadecimal digits of the seeded order: 4096 slices of a source


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """Capped water-filling over sources.

    ``sizes`` has one row per source: source, source_size. Sources in code
    point order, null last, weigh ``weights`` in turn and share ``share`` times
    the size of all. A source never gets more than ``epochs`` times its size;
    what it can't take is dealt anew by weight among the others until none is
    above. The fixed point has a closed form: sources sorted by size a weight
    fill up in that order, so with the first k full the others get
    weight * (budget - full) / (their weights), for the smallest feasible k.
    Adds target. Sources are few, so the windows here are over a handful of
    rows.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(rest)
    leveled = ranked.select("*", level.alias("level"), (F.col("cap") / F.col("weight")).alias("ratio"))
    # The level of the first source that isn't filled holds for all after it.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("less")))).over(every)
    return leveled.select("source", "source_size", "weight", "cap", (-first["less"]).alias("water")).select(
        "source",
        "source_size",
        F.when(F.col("water").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 11,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document a mix takes.

    Every document of a source is taken floor(target / size) times whole; what
    is left of the target is taken by one more repetition of documents in
    seeded order (md5 of seed and id), whole ones and, at the very end, a
    fraction of one. Taken words of a source so come to its target, rounded.

    The seeded order is cut into 4096 slices a source. Slice totals are
    combined on the map side and summed up in order (a window of 4096 rows a
    source), and within a slice documents are summed up in order, so no source
    is handled by one task however large.

    Nulls: a null text has size 0, a null source is a source of its own, a
    null id orders as the empty text. Sources without words have target 0.
    Repeated rows are documents of their own. An empty table gives no rows.
    Returns doc_id, size, source_size, target, taken; other columns of
    ``docs`` play no part, whatever their names, but the columns named in
    ``carry`` come along as the struct row.
    """
    along = [F.struct(*carry).alias("row")] if carry else []
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("ord"),
        *along,
    ).withColumn("slice", F.substring("ord", 1, BUCKET_DIGITS))
    if not carry:
        base = kept(base, "sizes")  # words are counted once
    slices = base.select("source", "slice", "size").groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    goal = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, epochs)
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset"))
        .alias("s")
        .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select("s.source", "s.slice", "s.offset", "g.source_size", "g.target")
    )
    within = Window.partitionBy("b.source", "b.slice").orderBy("b.ord", F.col("b.doc_id").asc_nulls_last(), "b.size")
    taken = base.alias("b").join(
        plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.slice") == F.col("p.slice"))
    )
    whole = F.when(F.col("p.source_size") > 0, F.floor(F.col("p.target") / F.col("p.source_size"))).otherwise(F.lit(0))
    placed = taken.select(
        F.col("b.doc_id").alias("doc_id"),
        F.col("b.size").alias("size"),
        F.col("p.source_size").alias("source_size"),
        F.col("p.target").alias("target"),
        whole.cast("long").alias("whole"),
        (
            F.col("p.offset")
            + F.coalesce(F.sum("b.size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("ahead"),
        *[F.col("b.row").alias("row") for _ in along],
    )
    need = F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("whole") * F.col("source_size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), need - F.col("ahead")))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).alias("taken"),
        *[F.col("row") for _ in along],
    )


def repeat(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as :func:`mix` takes it, with the columns of ``docs``.

    A repetition that takes only a fraction of a document (one a source at
    most) carries that many of its words, joined by one space; its n_chars, if
    there is such a column, is counted anew. Documents of which no word is
    taken go, and so do documents without words. Texts are taken whole, however
    long; a row of one is one row, repeated at most ``epochs`` times.
    """
    rows = mix(docs, text_col=text_col, carry=tuple(docs.columns), **options).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = rows.select("row", F.explode(copies).alias("words"))
    text = F.when(F.col("words") == 0, F.col("row")[text_col]).otherwise(
        F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0)), 1, F.greatest("words", F.lit(1))))
    )
    fields = {c: F.col("row")[c] for c in docs.columns}
    fields[text_col] = text
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("words") == 0, fields["n_chars"]).otherwise(
            F.length(text).cast(docs.schema["n_chars"].dataType)
        )
    return out.select(*[x.alias(c) for c, x in fields.items()])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2 AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT level AS water FROM l WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN water IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * water) END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target + 0.5::DOUBLE)::BIGINT - whole * source_size - ahead)))::BIGINT AS taken
FROM p
"""
