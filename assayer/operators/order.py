"""Places in an order over a whole table, without gathering it anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

_LOW = (1 << 33) - 1  # monotonically_increasing_id counts a partition's rows in its lower 33 bits


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows written in ranges of the order, with ``__part``, the range's number, and ``__within``, the place in it.

    Ranges follow a sample of the order's values, so each is about as large as
    the others as long as the values tell rows apart; they are written once,
    so that a task that runs again finds the same ones.
    """
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    at = written(at, "ranged")
    return at.withColumns({"__part": F.shiftright("__at", 33), "__within": F.col("__at").bitwiseAND(F.lit(_LOW))}).drop("__at")


def cells(at: DataFrame, group: tuple[str, ...], weight: Column | None = None) -> DataFrame:
    """A row for each range and group in it: ``n`` its rows, or their weight, ``before`` what the group has in earlier ranges, ``begins`` its first place."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sums = at.groupBy("__part", *group).agg(n.cast("long").alias("n"), F.min("__within").alias("begins"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def ranks(rows: DataFrame, order: list[str | Column], group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rows with their place, from 0 and without gaps, in the order within their group.

    A place is that within a range, plus how many rows of the group earlier
    ranges hold, so a group of any size is shared out over tasks. ``order``
    should tell rows apart (add an id): ties take places in any order, and
    equal values are never split over ranges. Null groups are one group.
    """
    at = ranged(rows, *group, *order).alias("r")
    of = cells(at, group).drop("n").alias("c")
    same = reduce(Column.__and__, [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group], F.col("r.__part") == F.col("c.__part"))
    place = F.col("c.before") + F.col("r.__within") - F.col("c.begins")
    return at.join(of, same).select(*[F.col(f"r.`{c}`").alias(c) for c in rows.columns], place.alias(name))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the exact median of the filled values of each group, as double; groups without any give no row.

    Values are counted first, which combines on the map side. Distinct values
    lie in ranges; running counts over the ranges tell which of them holds the
    middle, and only those ranges' values are summed up one by one.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    at = ranged(counts, "g", "v")
    of = cells(at, ("g",), F.col("c"))
    totals = of.groupBy("g").agg(F.sum("n").alias("total"))
    # The two middle places, counted from 0; one place twice if the total is odd.
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = of.alias("c").join(totals.alias("t"), F.col("c.g").eqNullSafe(F.col("t.g"))).where((F.col("before") <= high) & (F.col("before") + F.col("n") > low))
    middle = middle.select("c.__part", "c.g", "before", low.alias("low"), high.alias("high")).alias("m")
    run = Window.partitionBy("a.__part", "a.g").orderBy("a.v")
    upto = F.col("m.before") + F.sum("a.c").over(run)
    near = at.alias("a").join(middle, (F.col("a.__part") == F.col("m.__part")) & F.col("a.g").eqNullSafe(F.col("m.g"))).select("a.g", "a.v", "a.c", "m.low", "m.high", upto.alias("upto"))
    holds = lambda place: (F.col("upto") > F.col(place)) & (F.col("upto") - F.col("c") <= F.col(place))
    return near.groupBy(F.col("g").alias(group)).agg(((F.max(F.when(holds("low"), F.col("v"))) + F.max(F.when(holds("high"), F.col("v")))) / 2).alias("median"))
