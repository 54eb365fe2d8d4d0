"""Classification metrics and score statistics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import binary_label, strip
from .order import medians


def confusion(label: str = "label", answer: str = "answer") -> dict[str, Column]:
    """Aggregates tp, fn, fp, tn with fake as the positive class.

    Rows with a blank label count nowhere; an answer that is neither real nor
    fake is wrong. The answer counts stripped and without case.
    """
    gold = F.when(strip(label) != "", binary_label(label))
    said = F.lower(strip(answer))
    return {
        "tp": F.count_if((gold == "fake") & (said == "fake")),
        "fn": F.count_if((gold == "fake") & (said != "fake")),
        "fp": F.count_if((gold == "real") & (said != "real")),
        "tn": F.count_if((gold == "real") & (said == "real")),
    }


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _rates(counts: DataFrame, keep: list[Column]) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    recall = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    precision, hit = share(tp, tp + fp), share(tp, tp + fn)
    both = (recall + specificity) / F.lit(2.0)
    return counts.select(
        *keep,
        (tp + fn + fp + tn).alias("total"),
        F.coalesce(both, recall, specificity, F.lit(0.0)).alias("balanced_accuracy"),
        hit.alias("fake_recall"),
        share(2 * precision * hit, precision + hit).alias("fake_f1"),
    )


def metrics(rows: DataFrame, label: str = "label", answer: str = "answer") -> DataFrame:
    """One row of metrics over all labelled rows; zeros without any.

    Balanced accuracy is the mean over the classes that occur.
    """
    return _rates(rows.agg(*[c.alias(n) for n, c in confusion(label, answer).items()]), [])


def grouped(rows: DataFrame, field: str, label: str = "label", answer: str = "answer") -> DataFrame:
    """Metrics by the stripped values of a field; blank ones go, groups without labelled rows stay; in code point order."""
    named = rows.withColumn("__name", strip(field)).where("__name <> ''")
    counts = named.groupBy("__name").agg(*[c.alias(n) for n, c in confusion(label, answer).items()])
    return _rates(counts, [F.col("__name").alias("name")]).orderBy("name")


def report(rows: DataFrame, fields: tuple[str, ...] = ("source", "dataset"), label: str = "label", answer: str = "answer") -> DataFrame:
    """Metrics overall and by each field: grp, name and the metrics, in that order, names in code point order.

    Rows are aggregated once, to counts for each combination of the fields'
    values; the small table of counts then serves overall and every field.
    """
    names = [f"__{f}" for f in fields]
    base = (
        rows.select(*[strip(f).alias(n) for f, n in zip(fields, names, strict=True)], label, answer)
        .groupBy(*names)
        .agg(*[c.alias(n) for n, c in confusion(label, answer).items()])
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fn", "fp", "tn")]
    out = _rates(base.agg(*sums), [F.lit("overall").alias("grp"), F.lit("").alias("name")])
    for f, n in zip(fields, names, strict=True):
        counts = base.where(F.col(n) != "").groupBy(n).agg(*sums)
        out = out.unionByName(_rates(counts, [F.lit(f"by_{f}").alias("grp"), F.col(n).alias("name")]))
    place = F.array_position(F.array(F.lit("overall"), *[F.lit(f"by_{f}") for f in fields]), F.col("grp"))
    return out.orderBy(place, "name")


def score_summary(rows: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Statistics of scores by model: count, errors (null scores), mean, median, population deviation, extremes.

    Without scores the statistics are null; the deviation of one score is 0.
    Medians are exact and come from ranges of the distinct scores
    (:func:`.order.medians`); all else is one aggregation. A null model is one of its own.
    """
    s = F.col(score).cast("double")
    scored = rows.select(F.col(model).alias("model"), s.alias("score"))
    sums = scored.groupBy("model").agg(
        F.count("score").alias("count"),
        F.count_if(F.col("score").isNull()).alias("errors"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("stdev"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    middle = medians(scored, "model", "score").select(F.col("model").alias("__model"), "median")
    out = sums.join(middle, F.col("model").eqNullSafe(F.col("__model")), "left")
    return out.select("model", "count", "errors", "mean", "median", "stdev", "min", "max")


def valid_count(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("valid"), F.count(F.lit(1)).alias("total"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def milestones(rows: DataFrame, every: int) -> DataFrame:
    """(done, total) where a counter of finished rows would report: at each ``every``-th position, and at the last one."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    done = (F.col("pos") + 1).alias("done")
    return rows.select(done).join(F.broadcast(total)).where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
