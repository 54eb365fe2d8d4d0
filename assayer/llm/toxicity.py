"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of, ready, sampled

POSITIVE_ROWS = 3000  # confirmed toxic documents that a model is fitted on, at most
UNLABELLED_ROWS = 6000  # other documents, at most
MARKS = 2048  # features, at most
PREFIXES = (4, 5, 6, 7)  # characters of the beginnings of words that are features, too
LEAST_ODDS = 1.5  # how much more frequent a feature is in toxic documents than in all
LEAST_SHARE = 0.01  # of the toxic documents that have it, so that a few copies' words are none
LEAST_CHI2 = 3.0  # and how sure that is
RATE = 0.05  # of the steps: weights that are correlated need long ones
LIKE = 0.8  # Jaccard similarity of the words of near copies
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def marks(text: str | None) -> set[str]:
    """Distinct runs of letters, in lower case, and their beginnings, marked by a star, by two if two words or more begin so.

    A word that repeats counts each time: a beginning that chance puts into a
    document stands there once, one that says something often more than that.
    """
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    out = set(words)
    begun: Counter[str] = Counter()
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) >= k:
                begun[w[:k]] += n
    for stem, n in begun.items():
        out.add(stem + "*")
        if n > 1:
            out.add(stem + "**")
    return out


def sign(text: str | None) -> int:
    """A value that near copies mostly share, and other documents rarely: four min-hashes of the words, all in one."""
    words = set(_WORD.findall(text.lower())) if text else set()
    if not words:
        return 0
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)[:, None] * _TURNS
    return zlib.crc32((h ^ (h >> np.uint64(32))).min(0).tobytes())


def once(rows: DataFrame) -> DataFrame:
    """Of documents (id, bad, words, sign), those that are no near copies: copies tell no more than one of them.

    Documents of one sign go only if their words, beginnings aside, are in fact
    like those of the first: a shared sign alone drops none.
    """
    rows = rows.distinct()
    first = rows.groupBy("bad", "sign").agg(F.min(F.struct("id", "words")).alias("one"))
    a, b = (F.filter(c, lambda w: ~w.endswith("*")) for c in ("words", "one.words"))
    other = F.size(F.array_intersect(a, b)) < LIKE * F.size(F.array_union(a, b))
    return rows.join(first, ["bad", "sign"]).where(other | (F.struct("id", "words") == F.col("one"))).select("id", "bad", "words")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & marks(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(found)), -30, 30))))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 1e-5) -> np.ndarray:
    """Weights, the last one the bias, of a linear model by Kiryo et al.'s non-negative risk.

    With positive share ``prior`` and the sigmoid loss the risk is
    prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)). Where the second term
    would be negative, the step goes against its gradient instead, which keeps
    a flexible model from fitting the unlabelled rows as negative. Weights
    start at the features' log odds, where the loss has a slope.
    """
    p = np.concatenate([pos, np.ones((len(pos), 1), pos.dtype)], 1)
    u = np.concatenate([unl, np.ones((len(unl), 1), unl.dtype)], 1)
    odds = np.log((pos.sum(0) + 0.5) / (len(pos) + 1)) - np.log((unl.sum(0) + 0.5) / (len(unl) + 1))
    w = np.append(odds, np.log(prior / (1 - prior)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        dp, du = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / max(len(u), 1)
        negative = su.mean() - prior * sp.mean() if len(u) else 0.0
        g = -prior * dp + (du - prior * dp) if negative >= 0 else -(du - prior * dp)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the rows whose id's crc32 modulo 3 is not 1.

    Positives are documents that ``labels`` marks toxic. The unlabelled side is
    drawn from all documents, those among them, as the risk takes a share of
    positives out of it: the class prior, which is the toxic share of the
    labels of those rows. Both sides are bounded samples by hash of the id
    (POSITIVE_ROWS, UNLABELLED_ROWS). Features are words and beginnings of
    words; Spark counts them and picks up to MARKS that are commoner in toxic
    documents, and only these and which sampled documents have them come
    to the driver. Of rows that share an id each counts. Without toxic rows or
    telling features every score is the prior, below the threshold.
    """
    spark = ready(docs.sparkSession)
    told = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id", 3) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    n = told.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("bad")).first()
    prior = min(max(n["bad"] / n["all"] if n["all"] else 0.0, 1e-3), 1 - 1e-3)
    empty = Model({}, float(np.log(prior / (1 - prior))))
    if not n["bad"]:
        return empty
    ids = docs.where(F.col(id_col).isNotNull() & (fold_of(id_col, 3) != 1)).select(F.col(id_col).cast("long").alias("id")).distinct()
    marked = ids.join(told, "id", "left").select("id", (F.coalesce("toxic", F.lit(0)) == 1).alias("bad"))
    bad = [r["id"] for r in sampled(marked.where("bad").select("id"), POSITIVE_ROWS, "id").collect()]
    rest = [r["id"] for r in sampled(marked.select("id"), UNLABELLED_ROWS, "id").collect()]
    if not bad:
        return empty
    chosen = spark.createDataFrame([(i, True) for i in bad] + [(i, False) for i in rest], "chosen long, bad boolean")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {"id": b["id"], "bad": b["bad"], "words": [sorted(marks(t)) for t in b["text"]], "sign": [sign(t) for t in b["text"]]}
            )

    sample = cut(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("chosen"))  # POSITIVE_ROWS + UNLABELLED_ROWS ids at most
        .select("id", "bad", "text")
        .mapInPandas(sets, "id long, bad boolean, words array<string>, sign long")
    )
    # Copies count once where words are weighed up, so that no copied text makes its words telling. The risk takes both sides as they are.
    unlike = cut(once(sample))
    size = {r["bad"]: r["n"] for r in unlike.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    np_, nu = size.get(True, 0), size.get(False, 0)
    a, b = F.col("a"), F.col("b")  # documents with the word
    total = np_ + nu
    expected = (a + b) * np_ / total
    chi2 = (a - expected) ** 2 / (expected * (1 - (a + b) / (total + 1)))
    counted = (
        unlike.select("bad", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum(F.col("bad").cast("long")).alias("a"), F.sum((~F.col("bad")).cast("long")).alias("b"))
        .where((F.col("a") >= max(3, math.ceil(LEAST_SHARE * np_))) & ((a + 0.5) / (np_ + 1) > LEAST_ODDS * (b + 0.5) / (nu + 1)))
        .withColumn("chi2", chi2)
        .where(F.col("chi2") >= LEAST_CHI2)
    )
    best = counted.orderBy(F.desc("chi2"), F.desc(F.length("word")), "word").limit(MARKS).collect()
    vocabulary = sorted(r["word"] for r in best)
    if not vocabulary:
        return empty
    place = {w: i for i, w in enumerate(vocabulary)}
    kept = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])) if len(vocabulary) <= 64 else None
    if kept is None:
        known = spark.sparkContext.broadcast(place)

        @F.pandas_udf("array<string>")
        def pick(x: pd.Series) -> pd.Series:
            return pd.Series([[w for w in ws if w in known.value] for ws in x])

        kept = pick("words")
    rows = sample.select("id", "bad", kept.alias("words")).collect()
    rows.sort(key=lambda r: (r["id"], r["bad"], sorted(r["words"])))
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[w] for w in r["words"]]] = 1
    y = np.array([r["bad"] for r in rows], bool)
    w = fit(x[y], x[~y], prior, rate=RATE, decay=0.0)
    return Model({v: float(c) for v, c in zip(vocabulary, w, strict=False)}, float(w[-1]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the model's score, 0 to 1, of every row's whole text; null texts count as empty.

    Rows stay one for one, repeated ones and those with a null id too; an empty
    table gives none. Other columns play no part.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)  # MARKS weights at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [shared.value.score(t) for t in b["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, score double"
    )


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), by a model trained on the rows that aren't held out.

    A row per row, as :func:`scores` has it; a null id isn't held out. A score
    of exactly THRESHOLD counts as toxic.
    """
    out = scores(docs, train(docs, labels))
    return out.select(
        "doc_id",
        (fold_of("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
