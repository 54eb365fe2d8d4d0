"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, ready

BUCKETS = 4096  # hashed byte n-grams
TRAIN_ROWS = 4000  # labelled documents that a model is fitted on, at most
TRAIN_EACH = 1000  # of one language, at most
MARGIN = 0.1  # nats between the two nearest codewords; closer ones are ambiguous
UNKNOWN = "und"

_WORDY = re.compile(r"[^\W\d_]")  # letters, and numbers such as ½ and Ⅷ
#: Bytes as they count: ASCII letters in lower case and all bytes of other characters; all else is a gap.
_FOLD = np.array([b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def features(text: str) -> np.ndarray:
    """Root relative frequencies of hashed byte bigrams and trigrams, of length 1."""
    a = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    # Runs of gaps count as one.
    a = a[(a != 32) | np.concatenate([[True], a[:-1] != 32])] if len(a) else a
    a = np.concatenate([np.full(1, 32, np.uint32), a, np.full(2, 32, np.uint32)])
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + a[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 12)
    h = np.concatenate([(two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D), (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)])
    x = np.sqrt(np.bincount((h >> shift).astype(np.int64), minlength=BUCKETS)).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages.

    Up to 6: the exhaustive code, every split of the languages in two. Beyond:
    of 40 seeded random codes of 12 log2(n) bits, that with the largest least
    distance.
    """
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n)], np.float32)
    bits, best, found = int(np.ceil(12 * np.log2(n))), -1, None
    rng = np.random.default_rng(seed)
    for _ in range(40):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(n, dtype=int)
        if apart.min() > best and (np.abs(code.sum(0)) < n).all():
            best, found = apart.min(), code
    return found


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets + 1 x bits
    trust: np.ndarray  # of each bit's classifier

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of features: index of the language, score from 0 to 1, whether two codewords are about as near.

        Loss-weighted decoding: a codeword's loss is the logistic loss of each
        bit's margin against it, times the trust in that bit's classifier.
        """
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.stack([np.logaddexp(0, -f * c) @ self.trust for c in self.code], 1)
        near = np.sort(loss, 1)
        p = np.exp(near[:, :1] - loss)
        ambiguous = near[:, 1] - near[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return loss.argmin(1), 1 / p.sum(1), ambiguous


def fit(x: np.ndarray, langs: list[str], steps: int = 200) -> Model:
    """All bits' logistic classifiers at once, by Adam on the whole sample."""
    names = sorted(set(langs))
    code = codewords(len(names))
    y = code[[names.index(v) for v in langs]] if names else np.zeros((0, code.shape[1]), np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1) if len(x) else np.zeros((0, BUCKETS + 1), np.float32)
    w = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    if len(x):
        # A language counts as much as another, however many documents it has.
        share = np.array([langs.count(n) for n in names], np.float32)
        each = (1 / share[[names.index(a) for a in langs]] / len(names))[:, None].astype(np.float32)
        for t in range(1, steps + 1):
            g = x.T @ (-y / (1 + np.exp(y * (x @ w))) * each) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = ((x @ w) * y > 0).mean(0) if len(x) else np.ones(code.shape[1])
    trust = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
    return Model(names, code, w, trust / trust.sum() * len(trust))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the documents whose id's crc32 modulo 5 is not 0 and whose language is known.

    It is fitted on a bounded sample, by hash of the id: TRAIN_EACH documents a
    language and TRAIN_ROWS in all, at most, of the TRAIN_ROWS most frequent
    languages. Where these are more than TRAIN_ROWS, every language has its
    first rows before any has more. Of different texts under one id and language
    that with the smallest hash is taken, so runs agree. Their features, not their texts, come to
    the driver.
    """
    from pyspark.sql import Window

    ready(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col, 5) != 0))
    by = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), "id"), "id")
    ranked = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang")).distinct()
    # Of a frequent language a hash lets about 2 * TRAIN_EACH rows through, so none is gathered.
    counts = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_ROWS)
    drawn = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) * F.col("n").cast("double") < F.lit(2.0 * TRAIN_EACH * (1 << 30))
    some = ranked.join(F.broadcast(counts), "lang").where(drawn)  # TRAIN_ROWS languages at most
    few = some.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TRAIN_EACH)
    chosen = [(r["id"], r["lang"]) for r in few.orderBy("rank", F.xxhash64(F.lit(7), "id"), "id", "lang").limit(TRAIN_ROWS).select("id", "lang").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "sign": b["sign"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    ids = docs.sparkSession.createDataFrame(chosen, "chosen long, of string")
    rows = (
        known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
        .withColumn("sign", F.xxhash64("text"))
        .join(F.broadcast(ids), (F.col("id") == F.col("chosen")) & (F.col("lang") == F.col("of")), "left_semi")  # TRAIN_ROWS ids at most
        .mapInPandas(run, "id long, lang string, sign long, x binary")
        .groupBy("id", "lang")
        .agg(F.min_by("x", "sign").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r["id"], r["lang"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), BUCKETS)
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row's whole text; keep: with the columns of ``docs`` instead of the id.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if the model knows no language. Ties of codewords go to the
    first language in code point order and are ambiguous. Rows stay one for
    one: repeated ones and those with a null id are judged like any other; an
    empty table gives none. Texts are read whole; other columns play no part.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)  # a few thousand weights a bit

    def judge(texts: list) -> list[tuple]:
        model = shared.value
        out: list[tuple] = [(UNKNOWN, 0.0, False)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
        if some:
            at, score, vague = model.predict(np.array([features(texts[i]) for i in some]))
            for i, a, s, v in zip(some, at, score, vague, strict=True):
                out[i] = (model.langs[a], float(s), bool(v))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(judge(b["text"].tolist()), columns=["lang_pred", "score", "ambiguous"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    said = "lang_pred string, score double, ambiguous boolean"
    if not keep:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id long, {said}")
    # One struct column, so that no column of the input clashes with what is said.
    @F.pandas_udf("struct<lang_pred string, score double, ambiguous boolean>")
    def say(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge(text.tolist()), columns=["lang_pred", "score", "ambiguous"])

    return docs.select(F.struct(*docs.columns).alias("row"), say(F.col(text_col)).alias("said"))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), by a model trained on the rows that aren't held out."""
    out = identify(docs, train(docs))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without documents of no known language: und, or between two codewords."""
    said = identify(docs, model, keep=True)
    return said.where((F.col("said.lang_pred") != UNKNOWN) & ~F.col("said.ambiguous")).select("row.*")
