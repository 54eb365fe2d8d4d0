"""Removal of repeated passages: winnowed anchors join documents, matches are extended both ways, maximal repeats stay."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .windows import Words, groups, winnow

LENGTH = 20  # words of a window: the shortest repeat that counts
SEED_WORDS = 6  # words of an anchor
STRIDE = 1024  # words of a diagonal that make up one match, at most
HOT = 50_000  # places of one anchor from which its first one is broadcast to them
ASKED = 512  # matches that ask one document for its words at a time, about
BACK = LENGTH - SEED_WORDS  # words that a window may start before its anchor
PLACE = ["late", "id"]  # where a text stands: null ids after all others


class _Seeds:
    """Windows of a batch of texts, and the anchor that owns each.

    Of the anchors inside a window, the one with the smallest hash owns it:
    equal windows have equal owners. An anchor's windows are neighbours; they
    make up its context, from the first one's first word to the last one's
    last.
    """

    def __init__(self, texts: list):
        self.words = w = Words(texts)
        seeds = w.runs(SEED_WORDS)
        own = winnow(seeds, LENGTH - SEED_WORDS + 1)
        doc = w.owner()
        last = len(own)
        inside = doc[:last] == doc[LENGTH - 1 : LENGTH - 1 + last] if last else np.zeros(0, bool)
        self.start = np.flatnonzero(inside)  # word indexes where windows start
        at = own[self.start]
        self.doc = doc[self.start]
        self.offset = self.start - w.first[self.doc] if last else self.start
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.head = np.flatnonzero(new)  # first window of each anchor
        self.tail = np.concatenate([self.head[1:], np.array([len(at)], np.int64)])[: len(self.head)]
        self.anchor = seeds[at[self.head]]  # hash of each anchor
        self.anchor_doc = self.doc[self.head]
        self.anchor_at = (at[self.head] - w.first[self.anchor_doc]).astype(np.int32) if last else np.zeros(0, np.int32)

    def windows(self) -> np.ndarray:
        w = self.words
        return w.spans(w.begin[self.start], w.end[self.start + LENGTH - 1]) if len(self.start) else np.zeros(0, np.uint64)

    def open(self, settled: list) -> np.ndarray:
        """Which anchors stand at a later place than their first one. settled: for each text, all others, as place << 16 and 16 bits of the hash.

        The bits are for rows that share a place.
        """
        out = np.ones(len(self.anchor), bool)
        cuts = np.searchsorted(self.anchor_doc, np.arange(len(settled) + 1))
        own = (self.anchor_at.astype(np.int64) << 16) | (self.anchor & np.uint64(0xFFFF)).view(np.int64)
        for i, x in enumerate(settled):
            if x is not None and len(x):
                out[cuts[i] : cuts[i + 1]] = ~np.isin(own[cuts[i] : cuts[i + 1]], x)
        return out


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sign(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _matches(places: DataFrame, first: DataFrame) -> DataFrame:
    """Diagonals on which places (key, late, id, pos) meet the first place of their key.

    Keys with many places have their first one broadcast to them, others join
    it. A match stands for up to STRIDE words of a document's diagonal against
    another's: it starts at its first seed ``a`` and ends at its last ``b``;
    ``shift`` is how far the other's words lie behind.
    """
    # A row for HOT places at most.
    many = F.broadcast(first.where(F.col("n") > HOT).select("key", F.col("e").alias("hot")))
    lead = first.select(F.col("key").alias("of"), "e")
    here = F.struct(*PLACE, "pos")
    # Places of hot keys are spread by a key of their own, which finds nothing more.
    own = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64(*PLACE, "pos", "key"))
    met = places.join(many, "key", "left").withColumn("of", own).join(lead, "of", "left").withColumn("o", F.coalesce("hot", "e"))
    return (
        met.where((here != F.col("o")) & F.col("o.late").isNotNull() & F.col("o.id").isNotNull())
        .groupBy(
            *PLACE, F.col("o.late").alias("o_late"), F.col("o.id").alias("o_id"),
            (F.col("pos") - F.col("o.pos")).alias("shift"), F.floor(F.col("pos") / STRIDE).alias("stretch"),
        )
        .agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
        .select(*PLACE, "o_late", "o_id", "shift", "a", "b")
    )


def _whole(rows: DataFrame) -> DataFrame:
    """Rows with a place: said beforehand, so that joins don't say it on one of two uses of an exchange."""
    return rows.where(" and ".join(f"{c} is not null" for c in (*PLACE, "key") if c in rows.columns))


def _words_of(texts: DataFrame, matches: DataFrame, before: int) -> DataFrame:
    """(late, id, told): for each document the words that its matches are to be compared with.

    Each is where the document would have them, in four bytes, and the words, from ``before`` words before
    a match's first seed to LENGTH words after the start of its last. Matches
    ask a document in blocks of about ASKED, however many there are.
    """
    blocks = F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("blocks")
    # A row for ASKED matches at most. All columns are asked for, so that both uses of the matches have one exchange.
    every = F.max(F.struct(*PLACE, "shift", "a", "b")).alias("every")
    many = F.broadcast(matches.groupBy("o_late", "o_id").agg(blocks, every).where("blocks > 1 and every is not null").drop("every"))
    asked = (
        matches.join(many, ["o_late", "o_id"], "left")
        .withColumn("block", F.coalesce(F.pmod(F.xxhash64(*PLACE, "a", "shift"), "blocks"), F.lit(0)).cast("int"))
        .groupBy(F.col("o_late").alias("late"), F.col("o_id").alias("id"), "block")
        .agg(F.collect_list(F.struct(F.col("late").alias("to_late"), F.col("id").alias("to_id"), "shift", "a", "b")).alias("asked"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for text, asked in zip(b["text"], b["asked"], strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                for m in asked:
                    at = max(m["a"] - m["shift"] - before, 0)
                    words = b" ".join(own[at : m["b"] - m["shift"] + LENGTH])
                    rows.append((m["to_late"], m["to_id"], (at + m["shift"]).to_bytes(4, "little", signed=True) + words))
                    size += len(words)
                if size > 1 << 23:
                    yield pd.DataFrame(rows, columns=["late", "id", "told"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["late", "id", "told"])

    told = _whole(texts.join(asked, PLACE).select("text", "asked").mapInPandas(run, "late boolean, id long, told binary"))
    return told.groupBy(*PLACE).agg(F.collect_list("told").alias("told"))


def _repeats(own: list[bytes], told) -> np.ndarray:
    """Starts of windows of a document that equal, word for word, what it is told: maximal runs of LENGTH equal words or more.

    Such a run covers the LENGTH-th place after any that differs, so only
    these are looked at, and extended both ways where they are equal.
    """
    starts = []
    for m in told if told is not None else ():
        other, at = m[4:].split(b" "), int.from_bytes(m[:4], "little", signed=True)
        if at < 0:
            other, at = other[-at:], 0
        mine = own[at : at + len(other)]
        n, i = len(mine), LENGTH - 1
        if n >= LENGTH and mine == other:
            starts.append(np.arange(at, at + n - LENGTH + 1))
            continue
        while i < n:
            if mine[i] == other[i]:
                a, b = i, i + 1
                while a and mine[a - 1] == other[a - 1]:
                    a -= 1
                while b < n and mine[b] == other[b]:
                    b += 1
                if b - a >= LENGTH:
                    starts.append(np.arange(at + a, at + b - LENGTH + 1))
                i = b
            i += LENGTH
    return np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Each document without the words of passages of LENGTH words or more that start earlier elsewhere.

    A window is LENGTH consecutive words; each word covered by a window whose
    words also start earlier (smaller id, or same id and an earlier start) is
    removed. Windows are judged on the input.

    1. Every document's winnowed anchors are counted by hash (combined on the
       map side); each document is told where its anchors stand that occur
       once in the corpus, and those that stand first.
    2. All later places of an anchor join its earliest one. Places on one
       diagonal of two documents become a match, which is extended both ways
       by comparing words: the earlier document's words travel to the later
       one, and maximal runs of LENGTH equal words or more are repeats.
    3. Windows of repeated anchors that equal nothing at the anchor's first
       place may still equal one another: they join the earliest window of
       their hash and are compared in the same way.
    4. A document removes the words of all its repeats.

    Words decide, not hashes: two different texts of one hash can't remove
    anything. No group of copies is gathered: places and windows of one key
    are dealt into parts, matches that ask one document into blocks. The texts
    are dealt by id once, and that exchange serves all passes; what else moves
    is places, and the words of matches.

    Null texts have no words. Rows with a null id order last, by a hash of the
    text; equal ones are one place. Rows that repeat an id are the same place:
    windows at equal starts of such rows aren't earlier than one another.
    Ties don't arise otherwise. A document is handled by one task, in memory of
    some 40 times its text; an empty table gives no rows; other columns play
    no part, whatever their names. Returns doc_id, n_words, n_removed,
    kept_sha256, a row per row; with_text adds kept_text.
    """
    ready(docs.sparkSession)
    own_id = F.col(id_col).cast("long")
    texts = docs.select(
        own_id.isNull().alias("late"), F.coalesce(own_id, F.xxhash64(text_col)).alias("id"), F.col(text_col).alias("text")
    ).repartition(*PLACE)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, ids, late = b["text"].tolist(), b["id"].to_numpy(), b["late"].to_numpy()
            for g in groups(text):
                s = _Seeds(text[g])
                yield pd.DataFrame({"key": _long(s.anchor), "late": late[g][s.anchor_doc], "id": ids[g][s.anchor_doc], "pos": s.anchor_at})

    counted = (
        _whole(texts.mapInPandas(anchors, "key long, late boolean, id long, pos int"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE, "pos")).alias("e"))
    )
    # Each document is told which of its anchors need no looking at: those that occur once, and first places.
    mark = F.shiftleft(F.col("e.pos").cast("long"), 16).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFFFF)))
    # (Asking for n keeps it in the exchange, which so serves the first places as well.)
    marks = counted.where("n > 0").groupBy("e.late", "e.id").agg(F.collect_list(mark).alias("settled"))
    seeded = texts.join(marks, PLACE, "left")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, ids, late, settled = b["text"].tolist(), b["id"].to_numpy(), b["late"].to_numpy(), b["settled"].tolist()
            for g in groups(text):
                s = _Seeds(text[g])
                pick = np.flatnonzero(s.open(settled[g]))
                doc = s.anchor_doc[pick]
                yield pd.DataFrame({"key": _long(s.anchor[pick]), "late": late[g][doc], "id": ids[g][doc], "pos": s.anchor_at[pick]})

    first = counted.where("n > 1")
    met = _matches(_whole(seeded.mapInPandas(places, "key long, late boolean, id long, pos int")), first)
    # A document that isn't told any words holds no later place of an anchor.
    told = seeded.join(_words_of(texts, met, BACK), PLACE)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a document: starts of its repeats, and the windows that are left to meet one another, packed."""
        for b in batches:
            text, told, settled, rows = b["text"].tolist(), b["told"].tolist(), b["settled"].tolist(), []
            for g in groups(text):
                s = _Seeds(text[g])
                pick = s.open(settled[g])
                spans = np.searchsorted(s.doc, np.arange(len(text[g]) + 1))
                left, window = np.repeat(pick, s.tail - s.head), s.windows()
                for i, own in enumerate(s.words.split):
                    again, span = _repeats(own, told[g][i]), slice(spans[i], spans[i + 1])
                    at = np.flatnonzero(left[span])
                    at = at[~np.isin(s.offset[span][at], again)]
                    rows.append(pickle.dumps((_sign(text[g][i]), again.astype(np.int32), _long(window[span][at]), s.offset[span][at].astype(np.int32))))
            yield pd.DataFrame({"late": b["late"], "id": b["id"], "packed": rows})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            parts = [pickle.loads(p)[2:] for p in b["packed"]]
            n = [len(window) for window, _ in parts]
            key, pos = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            yield pd.DataFrame({"key": key, "late": np.repeat(b["late"].to_numpy(), n), "id": np.repeat(b["id"].to_numpy(), n), "pos": pos})

    # One more exchange of one column, so that what was extended is worked out once and serves three uses.
    extended = _whole(
        told.select("late", "id", "text", "settled", "told")
        .mapInPandas(extend, "late boolean, id long, packed binary")
    ).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)
    windows = _whole(extended.mapInPandas(unpack, "key long, late boolean, id long, pos int"))
    common = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE, "pos")).alias("e")).where("n > 1")
    others = _words_of(texts, _matches(windows, common), 0)
    # Rows that share a place may differ in their texts.
    found = extended.groupBy(*PLACE).agg(F.collect_set("packed").alias("again"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, again, told in zip(b["text"], b["again"], b["told"], strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                starts = _repeats(own, told)
                for packed in again if again is not None else ():
                    sign, repeats, _, _ = pickle.loads(packed)
                    if len(again) == 1 or sign == _sign(text):
                        starts = np.union1d(starts, repeats).astype(np.int64)
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                n = int(gone.sum())
                kept = b" ".join(own if not n else [w for w, r in zip(own, gone.tolist(), strict=True) if not r])
                rows.append((len(own), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            out.insert(0, "doc_id", b["id"].astype("Int64").mask(b["late"].to_numpy()))
            yield out if with_text else out.drop(columns="kept_text")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.join(found, PLACE, "left").join(others, PLACE, "left").mapInPandas(judge, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
s AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS start, ws FROM d WHERE len(ws) >= 20),
h AS (SELECT doc_id, start, array_to_string(ws[start + 1 : start + 20], ' ') AS win FROM s),
r AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS k FROM h) WHERE k > 1),
c AS (
  SELECT w.doc_id, w.pos, w.word,
         coalesce(max(r.start) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.pos = r.start),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
