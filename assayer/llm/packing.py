"""Packing documents' tokens into sequences by minimum bin slack over counts of lengths."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import ranks
from .common import kept, ready
from .windows import groups

CAPACITY = 2048
END = 1  # the id after each document
CACHED_WORDS = 300_000  # different ones in each generation that a worker remembers
LONGEST_CACHED = 64  # bytes of a word worth remembering
TOGETHER = 1 << 22  # bytes of texts that are encoded at once, a longer text alone
#: Texts below U+0250 without white space, whose lower case (one character for each) and composition don't depend on what is around.
LATIN = "^[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+$"
_CLASS = 44  # bits of a place among the pieces of a length


def _listed(values: pa.Array) -> list:
    """Like to_pylist, which makes a scalar of each value first."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Memory(dict):
    """Ids of strings, in two generations of at most CACHED_WORDS: this, and ``old``.

    ``learn`` gives the ids of strings that neither holds.
    """

    def __init__(self, learn: Callable[[pa.BinaryArray], list[bytes]]):
        self.learn, self.old = learn, {}

    def joined(self, lists: pa.ListArray) -> list[bytes]:
        """The ids of each list's strings, one after another. Each different string is looked up once."""
        strings = lists.flatten().dictionary_encode()
        if not len(strings):
            return [b""] * len(lists)
        here = _listed(strings.dictionary.view(pa.binary()))
        got = list(map(self.get, here))
        missing = [i for i, ids in enumerate(got) if ids is None]
        old = self.old
        if len(self) + len(missing) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        new = []
        for i in missing:
            ids = got[i] = old.get(here[i])
            if ids is None:
                new.append(i)
            else:
                self[here[i]] = ids
        if new:
            for i, ids in zip(new, self.learn(strings.dictionary.take(pa.array(new))), strict=True):
                got[i] = ids
                if len(here[i]) <= LONGEST_CACHED:
                    self[here[i]] = ids
        _, ends, data = pa.array(got, pa.large_binary()).take(strings.indices).buffers()
        at = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()]
        data = memoryview(data or b"")
        return [data[i:j].tobytes() for i, j in pairwise(at.tolist())]


class Encoder:
    """Ids of whole texts, by their different words.

    The vocabulary's rules never look across white space, so Arrow splits
    texts there, and what stands between two white spaces is encoded once and
    remembered. Words of Latin letters and signs, whose normal form is
    themselves in lower case, are split by Arrow as well, so that their
    parts are merged once for all spellings; others go through the library as they are.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_str(model), Memory(self._words), Memory(self._parts)
        self.merge = self.tokenizer.model.tokenize
        # The printable sign that stands for each byte: itself, or the next one from 256 on.
        kept = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
        others = [b for b in range(256) if b not in kept]
        self.signs = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        rules = json.loads(model)
        self.rule = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = [t["content"] for t in rules["added_tokens"]]

    def _parts(self, parts: pa.StringArray) -> list[bytes]:
        merge, sign = self.merge, self.signs.__getitem__
        texts = (p if p.isascii() else "".join(map(sign, p.encode())) for p in _listed(parts))
        return [array("I", [t.id for t in merge(t)]).tobytes() for t in texts]

    def _words(self, words: pa.StringArray) -> list[bytes]:
        latin = pc.match_substring_regex(words, LATIN)
        for s in self.special:
            latin = pc.and_not(latin, pc.match_substring(words, s))
        parts = pc.replace_substring_regex(pc.utf8_lower(words.filter(latin)), self.rule, r"\0 ")
        split = iter(self.parts.joined(pc.ascii_split_whitespace(parts)))
        others = _listed(words.filter(pc.invert(latin)).view(pa.binary()))
        got = iter(self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False))
        return [next(split) if x else array("I", next(got).ids).tobytes() for x in _listed(latin)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.known.joined(pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string())))


@lru_cache(maxsize=1)
def encoder(model: str) -> Encoder:
    """A worker's encoder: what it has learnt serves all of its tasks."""
    return Encoder(model)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to TOGETHER bytes, as small ones would look common words up again and again; a larger one stays alone."""
    some, size = [], 0
    for b in batches:
        more = b.nbytes + 64 * b.num_rows  # what rows take as Python's objects
        if some and size + more > TOGETHER:
            yield pa.concat_batches(some)
            some, size = [], 0
        some.append(b)
        size += more
    if some:
        yield pa.concat_batches(some)


def tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's tokens with its end id: n, and the checksums of its full sequences and of its tail, whose ids come along.

    ``first`` counts the full sequences that the scan's partition has before,
    ``key`` tells rows apart. The table is written, so both stay.
    """
    model = ready(docs.sparkSession).sparkContext.broadcast(Path(model_file).read_text())  # a few megabytes
    last, width = np.array([end], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = encoder(model.value), 0
        for b in gathered(batches):
            texts = [t or b"" for t in _listed(b.column(1))]
            n, before, checks, tails, tail_crc = [], [], [], [], []
            for part in groups(texts, TOGETHER):
                for ids in coder.encode(texts[part]):
                    ids += last
                    full = len(ids) // width
                    n.append(len(ids) // 4)
                    before.append(first)
                    checks.append([zlib.crc32(memoryview(ids)[width * i : width * (i + 1)]) for i in range(full)])
                    tails.append(ids[width * full :])
                    tail_crc.append(zlib.crc32(tails[-1]))
                    first += full
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(checks, pa.list_(pa.int64())), pa.array(tail_crc, pa.int64()), pa.array(tails, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "first", "checks", "tail_crc", "tail"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n long, first long, checks array<long>, tail_crc long, tail binary")
    return kept(out.withColumn("key", F.monotonically_increasing_id()), "tokens")


@dataclass
class Filling:
    """Where the pieces of each length go.

    Pieces of a length are numbered from 0. A step says what becomes of those
    numbered from ``start`` on: they fill sequences, ``times`` of them each,
    or lend each sequence their first ``taken`` ids and go on as pieces of the
    length that is left.
    """

    start: np.ndarray  # length << _CLASS | number, ascending
    taken: np.ndarray  # ids that go to the sequence
    times: np.ndarray  # pieces that one sequence gets
    sequence: np.ndarray  # of the first piece
    offset: np.ndarray  # there
    next: np.ndarray  # length << _CLASS | number of what is left of the first piece, -1 if nothing is
    sequences: int


class _Pieces:
    """How many pieces of each length there are, and how many have a place."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.total, self.done = capacity, [0] * (capacity + 1), [0] * (capacity + 1)
        for length, n in counts.items():
            self.total[length] = n

    def left(self, length: int) -> int:
        return self.total[length] - self.done[length]

    def lengths(self) -> list[int]:
        """Lengths with pieces left, the longest first."""
        return [x for x in range(self.capacity, 0, -1) if self.total[x] > self.done[x]]

    def closest(self, lengths: list[int]) -> tuple[dict[int, int], int]:
        """Of all multisets with the longest piece that is left, the one with the least slack, and that slack.

        Sums that can be reached are bits of one integer; each length adds its
        shifts, at most as many as there are pieces. What the integer was
        before a length tells, backwards, how many of it the sum holds.
        """
        room = self.capacity - lengths[0]
        every, bits, trail = (1 << (room + 1)) - 1, 1, []
        for x in lengths:
            n = min(self.left(x) - (x == lengths[0]), room // x)
            if n <= 0:
                continue
            trail.append((x, bits))
            step = 1
            while n > 0:
                bits |= bits << (min(step, n) * x)
                n -= step
                step *= 2
            bits &= every
            if bits >> room & 1:
                break
        best = bits.bit_length() - 1
        picked, rest = {lengths[0]: 1}, best
        for x, before in reversed(trail):
            while not before >> rest & 1:
                picked[x] = picked.get(x, 0) + 1
                rest -= x
        return picked, room - best


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> Filling:
    """Fills sequences with pieces of the given lengths until none is left.

    Each time the longest piece left gets the company that leaves the least
    slack, and the same company is repeated as often as there are pieces. Where slack is
    left, a piece of the commonest other length is cut to fill it. The last pieces, too few
    for a sequence, are laid into sequences of powers of two. ``counts`` has a
    number a length, so this work doesn't grow with the corpus.
    """
    pieces, steps, sequence = _Pieces(counts, capacity), [], 0

    def place(length: int, times: int, per: int, taken: int, offset: int, at: int) -> None:
        rest = length - taken
        steps.append((length << _CLASS | pieces.done[length], taken, per, at, offset, (rest << _CLASS | pieces.total[rest]) if rest else -1))
        pieces.done[length] += times * per
        if rest:
            pieces.total[rest] += times

    while lengths := pieces.lengths():
        picked, slack = pieces.closest(lengths)
        spare = [x for x in lengths if pieces.left(x) > picked.get(x, 0)] if slack else []
        if slack and not spare:
            sequence = _powers(picked, pieces, place, sequence)
            continue
        need = dict(picked)
        if slack:
            cut = max(spare, key=lambda x: pieces.left(x) - picked.get(x, 0))
            need[cut] = need.get(cut, 0) + 1
        times = min(pieces.left(x) // n for x, n in need.items())
        offset = 0
        for x in sorted(picked, reverse=True):
            place(x, times, picked[x], x, offset, sequence)
            offset += x * picked[x]
        if slack:
            place(cut, times, 1, slack, offset, sequence)
        sequence += times
    steps.sort()
    columns = [np.array(c, np.int64) for c in zip(*steps, strict=True)] or [np.zeros(0, np.int64)] * 6
    return Filling(*columns, sequence)


def _powers(picked: dict[int, int], pieces: _Pieces, place, sequence: int) -> int:
    """The last pieces in sequences of the powers of two that add up to them, cut where these end."""
    total = sum(x * n for x, n in picked.items())
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    offset = 0
    for x in [x for x in sorted(picked, reverse=True) for _ in range(picked[x])]:
        while x:
            taken = min(x, sizes[0] - offset)
            place(x, 1, 1, taken, offset, sequence)
            x, offset = x - taken, offset + taken
            if offset == sizes[0]:
                sizes, offset, sequence = sizes[1:], 0, sequence + 1
    return sequence


def laid_out(length: np.ndarray, number: np.ndarray, filling: Filling) -> tuple[np.ndarray, ...]:
    """(piece, start, taken, sequence, offset): where the pieces with these lengths and numbers go, cut ones in parts."""
    who, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    at = length << _CLASS | number
    while len(who):
        step = np.searchsorted(filling.start, at, "right") - 1
        j = at - filling.start[step]
        copy, slot = j // filling.times[step], j % filling.times[step]
        taken = filling.taken[step]
        out.append((who, start, taken, filling.sequence[step] + copy, filling.offset[step] + slot * taken))
        more = filling.next[step] >= 0
        who, start, at = who[more], (start + taken)[more], (filling.next[step] + j)[more]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces that documents are cut into, and the sequence of each.

    A document's full sequences come first; its tail, shorter than one, is
    packed with others' by :func:`fill`, from the number of tails of each
    length, which is all that reaches the driver. Tails are numbered within
    their length in ranges of (length, row), so neither a common length nor
    many equal documents meet in one task. Tails that are cut, few where
    lengths vary, join their ids to get the parts' checksums.

    No sequence is padded: all are full but for at most eleven, the last ones,
    whose lengths are powers of two.

    Nulls: a null text is empty, and an empty text has only its end id; a null
    id stays null. Repeated rows are documents of their own. Very long texts are
    encoded whole. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, a row a piece; none for an empty table. Other columns
    play no part.
    """
    spark = docs.sparkSession
    done = tokens(docs, model_file, id_col, text_col, capacity, end)
    tail = (F.col("n") % capacity).cast("long")
    counts = {r["length"]: r["n"] for r in done.groupBy(tail.alias("length")).agg(F.count(F.lit(1)).alias("n")).where("length > 0").collect()}
    filling = fill(counts, capacity)
    shared = spark.sparkContext.broadcast(filling)  # steps follow the capacity, not the corpus
    # Full sequences are numbered by the partitions of the scan: a row a partition.
    part = F.shiftright("key", 33)
    full = done.groupBy(part.alias("part")).agg(F.sum(F.size("checks")).alias("full"))
    ahead = F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = full.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    light = done.withColumn("length", tail).drop("tail")
    numbered = ranks(light, ["key"], ("length",), "number").withColumn("part", part)
    rows = numbered.join(F.broadcast(ahead), "part").withColumn("first", F.col("first") + F.col("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            n, first, length, number, crc = (b.column(c).to_numpy() for c in ("n", "first", "length", "number", "tail_crc"))
            checks = b.column("checks")
            full = n // capacity
            owner = np.repeat(np.arange(len(n)), full)
            i = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
            some = np.flatnonzero(length)
            who, start, taken, sequence, offset = laid_out(length[some], number[some], plan)
            who = some[who]
            whole = taken == length[who]
            row = np.concatenate([owner, who])
            check = np.concatenate([checks.flatten().to_numpy(), crc[who]])
            cut = np.concatenate([np.zeros(len(owner), bool), ~whole])
            columns = [
                b.column("doc_id").take(pa.array(row)),
                pa.array(np.concatenate([i * capacity, full[who] * capacity + start])),
                pa.array(np.concatenate([np.full(len(owner), capacity), taken])),
                pa.array(check, mask=cut),
                pa.array(n[row]),
                pa.array(np.concatenate([plan.sequences + first[owner] + i, sequence])),
                pa.array(np.concatenate([np.zeros(len(owner), np.int64), offset])),
                b.column("key").take(pa.array(row)),
                pa.array(np.concatenate([np.zeros(len(owner), np.int64), start])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*PIECE, "key", "inside"])

    kind = done.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in PIECE[1:])}, key long, inside long")
    pieces = kept(pieces, "pieces")
    whole = pieces.where("ids_crc32 is not null").select(*PIECE)
    check = F.crc32(F.substring(F.col("tail"), (4 * F.col("inside") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    parts = pieces.where("ids_crc32 is null").join(done.select("key", "tail"), "key").withColumn("ids_crc32", check)
    return whole.unionByName(parts.select(*PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
