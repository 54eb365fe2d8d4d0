"""SentencePiece BPE encoding by a merge-type prefix table, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

SPACE = "▁"
CACHED_PARTS = 300_000  # distinct parts in each of the two generations that a worker remembers
CACHED_PAIRS = 1_000_000  # pairs of tokens whose compatibility it remembers
LONGEST_CACHED = 48  # characters of a part worth remembering


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces that take part in merges with their ranks, and special ids."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    begin: int
    end: int

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids = {}, {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                pieces[m.id_to_piece(i)] = (i, m.get_score(i))
        if len(byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        for p in pieces:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError("pieces must not reach over a line break or into the next word")
        return Vocabulary(pieces, tuple(byte_ids[b] for b in range(256)), m.bos_id(), m.eos_id())


class Encoder:
    """Encodes with one table of last tokens a part.

    BPE has the property that the last token of each prefix's encoding is
    unique, and that a sequence of tokens is an encoding exactly if every two
    neighbours are one when joined. So for each prefix the table holds the one
    token that ends there (an Aho-Corasick automaton gives the candidates) and
    is compatible with the last token of the prefix before it; ids are read
    off the table backwards.

    Pieces never reach over a line break nor over a space that follows another
    character, so a text is cut into parts there, and a worker remembers the
    ids of short parts.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {p: s for p, (_, s) in vocabulary.pieces.items()}
        self.piece = [""] * (max(i for i, _ in vocabulary.pieces.values()) + 1)
        self.known = {p for p in vocabulary.pieces if len(p) == 1}
        self.byte_ids = vocabulary.byte_ids
        self.begin, self.end = vocabulary.begin, vocabulary.end
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in vocabulary.pieces.items():
            self.piece[i] = p
            if len(p) == 1 or self.merge(p) == [p]:  # others can't come out of merges
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.utf8 = [p.replace(SPACE, " ").encode() for p in self.piece]
        for b, i in enumerate(self.byte_ids):
            self.utf8[i] = bytes([b])

    def merge(self, text: str) -> list[str]:
        """Plain BPE over a short text: join the neighbours of the best rank, leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        rank, heap = self.rank, []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, joined, encode as just these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            known = self.pairs[key] = self.merge(x + y) == [x, y]
        return known

    def run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        last, size = [0] * (n + 1), [0] * (n + 1)
        size[0] = -1  # the empty prefix
        get = self.pairs.get
        for end, (token, k) in self.automaton.iter(text):
            end += 1
            p = end - k
            if size[end] or not size[p]:
                continue
            if p:
                ok = get(last[p] << 32 | token)
                if not (self.compatible(last[p], token) if ok is None else ok):
                    continue
            last[end], size[end] = token, k
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def encode_part(self, part: str) -> list[int]:
        if self.known.issuperset(part):
            return self.run(part)
        out, start = [], 0
        for i, c in enumerate(part):
            if c not in self.known:
                if start < i:
                    out += self.run(part[start:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        return out + self.run(part[start:]) if start < len(part) else out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids of a text, begin and end included.

        Marks become spaces, bytes' ids bytes; the first mark, which stands
        for no character of the text, goes.
        """
        out = b"".join(map(self.utf8.__getitem__, ids[1:-1]))
        return out[1:] if out[:1] == b" " else out

    def part_ids(self, part: str) -> bytes:
        """Ids of a part that isn't among the newly remembered ones, as 32-bit integers."""
        got = self.older.get(part)
        if got is None:
            got = array("I", self.encode_part(part)).tobytes()
        if len(part) <= LONGEST_CACHED:
            if len(self.parts) >= CACHED_PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, begin and end included."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        found, miss = [], self.part_ids
        for p in self.part.findall(marked):
            found.append(self.parts.get(p) or miss(p))
        ids = np.frombuffer(b"".join(found), np.uint32)
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")

    def text(self, text: str | None) -> tuple[np.ndarray, bytes]:
        ids = self.encode(text)
        return ids, self.decode(ids.tolist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of a model, made once."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def _apply(docs: DataFrame, model_file: str, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    vocabulary = ready(docs.sparkSession).sparkContext.broadcast(Vocabulary.load(model_file))  # tens of thousands of pieces

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(model_file, vocabulary.value)
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            out = pd.DataFrame([row(*enc.text(t)) for t in b["text"]], columns=names)
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id long, {schema}"
    )


def _digest(ids: np.ndarray, decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _whole(ids: np.ndarray, decoded: bytes) -> tuple:
    return len(ids), ids.astype(np.int32), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids of every row's whole text with begin and end ids, digest of their decoding.

    A null text is an empty one: begin and end ids only. Spaces are marked and
    kept, a mark stands before the first character, characters without a piece
    become their bytes' ids. Rows stay one for one, repeated ones and those
    with a null id too; an empty table gives none. A text is encoded by one
    task, however long, in time about linear in it; what a worker remembers is
    bounded (CACHED_PARTS, CACHED_PAIRS). Other columns play no part.
    """
    return _apply(docs, model_file, id_col, text_col, _whole, "n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, with ids_sha256 in place of the ids."""
    return _apply(docs, model_file, id_col, text_col, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
