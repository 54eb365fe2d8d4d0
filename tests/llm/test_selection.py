"""Hard negatives, importance resampling and packing against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from test_corpus import CLASH, no_docs, odd_docs
from tokenizers import Tokenizer

from assayer.llm import importance, negatives, packing, registry
from assayer.llm.common import table

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


# --- hard negatives ---------------------------------------------------------------


def brute_negatives(rows, every=100, scale=256, shifted=7, classes=10, k=5):
    """All rows against all, by the contract's words; rows are (id, vector, label)."""
    used = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(scale * float(np.float32(x))) for x in v], (label + 1) % classes if i % shifted == 0 else label))
    out = []
    for a, q, label in {(i, tuple(q), label) for i, q, label in used if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(q, p)), i, other) for i, p, other in used if i != a]
        near = sorted((s, i) for s, i, other in scored if other == label)[:k]
        far = sorted((s, i) for s, i, other in scored if other != label)
        for s, i in sorted(set(near)):
            inside = [(n, j) for n, j in far if 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(inside)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, width=6, norms=True, spread=10.0):
    """Clustered vectors, of many norms or of one."""
    centres = rng.normal(size=(8, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(8)] + 0.3 * rng.normal(size=width)
        v = v * rng.lognormal(0, 1.2) if norms else v / np.linalg.norm(v)
        out.append((i, [float(x) for x in np.float32(v * spread)], int(rng.integers(4))))
    return out


@pytest.mark.parametrize("norms", [True, False])
def test_hard_negatives_against_brute_force(spark, monkeypatch, norms):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)  # many buckets, and blocks of ten anchors
    rows = vectors(np.random.default_rng(3), 700, norms=norms)
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(250)]  # a third are copies
    got = mined(spark.createDataFrame(rows, VECTORS), every=20)
    assert got == brute_negatives(rows, every=20) and len(got) > 100


def test_buckets_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(negatives, "GROWTH", 8)
    met = []
    real = negatives.visit
    monkeypatch.setattr(negatives, "visit", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    rows = vectors(np.random.default_rng(4), 800)
    assert mined(spark.createDataFrame(rows, VECTORS), every=40) == brute_negatives(rows, every=40)
    # In rounds of 1, 8 and 11 buckets for two blocks of anchors; the last one is mostly left out.
    assert negatives.rounds(20) == [(0, 1), (1, 9), (9, 20)]
    assert met[0] == 2 and met[2] < 0.6 * 2 * 11 and met[5] < 0.6 * 2 * 11


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.5], 2), (3, [1.0], 1), (4, [], 2), (5, None, 1), (6, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2),
        (10, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (11, [1.0, 1.9], 2), (11, [1.0, 1.9], 2), (12, [1.0, 1.8], 2), (13, [1.0, 1.9], 2), (14, [2.0, 1.4], 1), (1, [1.0, 2.0], 1),
        (100, [-1.0, -1.0], 2), (200, [0.0, 0.0], 1), (300, [1.0, 2.0], 1), (300, [1.0, 2.0], 1),
    ]
    padded = [(i, None if v is None else [*v, *[0.0] * (2 - len(v))], label) for i, v, label in rows]
    width = len(CLASH.split(", "))
    df = spark.createDataFrame([r + (None,) * width for r in rows], f"{VECTORS}, {CLASH}")
    want = brute_negatives(padded)
    got = mined(df)
    assert got == want and len(got) > 5
    assert any(r[5] == 0 for r in got)  # a zero vector's window
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], VECTORS)) == []  # no anchors


def test_hard_negatives_beyond_doubles(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1, 3, 7]) * 2.0**16 + rng.random(), 1.0], i % 2 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    used = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert max(abs(x) for _, q, _ in used for x in q) ** 2 * 2 >= 2**53
    got = mined(df, every=30)
    for a, p, _, n, ps, ns in got:
        by = {i: q for i, q, _ in used}
        assert ps == sum(x * y for x, y in zip(by[a], by[p])) and ns == sum(x * y for x, y in zip(by[a], by[n])) and 80 * ps <= 100 * ns <= 100 * ps
    assert got


@pytest.mark.parametrize("sf", [SF, MID])
def test_hard_negatives_as_sql(spark, sf):
    assert differences(registry.op11_hard_negatives(spark, sf), connect(sf), negatives.ORACLE_SQL) is None


# --- importance resampling --------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, buckets=10_000, percent=5):
    """By the contract's words, with every n-gram written out; docs are (id, text)."""
    count = lambda texts: Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t))
    s, t = count([x for _, x in docs]), count(target)
    whole, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * wanted)))
    out = []
    for i, text in docs:
        f = grams(text)
        weight = sum(gain(zlib.crc32(g.encode()) % buckets) for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def resampled(docs, target, **options):
    got = importance.resample(docs, target, **options)
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str)


@pytest.mark.parametrize("sf", [SF, MID])
def test_resampling_against_brute_force(spark, sf):
    docs, target = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.select("text").collect()])
    got = registry.op12_importance_resampling(spark, sf)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str) == want
    assert sum(r[4] is not None for r in want) == sum(r[5] >= 20 for r in want) * 5 // 100 > 0


def test_drawn_documents_are_like_the_target(spark):
    rng = random.Random(0)
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    docs = [(i, text(["sea", "wave", "salt", "boat"] if i % 10 == 0 else ["rock", "hill", "peak", "snow"])) for i in range(400)]
    got = resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(text(["sea", "wave", "salt", "boat"]),)], "text string"), percent=8)
    assert [r[0] % 10 for r in got if r[4] is not None] == [0] * 32


def test_resampling_of_odd_documents(spark):
    docs = odd_docs(spark)
    target = spark.createDataFrame([(None,), ("",), ("the of w1 the",)], "text string")
    want = brute_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [None, "", "the of w1 the"], percent=50)
    assert resampled(docs, target, percent=50) == want
    assert resampled(no_docs(spark), target) == []
    assert len(resampled(docs, target.limit(0))) == docs.count()


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    ids = list(range(3000))
    df = spark.createDataFrame([(i, "a b c " * 8) for i in ids], "doc_id long, text string").repartition(6)
    got = {r[0]: r[4] for r in resampled(df, spark.createDataFrame([("a b",)], "text string"), percent=40)}
    want = {r[0]: r[4] for r in brute_resample([(i, "a b c " * 8) for i in ids], ["a b"], percent=40)}
    assert got == want and sum(v is not None for v in got.values()) == 1200


def test_crcs_combine():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 1000]))) for _ in range(2))
        got = importance.shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)
    far = 5_000_000
    assert int(importance.shift(np.array([zlib.crc32(b"x")], np.uint32), np.array([far]))[0]) ^ zlib.crc32(bytes(far)) == zlib.crc32(b"x" + bytes(far))


# --- packing ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(registry.model_file(registry.WORD_MODEL))


def packed(docs, **options):
    return [r.asDict() for r in packing.pack(docs, registry.model_file(registry.WORD_MODEL), **options).select(packing.PIECE).collect()]


def whole_and_full(pieces, texts, tokenizer, capacity=2048):
    """Pieces are all ids of their texts, each once, in gapless sequences without padding. ``texts`` are (id, text), repeated ones too."""
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    assert by.keys() == ids.keys()
    for i, ps in by.items():
        want = Counter()
        for p in ps:
            assert 0 < p["length"] <= capacity and 0 <= p["start"] and p["start"] + p["length"] <= p["doc_tokens"]
            fits = [d for d in ids[i] if len(d) // 4 == p["doc_tokens"] and zlib.crc32(d[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]]
            assert fits, p
            want.update(range(p["start"], p["start"] + p["length"]))
        have = Counter()
        for d in ids[i]:
            have.update(range(len(d) // 4))
        assert want == have
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    short = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        if at != capacity:
            short.append(at)
    assert all(x & (x - 1) == 0 and x < capacity for x in short) and len(short) == len(set(short))
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("sf", [SF, MID])
def test_packing_keeps_every_id(spark, tokenizer, sf):
    docs = table(spark, sf, "documents")
    pieces = [r.asDict() for r in registry.op13_packing(spark, sf).collect()]
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    whole_and_full(pieces, texts, tokenizer)
    total = sum(p["length"] for p in pieces)
    assert len(pieces) < len(texts) + 2 * (total // 2048) + 40  # few tails are cut


def test_packing_of_odd_documents(spark, tokenizer):
    docs = odd_docs(spark)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    whole_and_full(packed(docs), texts, tokenizer)
    whole_and_full(packed(docs, capacity=64), texts, tokenizer, 64)
    assert packed(no_docs(spark)) == []
    special = [(1, "a<|endoftext|>b |x| <|startoftext|>"), (2, "İx ΣΑΣ ´´ ﬁ ½ é  \u0085\x1c"), (3, "don't WE'LL 'S 12a3"), (4, "|"), (5, "漢字😀")]
    whole_and_full(packed(spark.createDataFrame(special, "doc_id long, text string")), special, tokenizer)


@pytest.mark.parametrize("text", ["same words here", "w " * 1499, ""])
def test_many_equal_documents_are_packed_full(spark, tokenizer, text):
    texts = [(i, text) for i in range(301)]
    whole_and_full(packed(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)), texts, tokenizer)


def test_encoder_forgets_and_learns_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    rng = random.Random(6)
    coder = packing.Encoder(open(registry.model_file(registry.WORD_MODEL), encoding="utf-8").read())
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abÀéß.,|'9Ωא漢 ") for _ in range(rng.randrange(1, 90))) for _ in range(20)) for _ in range(3)]
        for t, ids in zip(texts, coder.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert len(coder.known) <= max(50, len({w for t in texts for w in t.encode().split()}))
    assert len(coder.parts) <= 400


def test_encoder_merges_no_part_again_that_either_generation_holds(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    coder = packing.Encoder(open(registry.model_file(registry.WORD_MODEL), encoding="utf-8").read())
    merge, merged = coder.merge, []
    coder.merge = lambda text: merged.append(text) or merge(text)
    first, more = [chr(97 + i % 26) + chr(97 + i // 26) + "qx" for i in range(45)], ["zz" + chr(97 + i) for i in range(20)]
    for words in (first, more, [w.title() for w in first], [w.upper() for w in more]):
        coder.encode([" ".join(words).encode()])
    assert sorted(filter(None, merged)) == sorted(first + more)


def test_encoder_on_every_latin_character_and_odd_bytes(tokenizer):
    coder = packing.Encoder(open(registry.model_file(registry.WORD_MODEL), encoding="utf-8").read())
    signs = [chr(i) for i in range(1, 0x250)]
    texts = [f"{x} a{x} {x}B 1{x}2 .{x}! {x}{x}'s" for x in signs]
    texts += ["", " ", "\n a  b\t", "x" * 500 + " y", "é" * 90, "<|endoftext|>a <|startoftext|", "e\u0301 'S we'LL", "\u1e9e ẞß ǅ \u3000漢"]
    for t, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    odd = [b"\xff", b"a\xc3 b", b"ok \xe4\xb8", b"\xed\xa0\x80x"]
    for t, ids in zip(odd, coder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
    assert coder.encode([]) == [] and coder.encode([b"", b" "]) == [b"", b""]


def test_small_batches_are_encoded_together(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [b"a" * n]}) for i, n in enumerate([10, 0, 30, 9_000, 20, 40])]
    monkeypatch.setattr(packing, "TOGETHER", 1_000)
    assert [b.column(0).to_pylist() for b in packing.gathered(iter(batches))] == [[0, 1, 2], [3], [4, 5]]
    assert list(packing.gathered(iter([]))) == []


@pytest.mark.parametrize("seed", range(6))
def test_filling_against_all_subsets(seed):
    """The company of the longest piece leaves the least slack that any subset of the others leaves."""
    rng = random.Random(seed)
    capacity = 40
    counts = {rng.randrange(1, capacity): rng.randrange(1, 4) for _ in range(6)}
    pieces = packing._Pieces(counts, capacity)
    lengths = pieces.lengths()
    picked, slack = pieces.closest(lengths)
    rest = [x for x, n in counts.items() for _ in range(n - (x == lengths[0]))]
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums}
    assert slack == min(capacity - lengths[0] - s for s in sums if s <= capacity - lengths[0])
    assert sum(x * n for x, n in picked.items()) == capacity - slack and all(n <= counts[x] for x, n in picked.items())


def test_filling_does_not_grow_with_the_counts():
    rng = random.Random(3)
    small = {x: rng.randrange(1, 9) for x in range(1, 2048)}
    a, b = packing.fill(small), packing.fill({x: n * 10**9 for x, n in small.items()})
    assert len(b.start) < 4 * len(a.start) and b.sequences - sum(x * n for x, n in small.items()) * 10**9 / 2048 < 12
